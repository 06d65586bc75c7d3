"""Tables that are kept for an application, and exact picks from large groups."""

import random

from pyspark.sql import functions as F

from borelog.operators.tables import first_n, kept


def test_first_n_equals_a_sort(spark):
    draw = random.Random(3)
    wanted = {"a": 7, "b": 0, "c": 1, "d": 500, "e": 40}
    rows = [(g, draw.choice([0.1, 0.15, 0.2, 0.9]), draw.randrange(5), i, n) for g, n in wanted.items() for i in range(60)]
    df = spark.createDataFrame(rows, "g string, s double, w int, id int, n int").withColumn("band", F.floor(F.col("s") * 10))
    got = {(r.g, r.id) for r in first_n(df, ["g"], [("band", True), ("s", True), ("w", False), ("id", False)], "n").collect()}
    assert got == {(r[0], r[3]) for g, n in wanted.items() for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2], r[3]))[:n]}


def test_first_n_of_nothing(spark):
    df = spark.createDataFrame([], "g string, s double, n int")
    assert first_n(df, ["g"], [("s", True)], "n").count() == 0


def test_kept_follows_its_inputs(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(f"{tmp_path}/in").groupBy("k").count()

    spark.range(6).select((F.col("id") % 2).alias("k")).write.parquet(f"{tmp_path}/in")
    paths = [f"{tmp_path}/in"]
    assert sorted(map(tuple, kept(spark, "t", paths, build).collect())) == [(0, 3), (1, 3)]
    assert sorted(map(tuple, kept(spark, "t", paths, build).collect())) == [(0, 3), (1, 3)] and len(calls) == 1
    spark.range(1).select(F.col("id").alias("k")).write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, kept(spark, "t", paths, build).collect())) == [(0, 4), (1, 3)] and len(calls) == 2
