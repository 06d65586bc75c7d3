"""Intermediate tables in the folder that driver and executors share, and exact picks from large groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_KEPT: dict[tuple, tuple[str, StructType]] = {}


def _write(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read again, for what several branches of a plan use: it is computed once, and a lost executor repeats none of it.

    A session of one machine without that setting (as in tests) gets a folder in its warehouse; on a cluster that is an error."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, name))


def stamp(spark: SparkSession, paths: list[str]) -> tuple:
    """Number and fingerprint of the files below ``paths`` (names, lengths, times of change); their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    row = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def kept(spark: SparkSession, name: str, paths: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """``build()``, written once in an application for the input files as they are and read by every later call.

    Changed, added or removed input files, another application or a cleared folder make it anew."""
    key = (spark.sparkContext.applicationId, name, *paths, *stamp(spark, paths))
    if key in _KEPT:
        path, schema = _KEPT[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:  # the folder was cleared
            del _KEPT[key]
    df = build()
    _KEPT[key] = (_write(df, name), df.schema)
    return spark.read.schema(df.schema).parquet(_KEPT[key][0])


def first_n(rows: DataFrame, by: list[str], order: list[tuple[str, bool]], n: str) -> DataFrame:
    """The first rows of each group, as many as its column ``n`` says (fewer where the group has fewer).

    ``order`` lists (column, descending) from coarse to fine; together they are unique in a group and none is null, nor is a key. Each
    level counts its values and orders those alone, and only what ties at the edge goes to the next level, so no task orders a group's rows."""
    edges, rest, left = None, rows, n
    for i, (c, descending) in enumerate(order):
        counts = rest.groupBy(*by, c).agg(F.count("*").alias("_c"), F.first(left).alias("_n"))
        w = Window.partitionBy(*by).orderBy(F.col(c).desc() if descending else F.col(c)).rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_upto", F.sum("_c").over(w)).where((F.col("_upto") - F.col("_c") < F.col("_n")) & (F.col("_n") <= F.col("_upto")))
        level = counts.select(*by, F.col(c).alias(f"_e{i}"), (F.col("_n") - F.col("_upto") + F.col("_c")).alias("_left"))
        edges = written(level if edges is None else edges.drop("_left").join(level, by), "edges")  # a row for each group; the next levels would make it anew, twice each
        rest, left = rows.join(edges, by), "_left"
        for j in range(i + 1):
            rest = rest.where(F.col(order[j][0]) == F.col(f"_e{j}"))
    inside = F.lit(True)
    for i, (c, descending) in reversed(list(enumerate(order))):
        edge = F.col(f"_e{i}")
        inside = (F.col(c) > edge if descending else F.col(c) < edge) | ((F.col(c) == edge) & inside)
    out = rows.join(edges, by, "left").where(F.coalesce(inside, F.col(n) > 0))
    return out.select(*rows.columns)


def placed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with their place (``place``, from 0) within each key ``by``, in the ascending order of columns that are unique with it; neither is null.

    Rows are ranged over tasks and written; a key that goes over several tasks gets its offsets from their counts, so no task orders a key's rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    lined = written(rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).withColumns({"_part": F.shiftright(at, 33), "_at": at}), "placed")
    starts = lined.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_held"))  # a row for each key and task
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0))).drop("_held")
    return lined.join(starts, [*by, "_part"]).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")
