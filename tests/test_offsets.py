"""Similar wells: the first of each well against all pairs, and how few pairs are handed on."""

import random

from pyspark.sql import functions as F

from borelog.functions import geo
from borelog.operators import joins, offsets, sequences

WELLS = "well_id long, family long, lat double, lon double, td double, formations array<string>"


def every_pair(left, right, radius, most, nearest_first=False):
    """The same from all pairs within the radius."""
    pairs = joins.within_radius(left, right, radius).where("family is null or family_o is null or family <> family_o")
    shared = geo.jaccard(F.col("formations"), F.col("formations_o"))
    sim = F.round(geo.similarity(F.col("distance"), shared, F.col("td"), F.col("td_o")), 4)
    rows = pairs.select("well_id", F.col("well_id_o").alias("offset_id"), "family", F.round("distance", 4).alias("distance"), F.round(shared, 6).alias("shared"), sim.alias("sim"))
    order = [F.col("sim").desc(), *([F.col("distance")] if nearest_first else []), F.col("offset_id")]
    return sequences.top_n(rows, most, ["well_id"], order)


def drawn(n, lat, lon, seed, names=30):
    draw = random.Random(seed)
    return [(i, draw.choice([None, i // 3]), draw.uniform(*lat), draw.uniform(*lon), draw.choice([None, 0.0, *[draw.uniform(500, 5000)] * 8]), draw.sample([f"L{k}" for k in range(names)], draw.randrange(0, 12))) for i in range(n)]


def same(spark, rows, radius, most, **more):
    df = spark.createDataFrame(rows, WELLS)
    found, wanted = (sorted(map(tuple, f(df, df, radius, most, **more).collect()), key=repr) for f in (offsets.similar, every_pair))
    assert found == wanted and found


def test_equal_to_all_pairs(spark):
    same(spark, drawn(500, (58.0, 58.4), (2.0, 2.6), 1), 10_000.0, 7)
    same(spark, drawn(300, (58.0, 58.4), (2.0, 2.6), 2, names=1500), 10_000.0, 5, nearest_first=True)


def test_across_the_date_line_the_poles_and_wide_radii(spark):
    same(spark, drawn(200, (-0.2, 0.2), (179.7, 180.0), 3) + [(1000 + i, f, a, -o, t, s) for i, f, a, o, t, s in drawn(200, (-0.2, 0.2), (179.7, 180.0), 4)], 30_000.0, 6)
    same(spark, drawn(200, (89.6, 90.0), (-180.0, 180.0), 5), 30_000.0, 6)
    same(spark, drawn(150, (-90.0, 90.0), (-180.0, 180.0), 6), 3_000_000.0, 6)


def test_equals_come_by_id_and_parts_see_all(spark, monkeypatch):
    rows = [(i, None, 58.0 + (i % 3) * 0.01, 2.0, 2000.0, ["a", "b"]) for i in range(400)]
    same(spark, rows, 10_000.0, 5)
    same(spark, rows, 10_000.0, 5, nearest_first=True)
    monkeypatch.setattr(offsets, "LEFT", 100)
    same(spark, rows + [(1000 + i, *r[1:]) for i, r in enumerate(drawn(300, (58.0, 58.1), (2.0, 2.1), 7))], 10_000.0, 5)


def test_pairs_handed_on_grow_with_the_wells(spark):
    """The pairs within the radius are a quarter of all; those that are ordered are few beside the first 10 of each well."""
    df = spark.createDataFrame(drawn(1200, (58.0, 58.15), (2.0, 2.3), 8), WELLS)
    assert joins.within_radius(df, df, 10_000.0).count() > 300_000
    assert offsets.close(df, df, 10_000.0, 10).count() < 1200 * 10 * 1.2


def test_one_place_does_not_gather_its_square(spark):
    df = spark.createDataFrame([(i, None, 58.0, 2.0, 2000.0, ["a"]) for i in range(3000)], WELLS)
    assert offsets.close(df, df, 10_000.0, 5).count() < 3000 * 5 * 4


def test_no_row_of_the_cube_is_shuffled(spark, sf_dir):
    from borelog.plans import hazards

    plan = hazards.cell_cube(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    laid = next(i for i, line in enumerate(plan) if "NestedLoopJoin" in line or "CartesianProduct" in line)
    assert not any("Exchange" in line or "SortMergeJoin" in line for line in plan[:laid])
    assert sum("BroadcastExchange" in line for line in plan) <= 8  # names of layers (three times), counts of a layer and source, kinds and their totals


def test_edges_of_first_n_are_made_once(spark):
    from borelog.operators.tables import first_n

    df = spark.range(50).select((F.col("id") % 3).alias("g"), (F.col("id") % 4).alias("a"), (F.col("id") % 5).alias("b"), "id", F.lit(7).alias("n"))
    out = first_n(df, ["g"], [("a", True), ("b", True), ("id", False)], "n")
    assert out.count() == 21 and out._jdf.queryExecution().analyzed().toString().count("Range (") <= 2
