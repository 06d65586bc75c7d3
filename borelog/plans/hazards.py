"""Offset wells, base rates, posteriors, and their blind replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from borelog.functions import stats
from borelog.operators import offsets
from borelog.operators.ranking import auc
from borelog.operators.tables import first_n, kept, written

from . import bindings as b
from .records import WILSON

QUERIES, SQL = {}, {}
RADIUS_M, MOST_OFFSETS, STRENGTH, LEAST_WELLS, LEAST_EVIDENCE, RATIO = 10_000.0, 40, 100.0, 10, 3.0, 1.1
INPUTS = ("region", "nation", "customer", "part", "orders", "lineitem")


def query(name: str, *ctes: str, sql: str | None = None, more: dict[str, str] | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = b.sql(sql, *ctes, more=more)
        return f

    return add


BASE = ("well", "documented", "top", "event")
CTES = {
    "place": "SELECT w.well_id, w.lat, w.lon, w.td, w.family, w.source, list(t.formation) AS formations FROM well w JOIN documented USING (well_id) JOIN top t ON t.well_id = w.well_id GROUP BY ALL",
    "pair": """SELECT a.well_id, c.well_id AS offset_id, a.family, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(c.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - a.lon) / 2), 2))) AS distance,
        len(list_intersect(a.formations, c.formations)) / len(list_distinct(list_concat(a.formations, c.formations))) AS shared, least(a.td, c.td) / greatest(a.td, c.td) AS depth FROM place a JOIN place c ON a.family <> c.family""",
    "offset_well": """SELECT * FROM (SELECT well_id, offset_id, family, round(distance, 4) AS distance, round(shared, 6) AS shared, round(0.4e0 * exp(-distance / 5000) + 0.4e0 * shared + 0.2e0 * depth, 4) AS sim,
        row_number() OVER (PARTITION BY well_id ORDER BY round(0.4e0 * exp(-distance / 5000) + 0.4e0 * shared + 0.2e0 * depth, 4) DESC, offset_id) AS rank FROM pair WHERE distance <= 10000) WHERE rank <= 40""",
    "pen": "SELECT t.well_id, t.formation, p.source, p.family, t.top FROM top t JOIN place p USING (well_id)",
    "rec": "SELECT DISTINCT e.well_id, e.formation, e.hazard, p.source, p.family FROM event e JOIN place p USING (well_id)",
    "hz": "SELECT DISTINCT p_type AS hazard FROM part",
    "pen_n": "SELECT formation, source, count(DISTINCT well_id) AS n FROM pen GROUP BY 1, 2",
    "pen_f": "SELECT formation, source, family, count(DISTINCT well_id) AS n FROM pen GROUP BY 1, 2, 3",
    "rec_n": "SELECT formation, source, hazard, count(*) AS k FROM rec GROUP BY 1, 2, 3",
    "rec_f": "SELECT formation, source, hazard, family, count(*) AS k FROM rec GROUP BY 1, 2, 3, 4",
    "all_f": "SELECT family, count(*) AS n FROM pen GROUP BY 1",
    "hit_f": "SELECT family, hazard, count(*) AS k FROM rec GROUP BY 1, 2",
    "evidence": """SELECT o.well_id, p.formation, h.hazard, sum(o.sim) AS w, sum(o.sim * o.sim) AS w2, sum(CASE WHEN r.well_id IS NULL THEN 0 ELSE o.sim END) AS wy, count(*) AS n_wells, count(r.well_id) AS n_with
        FROM offset_well o JOIN pen mine ON mine.well_id = o.well_id JOIN pen p ON p.well_id = o.offset_id AND p.formation = mine.formation CROSS JOIN hz h
        LEFT JOIN rec r ON r.well_id = o.offset_id AND r.formation = p.formation AND r.hazard = h.hazard GROUP BY 1, 2, 3""",
    "cell": """SELECT e.well_id, e.formation, e.hazard, m.family, m.source, m.top, greatest(0, m.top - 150) AS alert_md, n_wells, n_with, base, (100 * base + wy) / (100 + w) AS mean, round(w * w / w2, 1) AS n_eff,
        CASE WHEN round(w * w / w2, 1) >= 3 THEN 'ok' ELSE 'insufficient_evidence' END AS status, CASE WHEN y.well_id IS NULL THEN 0 ELSE 1 END AS y,
        100 * base + wy AS a, 100 * (1 - base) + w - wy AS b FROM (
        SELECT e.*, CASE WHEN pn.n - coalesce(pf.n, 0) >= 10 THEN (coalesce(rn.k, 0) - coalesce(rf.k, 0) + 0.5e0) / (pn.n - coalesce(pf.n, 0) + 1)
               ELSE ((SELECT count(*) FROM rec r WHERE r.hazard = e.hazard) - coalesce(hf.k, 0) + 0.5e0) / ((SELECT count(*) FROM pen) - coalesce(af.n, 0) + 1) END AS base
        FROM evidence e JOIN pen mm ON mm.well_id = e.well_id AND mm.formation = e.formation
        LEFT JOIN pen_n pn ON pn.formation = e.formation AND pn.source = mm.source LEFT JOIN pen_f pf ON pf.formation = e.formation AND pf.source = mm.source AND pf.family = mm.family
        LEFT JOIN rec_n rn ON rn.formation = e.formation AND rn.source = mm.source AND rn.hazard = e.hazard LEFT JOIN rec_f rf ON rf.formation = e.formation AND rf.source = mm.source AND rf.hazard = e.hazard AND rf.family = mm.family
        LEFT JOIN all_f af ON af.family = mm.family LEFT JOIN hit_f hf ON hf.family = mm.family AND hf.hazard = e.hazard) e
        JOIN pen m ON m.well_id = e.well_id AND m.formation = e.formation LEFT JOIN rec y ON y.well_id = e.well_id AND y.formation = e.formation AND y.hazard = e.hazard""",
    "flagged": "SELECT *, status = 'ok' AND mean >= 1.1e0 * base AS flag FROM cell",
}


def places(spark: SparkSession, sf_dir: str, tops: DataFrame | None = None) -> DataFrame:
    """Documented wells with their set of layers."""
    sets = (b.tops(spark, sf_dir) if tops is None else tops).groupBy("well_id").agg(F.collect_set("formation").alias("formations"))
    wells = b.wells(spark, sf_dir).join(b.documented(spark, sf_dir), "well_id", "left_semi")
    return wells.join(sets, "well_id").select("well_id", "lat", "lon", "td", "family", "source", "formations")


def kept_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, "tops", [f"{sf_dir}/{t}.parquet" for t in INPUTS], lambda: b.tops(spark, sf_dir))


def kept_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, "places", [f"{sf_dir}/{t}.parquet" for t in INPUTS], lambda: places(spark, sf_dir, kept_tops(spark, sf_dir)))


def facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documented wells, their layers and their recorded problems, each computed once."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in INPUTS]
    tops, wells = kept_tops(spark, sf_dir), kept_places(spark, sf_dir)
    pen = kept(spark, "penetrations", inputs, lambda: penetrations(tops, wells))
    return wells, pen, kept(spark, "recorded", inputs, lambda: recorded(b.events(spark, sf_dir), wells))


def offset_wells(wells: DataFrame, radius: float = RADIUS_M, most: int = MOST_OFFSETS) -> DataFrame:
    """The most similar wells of other families within the radius, with the parts of the similarity. ``wells`` is read several times."""
    return offsets.similar(wells, wells, radius, most)


def well_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``offset_wells`` of the documented wells, computed by the first query of an application that reads them."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in INPUTS]
    return kept(spark, "offsets", inputs, lambda: offset_wells(kept_places(spark, sf_dir)))


@query("offsets_topk", *BASE, more={k: CTES[k] for k in ("place", "pair", "offset_well")}, sql="SELECT well_id, offset_id, distance, shared, sim, rank FROM offset_well")
def offsets_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return well_offsets(spark, sf_dir).select("well_id", "offset_id", "distance", "shared", "sim", F.col("rank").cast("long").alias("rank"))


def penetrations(tops: DataFrame, wells: DataFrame) -> DataFrame:
    """The layers that documented wells went through."""
    return tops.select("well_id", "formation", "top").join(wells.select("well_id", "source", "family").hint("merge"), "well_id")


def recorded(events: DataFrame, wells: DataFrame) -> DataFrame:
    """The problems that documented wells recorded, once for each layer."""
    return events.select("well_id", "formation", "hazard").distinct().join(wells.select("well_id", "source", "family").hint("merge"), "well_id")


def laplace(k: Column, n: Column) -> Column:
    return (k + 0.5) / (n + 1)


@query("base_rate", *BASE, more={k: CTES[k] for k in ("place", "pen", "rec", "hz", "pen_n", "rec_n")}, sql="""
SELECT formation, source, hazard, n, coalesce(k, 0) AS k, round(CASE WHEN n >= 10 THEN (coalesce(k, 0) + 0.5e0) / (n + 1) ELSE ((SELECT count(*) FROM rec r WHERE r.hazard = hz.hazard) + 0.5e0) / ((SELECT count(*) FROM pen) + 1) END, 8) AS base
FROM pen_n CROSS JOIN hz LEFT JOIN rec_n USING (formation, source, hazard)
""")
def base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded problems of each layer and source; below ten wells the problem's rate over all layers."""
    _, pen, rec = facts(spark, sf_dir)
    hazards = b.table(spark, sf_dir, "part").select(F.col("p_type").alias("hazard")).distinct()
    rows = pen.groupBy("formation", "source").agg(F.countDistinct("well_id").alias("n")).crossJoin(F.broadcast(hazards))  # a closed list of kinds
    rows = rows.join(rec.groupBy("formation", "source", "hazard").agg(F.count("*").alias("k")), ["formation", "source", "hazard"], "left")
    overall = rec.groupBy("hazard").agg(F.count("*").alias("all_k")).crossJoin(pen.agg(F.count("*").alias("all_n")))
    k = F.coalesce("k", F.lit(0))
    rows = rows.join(F.broadcast(overall), "hazard", "left")
    base = F.when(F.col("n") >= LEAST_WELLS, laplace(k, F.col("n"))).otherwise(laplace(F.coalesce("all_k", F.lit(0)), F.col("all_n")))
    return rows.select("formation", "source", "hazard", "n", k.alias("k"), F.round(base, 8).alias("base"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell_cube``, computed by the first query of an application that reads it and read by the others."""
    return kept(spark, "cells", [f"{sf_dir}/{t}.parquet" for t in INPUTS], lambda: cell_cube(spark, sf_dir))


def cell_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube of well, layer and problem, judged from other families' wells alone, with what was then recorded (y).

    Sums and counts are made for each well and layer, those by problem as maps of the few problems that were recorded; the problems
    of the closed list are laid beside at the end, so no row of the cube is shuffled. Layers are numbered, and an offset's go as one array."""
    _, pen, rec = facts(spark, sf_dir)
    near = well_offsets(spark, sf_dir).select("well_id", "offset_id", "sim")
    hazards = b.table(spark, sf_dir, "part").select(F.col("p_type").alias("hazard")).distinct()
    names = kept(spark, "layers", [f"{sf_dir}/{t}.parquet" for t in INPUTS], lambda: pen.select("formation").distinct().withColumn("n", F.row_number().over(Window.orderBy("formation"))))  # the names alone
    layer, found = ["well_id", "formation"], lambda rows, key: by_hazard(rows, key, F.count("*"))
    grown = lambda df, keys: df.hint("merge") if "family" in keys else df

    mine = pen.join(names, "formation")
    sets = mine.groupBy(F.col("well_id").alias("offset_id")).agg(F.collect_list("n").alias("ns"))
    had = rec.join(names, "formation").select(F.col("well_id").alias("offset_id"), "n", "hazard")
    # a well's rows come together once, as arrays; its sums are then made where they are
    reached = near.join(sets.hint("merge"), "offset_id").repartition("well_id").select("well_id", "sim", F.explode("ns").alias("n"))
    weights = reached.groupBy("well_id", "n").agg(F.sum("sim").alias("w"), F.sum(F.col("sim") * F.col("sim")).alias("w2"), F.count("*").alias("n_wells"))
    hits = by_hazard(near.join(had.hint("merge"), "offset_id").select("well_id", "n", "hazard", "sim"), ["well_id", "n"], F.struct(F.sum("sim").alias("wy"), F.count("*").alias("n_with")), "hits")
    # tables that grow with the wells are merged: small files of theirs would be broadcast, and fill the driver
    rows = mine.join(weights.hint("merge"), ["well_id", "n"]).join(hits.hint("merge"), ["well_id", "n"], "left").drop("n")
    rows = rows.join(found(rec, layer).withColumnRenamed("found", "seen").hint("merge"), layer, "left")
    # counts of all wells and of the own family, whose part is taken off
    spot = ["formation", "source"]
    for name, keys in (("p", spot), ("pf", [*spot, "family"]), ("af", ["family"])):
        rows = rows.join(grown(pen.groupBy(*keys).agg(F.count("*").alias(name)), keys), keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    for name, keys in (("r", spot), ("rf", [*spot, "family"]), ("hf", ["family"])):
        rows = rows.join(grown(found(rec, keys).withColumnRenamed("found", name), keys), keys, "left")
    overall = rec.groupBy("hazard").agg(F.count("*").alias("hn"))
    kinds = hazards.join(overall, "hazard", "left").crossJoin(pen.agg(F.count("*").alias("an")))
    rows = rows.crossJoin(F.broadcast(kinds))  # a closed list of kinds

    of = lambda c: F.coalesce(F.col(c)[F.col("hazard")], F.lit(0))
    rows = rows.withColumns({"wy": F.coalesce(F.col("hits")[F.col("hazard")]["wy"], F.lit(0.0)), "n_with": F.coalesce(F.col("hits")[F.col("hazard")]["n_with"], F.lit(0)), "y": F.least(of("seen"), F.lit(1)).cast("int")})
    n = F.col("p") - F.col("pf")
    base = F.when(n >= LEAST_WELLS, laplace(of("r") - of("rf"), n)).otherwise(laplace(F.coalesce("hn", F.lit(0)) - of("hf"), F.col("an") - F.col("af")))
    rows = rows.withColumn("base", base).withColumn("a", STRENGTH * F.col("base") + F.col("wy")).withColumn("b", STRENGTH * (1 - F.col("base")) + F.col("w") - F.col("wy"))
    rows = rows.withColumn("mean", F.col("a") / (STRENGTH + F.col("w"))).withColumn("n_eff", F.round(F.col("w") * F.col("w") / F.col("w2"), 1))
    status = F.when(F.col("n_eff") >= LEAST_EVIDENCE, "ok").otherwise("insufficient_evidence")
    rows = rows.withColumn("status", status).withColumn("alert_md", F.greatest(F.lit(0.0), F.col("top") - 150))
    return rows.select("well_id", "formation", "hazard", "family", "source", "top", "alert_md", "n_wells", "n_with", "base", "mean", "n_eff", "status", "y", "a", "b").withColumn("flag", (F.col("status") == "ok") & (F.col("mean") >= RATIO * F.col("base")))


def by_hazard(rows: DataFrame, key: list[str], value: Column, name: str = "found") -> DataFrame:
    """(key, name): ``value`` over the rows of each problem that a key has, as a map; rows without a problem's name are met by none."""
    each = rows.where("hazard is not null").groupBy(*key, "hazard").agg(value.alias("_v"))
    return each.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("hazard", "_v"))).alias(name))


@query("blind_cells", *BASE, more=CTES, sql="SELECT well_id, formation, hazard, round(alert_md, 4) AS alert_md, n_wells, n_with, round(base, 8) AS base, round(mean, 8) AS mean, n_eff, status, y, flag FROM flagged")
def blind_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("well_id", "formation", "hazard", F.round("alert_md", 4).alias("alert_md"), "n_wells", "n_with", F.round("base", 8).alias("base"), F.round("mean", 8).alias("mean"), "n_eff", "status", "y", "flag")


@query("hazard_posterior", *BASE, more=CTES, sql="SELECT formation, hazard, count(*) AS cells, round(avg(base), 8) AS base, round(avg(mean), 8) AS mean, round(avg(n_eff), 4) AS n_eff, CAST(count_if(status = 'ok') AS BIGINT) AS ok FROM flagged GROUP BY 1, 2")
def hazard_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("formation", "hazard").agg(F.count("*").alias("cells"), F.round(F.avg("base"), 8).alias("base"), F.round(F.avg("mean"), 8).alias("mean"), F.round(F.avg("n_eff"), 4).alias("n_eff"), F.count_if(F.col("status") == "ok").alias("ok"))


@query("hazard_posterior_ci")
def hazard_posterior_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 80 % credible interval of each cell, and whether it lies above the base rate."""
    rows = cells(spark, sf_dir)
    rows = rows.withColumn("ci_lo", stats.beta_quantile(0.1, F.col("a"), F.col("b"))).withColumn("ci_hi", stats.beta_quantile(0.9, F.col("a"), F.col("b")))
    elevated = (F.col("status") == "ok") & (F.col("ci_lo") > F.col("base")) & (F.col("mean") >= 2 * F.col("base"))
    return rows.select("well_id", "formation", "hazard", "mean", "ci_lo", "ci_hi", elevated.alias("elevated"))


def interval_sql(k: str, n: str, side: str) -> str:
    e = WILSON.format(p=f"({k} / {n})", n=n)
    e, none = (e, 0) if side == "low" else (e.replace("- 1.96*sqrt", "+ 1.96*sqrt"), 1)
    return f"CASE WHEN {n} > 0 THEN least(1, greatest(0, {e})) ELSE {none} END"


def lift_sql(source: str) -> str:
    """Rates of both sides and their ratio, from ``source`` with nf, nu, kf, ku."""
    f_lo, f_hi, u_lo, u_hi = (f"round({interval_sql(k, n, side)}, 8)" for k, n in (("kf", "nf"), ("ku", "nu")) for side in ("low", "high"))
    return f"""
SELECT source, nf AS n_flagged, nu AS n_rest, CAST(kf AS BIGINT) AS k_flagged, CAST(ku AS BIGINT) AS k_rest, round(rf, 8) AS rate_flagged, round(ru, 8) AS rate_rest, round(rf / nullif(ru, 0), 6) AS lift, round(f_lo, 6) AS flagged_lo, round(f_hi, 6) AS flagged_hi,
  round(u_lo, 6) AS rest_lo, round(u_hi, 6) AS rest_hi, round(lo, 3) AS ratio_lo, round(hi, 3) AS ratio_hi,
  CASE WHEN nf = 0 OR ku = 0 OR lo IS NULL OR round(lo, 3) <= 1 AND round(hi, 3) >= 1 OR abs(rf / ru - 1) < 0.1e0 THEN 'no measured lift' ELSE 'lift' END AS verdict
FROM (SELECT *, CASE WHEN nf > 0 AND u_lo > 0 THEN f_lo / u_hi END AS lo, CASE WHEN nf > 0 AND u_lo > 0 THEN f_hi / u_lo END AS hi FROM (
  SELECT *, kf / nullif(nf, 0) AS rf, ku / nullif(nu, 0) AS ru, {f_lo} AS f_lo, {f_hi} AS f_hi, {u_lo} AS u_lo, {u_hi} AS u_hi FROM ({source})))
"""


SIDES = "count(*) FILTER (flag) AS nf, count(*) FILTER (NOT flag) AS nu, CAST(count(*) FILTER (flag AND y = 1) AS DOUBLE) AS kf, CAST(count(*) FILTER (NOT flag AND y = 1) AS DOUBLE) AS ku"


def lift(rows: DataFrame) -> DataFrame:
    """From counts nf, kf (flagged cells, those with a problem), nu, ku (the rest): rates, Wilson's intervals, their ratio with its interval, and whether any lift was measured."""
    rf, ru = (F.when(F.col(n) > 0, F.col(k) / F.col(n)) for k, n in (("kf", "nf"), ("ku", "nu")))
    (f_lo, f_hi), (u_lo, u_hi) = (tuple(F.round(x, 8) for x in stats.wilson_interval(F.col(k), F.col(n))) for k, n in (("kf", "nf"), ("ku", "nu")))
    bounded = (F.col("nf") > 0) & (u_lo > 0)
    lo, hi = F.round(F.when(bounded, f_lo / u_hi), 3), F.round(F.when(bounded, f_hi / u_lo), 3)
    none = (F.col("nf") == 0) | (F.col("ku") == 0) | lo.isNull() | ((lo <= 1) & (hi >= 1)) | F.coalesce(F.abs(rf / ru - 1) < 0.1, F.lit(False))
    return rows.select(
        "source", F.col("nf").alias("n_flagged"), F.col("nu").alias("n_rest"), F.col("kf").alias("k_flagged"), F.col("ku").alias("k_rest"), F.round(rf, 8).alias("rate_flagged"), F.round(ru, 8).alias("rate_rest"),
        F.round(F.when(ru > 0, rf / ru), 6).alias("lift"), F.round(f_lo, 6).alias("flagged_lo"), F.round(f_hi, 6).alias("flagged_hi"), F.round(u_lo, 6).alias("rest_lo"), F.round(u_hi, 6).alias("rest_hi"),
        lo.alias("ratio_lo"), hi.alias("ratio_hi"), F.when(none, "no measured lift").otherwise("lift").alias("verdict"),
    )


@query("lift_report", *BASE, more=CTES, sql=lift_sql(f"SELECT coalesce(source, 'all') AS source, {SIDES} FROM flagged GROUP BY GROUPING SETS ((source), ())"))
def lift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more often problems were recorded where the replay had warned, by source and in all."""
    rows = cells(spark, sf_dir).rollup("source").agg(F.count_if("flag").alias("nf"), F.count_if(~F.col("flag")).alias("nu"), F.count_if(F.col("flag") & (F.col("y") == 1)).alias("kf"), F.count_if(~F.col("flag") & (F.col("y") == 1)).alias("ku"))
    return lift(rows.withColumn("source", F.coalesce("source", F.lit("all"))))


@query("fair_baseline", *BASE, more=CTES, sql=lift_sql(f"""SELECT source, {SIDES} FROM (SELECT source, y, row_number() OVER (PARTITION BY source ORDER BY round(base, 8) DESC, well_id, formation, hazard) <= count_if(flag) OVER (PARTITION BY source) AS flag FROM flagged) GROUP BY source"""))
def fair_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report for a rule that flags as many cells as the replay did, those with the highest base rates."""
    rows = cells(spark, sf_dir).select("source", "well_id", F.concat_ws("\u0001", "formation", "hazard").alias("cell"), "y", "flag", F.round("base", 8).alias("s"))
    totals = rows.groupBy("source").agg(F.count_if("flag").alias("nf"), F.count("*").alias("n"), F.sum("y").alias("k"))
    rows = rows.join(F.broadcast(totals.select("source", "nf")), "source").withColumn("band", F.floor(F.col("s") * 10_000))  # a row for each source
    picked = first_n(rows, ["source"], [("band", True), ("s", True), ("well_id", False), ("cell", False)], "nf").groupBy("source").agg(F.sum("y").alias("kf"))
    out = totals.join(picked, "source", "left").withColumn("kf", F.coalesce("kf", F.lit(0)))
    return lift(out.select("source", "nf", (F.col("n") - F.col("nf")).alias("nu"), "kf", (F.col("k") - F.col("kf")).alias("ku")))


@query("watchlist", *BASE, more=CTES, sql=f"""
SELECT k, CAST(events AS BIGINT) AS events, CAST(hits AS BIGINT) AS hits, round({interval_sql('hits', 'events', 'low')}, 6) AS hits_lo, round({interval_sql('hits', 'events', 'high')}, 6) AS hits_hi, CAST(base_hits AS BIGINT) AS base_hits, CAST(cells AS BIGINT) AS cells, round(chance, 6) AS chance
FROM (SELECT k, CAST(sum(ev) AS DOUBLE) AS events, CAST(sum(hit) AS DOUBLE) AS hits, sum(base_hit) AS base_hits, sum(n) AS cells, sum(chance) AS chance FROM (
  SELECT k, well_id, sum(y) AS ev, sum(CASE WHEN r <= k THEN y ELSE 0 END) AS hit, sum(CASE WHEN q <= k THEN y ELSE 0 END) AS base_hit, sum(CASE WHEN r <= k THEN 1 ELSE 0 END) AS n, sum(y) * least(1, k / count(*)) AS chance
  FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY round(mean, 8) DESC, formation, hazard) AS r, row_number() OVER (PARTITION BY well_id ORDER BY round(base, 8) DESC, formation, hazard) AS q FROM flagged), (VALUES (3), (5), (10)) v(k) GROUP BY 1, 2) GROUP BY k)
""")
def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems that each well's list of k most likely cells would have held, with Wilson's interval of their share, against lists by base rate and lists drawn by chance."""
    r, q = (F.row_number().over(Window.partitionBy("well_id").orderBy(F.round(c, 8).desc(), "formation", "hazard")) for c in ("mean", "base"))
    rows = cells(spark, sf_dir).select("well_id", "y", r.alias("r"), q.alias("q")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (3, 5, 10)])))
    on = lambda c: F.sum(F.when(F.col(c) <= F.col("k"), F.col("y")).otherwise(0))
    each = rows.groupBy("k", "well_id").agg(F.sum("y").alias("ev"), on("r").alias("hit"), on("q").alias("base_hit"), F.count_if(F.col("r") <= F.col("k")).alias("n"), (F.sum("y") * F.least(F.lit(1.0), F.first("k") / F.count("*"))).alias("chance"))
    out = each.groupBy("k").agg(F.sum("ev").alias("events"), F.sum("hit").alias("hits"), F.sum("base_hit").alias("base_hits"), F.sum("n").alias("cells"), F.round(F.sum("chance"), 6).alias("chance"))
    low, high = stats.wilson_interval(F.col("hits"), F.col("events"))
    return out.select("k", "events", "hits", F.round(low, 6).alias("hits_lo"), F.round(high, 6).alias("hits_hi"), "base_hits", "cells", "chance")


@query("operating_points", *BASE, more=CTES, sql="""
SELECT threshold, CAST(count(*) FILTER (status = 'ok' AND mean >= threshold) AS BIGINT) AS alerts, CAST(count(*) FILTER (status = 'ok' AND mean >= threshold AND y = 1) AS BIGINT) AS hits, count(DISTINCT (well_id, formation)) FILTER (status = 'ok' AND mean >= threshold) AS layers
FROM flagged, (VALUES (0.4e0), (0.1e0), (0.05e0), (0.02e0), (0.01e0)) v(threshold) GROUP BY 1
""")
def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = (F.col("status") == "ok") & (F.col("mean") >= F.col("threshold"))
    rows = cells(spark, sf_dir).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.4, 0.1, 0.05, 0.02, 0.01)])))
    layers = rows.groupBy("threshold", "well_id", "formation").agg(F.count_if(on).alias("a"), F.count_if(on & (F.col("y") == 1)).alias("h"))
    return layers.groupBy("threshold").agg(F.sum("a").alias("alerts"), F.sum("h").alias("hits"), F.count_if(F.col("a") > 0).alias("layers"))


@query("right_hazard_topk", *BASE, more=CTES, sql="""
SELECT k, CAST(count(*) FILTER (r <= k) AS BIGINT) AS hits, count(*) AS events FROM (SELECT *, row_number() OVER (PARTITION BY well_id, formation ORDER BY round(mean, 8) DESC, hazard) AS r FROM flagged), (VALUES (1), (2), (3)) v(k) WHERE y = 1 GROUP BY k
""")
def right_hazard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("well_id", "formation").orderBy(F.round("mean", 8).desc(), "hazard")
    rows = cells(spark, sf_dir).withColumn("r", F.row_number().over(order)).where("y = 1").withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])))
    return rows.groupBy("k").agg(F.count_if(F.col("r") <= F.col("k")).alias("hits"), F.count("*").alias("events"))


@query("layer_context", *BASE, more=CTES, sql="""
SELECT well_id, formation, hazard, round(coalesce(lag(mean) OVER w / nullif(lag(base) OVER w, 0), -1), 6) AS above, round(coalesce(lead(mean) OVER w / nullif(lead(base) OVER w, 0), -1), 6) AS below,
  row_number() OVER (PARTITION BY well_id, formation ORDER BY round(mean, 8) DESC, hazard) - 1 AS rank_in_layer, round(mean / sum(mean) OVER (PARTITION BY well_id, formation), 6) AS share
FROM flagged WINDOW w AS (PARTITION BY well_id, hazard ORDER BY top)
""")
def layer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, layer = Window.partitionBy("well_id", "hazard").orderBy("top"), Window.partitionBy("well_id", "formation")
    ratio = F.col("mean") / F.col("base")
    rank = F.row_number().over(layer.orderBy(F.round("mean", 8).desc(), "hazard")) - 1
    rows = cells(spark, sf_dir).withColumn("ratio", ratio)
    return rows.select("well_id", "formation", "hazard", *[F.round(F.coalesce(f("ratio").over(order), F.lit(-1.0)), 6).alias(n) for n, f in (("above", F.lag), ("below", F.lead))], rank.cast("long").alias("rank_in_layer"), F.round(F.col("mean") / F.sum("mean").over(layer), 6).alias("share"))


@query("causal_features", *BASE, more=CTES, sql="""
SELECT c.well_id, c.formation, c.hazard, count(e.md) AS own_events, count(e.md) FILTER (e.hazard = c.hazard) AS own_same, round(ln(1 + least(100000, coalesce(c.alert_md - max(e.md), 100000))), 6) AS log_gap
FROM flagged c LEFT JOIN event e ON e.well_id = c.well_id AND e.md < c.alert_md GROUP BY c.well_id, c.formation, c.hazard, c.alert_md
""")
def causal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The well's own records above each alert point: only what was known by then."""
    rows = own_records(cells(spark, sf_dir).select("well_id", "formation", "hazard", "alert_md"), b.events(spark, sf_dir).select("well_id", "hazard", "md"))
    return rows.select("well_id", "formation", "hazard", "own_events", "own_same", F.round("log_gap", 6).alias("log_gap"))


def own_records(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Cells (well_id, formation, hazard, alert_md) with the number of the well's events (well_id, hazard, md) above the alert point, those of the same problem, and the log of the metres to the nearest above.

    Events and alert points of a well, and of a well and problem, are one ordered stream each, points before events at
    the same depth; no cell meets an event by itself."""
    points = rows.select("well_id", F.col("alert_md").cast("double").alias("at"), F.lit(0).alias("event")).distinct()
    every = events.select("well_id", F.col("md").cast("double").alias("at"), F.lit(1).alias("event"))
    above = Window.partitionBy("well_id").orderBy("at", "event").rowsBetween(Window.unboundedPreceding, -1)
    near = points.unionByName(every).withColumns({"own_events": F.coalesce(F.sum("event").over(above), F.lit(0)), "deepest": F.max(F.when(F.col("event") == 1, F.col("at"))).over(above)}).where("event = 0").drop("event")
    mine = rows.select("well_id", "hazard", F.col("alert_md").cast("double").alias("at"), F.lit(0).alias("event"), "formation")
    theirs = events.select("well_id", "hazard", F.col("md").cast("double").alias("at"), F.lit(1).alias("event"), F.lit(None).cast("string").alias("formation"))
    same = Window.partitionBy("well_id", "hazard").orderBy("at", "event").rowsBetween(Window.unboundedPreceding, -1)
    counted = mine.unionByName(theirs).withColumn("own_same", F.coalesce(F.sum("event").over(same), F.lit(0))).where("event = 0").drop("event")
    gap = F.least(F.lit(100000.0), F.coalesce(F.col("at") - F.col("deepest"), F.lit(100000.0)))
    return counted.join(near, ["well_id", "at"]).select("well_id", "formation", "hazard", "own_events", "own_same", F.log1p(gap).alias("log_gap"))


@query("replay_auc", *BASE, more=CTES, sql="""
SELECT source, round((sum(r) FILTER (y = 1) - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0), 6) AS auc, CAST(n1 AS BIGINT) AS n_positive FROM (
  SELECT source, y, CAST(count_if(y = 1) OVER (PARTITION BY source) AS DOUBLE) AS n1, CAST(count_if(y = 0) OVER (PARTITION BY source) AS DOUBLE) AS n0,
    rank() OVER (PARTITION BY source ORDER BY s) + (count(*) OVER (PARTITION BY source, s) - 1) / 2 AS r FROM (SELECT *, round(mean, 8) AS s FROM flagged)) GROUP BY source, n1, n0
""")
def replay_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auc(cells(spark, sf_dir).withColumn("s", F.round("mean", 8)), ["source"], "s", "y").select("source", F.round("auc", 6).alias("auc"), "n_positive")


@query("alert_lead", *BASE, more=CTES, sql="""
SELECT hazard, count(*) AS events, CAST(count(*) FILTER (flag) AS BIGINT) AS forewarned, round(median(CASE WHEN flag THEN md - alert_md END), 4) AS median_lead
FROM (SELECT DISTINCT e.well_id, e.formation, e.hazard, e.md, f.flag, f.alert_md FROM event e JOIN flagged f USING (well_id, formation, hazard)) GROUP BY 1
""")
def alert_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["well_id", "formation", "hazard"]
    rows = b.events(spark, sf_dir).select(*key, "md").distinct().join(cells(spark, sf_dir).select(*key, "flag", "alert_md"), key)
    return rows.groupBy("hazard").agg(F.count("*").alias("events"), F.count_if("flag").alias("forewarned"), F.round(F.median(F.when(F.col("flag"), F.col("md") - F.col("alert_md"))), 4).alias("median_lead"))


@query("model_regions", *BASE, more=CTES | {
    "n": "SELECT source, count(DISTINCT well_id) AS wells, count(*) AS cells FROM flagged GROUP BY 1",
    "big": "SELECT source FROM n WHERE wells >= 30 ORDER BY cells DESC, source LIMIT 1"},
    sql="SELECT source, wells, cells, CASE WHEN wells >= 30 THEN source ELSE coalesce((SELECT source FROM big), 'other') END AS region FROM n")
def model_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(cells(spark, sf_dir), "source")


def regions(rows: DataFrame, by: str, least: int = 30) -> DataFrame:
    """Which model each source's cells belong to: its own, or, below ``least`` wells, that of the source with the most cells."""
    counts = rows.groupBy(by, "well_id").agg(F.count("*").alias("c")).groupBy(by).agg(F.count("*").alias("wells"), F.sum("c").alias("cells"))
    large = F.struct((-F.col("cells")).alias("c"), F.col(by).alias("s"))
    target = counts.agg(F.min(F.when(F.col("wells") >= least, large)).alias("t")).select(F.coalesce("t.s", F.lit("other")).alias("_t"))
    return counts.crossJoin(F.broadcast(target)).select(by, "wells", "cells", F.when(F.col("wells") >= least, F.col(by)).otherwise(F.col("_t")).alias("region"))  # one row


@query("correlation_section", *BASE, more={k: CTES[k] for k in ("place", "pair", "offset_well")} | {
    "shown": "SELECT well_id, offset_id AS shown_id, rank FROM offset_well WHERE rank < 6 UNION ALL SELECT well_id, well_id, 0 FROM place"},
    sql="""SELECT s.well_id, shown_id, CAST(rank AS BIGINT) AS rank, 'top' AS kind, formation AS name, round(top, 4) AS md FROM shown s JOIN top t ON t.well_id = shown_id
    UNION ALL SELECT s.well_id, shown_id, CAST(rank AS BIGINT), 'event', hazard, round(md, 4) FROM shown s JOIN event e ON e.well_id = shown_id""")
def correlation_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section(well_offsets(spark, sf_dir), kept_places(spark, sf_dir), kept_tops(spark, sf_dir), b.events(spark, sf_dir))


def section(near: DataFrame, wells: DataFrame, tops: DataFrame, events: DataFrame, n: int = 6) -> DataFrame:
    """Each well beside its n - 1 most similar offsets (rank 0 is the well itself), with tops and events by depth."""
    shown = near.where(F.col("rank") < n).select("well_id", F.col("offset_id").alias("shown_id"), F.col("rank").cast("long").alias("rank"))
    shown = shown.unionByName(wells.select("well_id", F.col("well_id").alias("shown_id"), F.lit(0).cast("long").alias("rank")))
    marks = tops.select(F.col("well_id").alias("shown_id"), F.lit("top").alias("kind"), F.col("formation").alias("name"), F.round("top", 4).alias("md"))
    marks = marks.unionByName(events.select(F.col("well_id").alias("shown_id"), F.lit("event").alias("kind"), F.col("hazard").alias("name"), F.round(F.col("md").cast("double"), 4).alias("md")))
    return shown.join(marks, "shown_id").select("well_id", "shown_id", "rank", "kind", "name", "md")


@query("ranker_cv")
def ranker_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boosted-tree ranker over the cells, cross-validated by family: held-out scores of three folds, every cell once."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = cells(spark, sf_dir).withColumn("fold", F.pmod(F.xxhash64("family"), F.lit(3)))
    numbers = ["mean", "base", "n_eff", "n_wells", "n_with", "top"]
    out = None
    for fold in range(3):
        names = StringIndexer(inputCols=["hazard", "source"], outputCols=["hazard_i", "source_i"], handleInvalid="keep")
        vector = VectorAssembler(inputCols=[*numbers, "hazard_i", "source_i"], outputCol="features")
        model = Pipeline(stages=[names, vector, GBTClassifier(labelCol="y", maxIter=5, maxDepth=3, seed=1)]).fit(rows.where(F.col("fold") != fold))
        scored = model.transform(rows.where(F.col("fold") == fold)).select("well_id", "formation", "hazard", "y", "fold", vector_to_array("probability")[1].alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out
