"""Queries that judge, compare and complete records: reviews, audits, inferred columns, surfaces, replay scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from borelog.functions import geo, stats
from borelog.operators import joins, ranking, sequences
from borelog.operators.tables import first_n

from . import bindings as b
from . import hazards
from .records import WILSON

QUERIES, SQL = {}, {}


def query(name: str, *ctes: str, sql: str | None = None, more: dict[str, str] | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = b.sql(sql, *ctes, more=more)
        return f

    return add


BASE, CELLS = hazards.BASE, hazards.CTES


@query("review_replay", "event_all", more={
    "log": "SELECT user_id AS well_id, arg_max(event_type, ts) AS decision FROM events WHERE event_type IN ('purchase', 'signup', 'view') GROUP BY 1"},
    sql="""SELECT e.well_id, e.document_id, e.formation, e.md, e.day, CASE WHEN l.decision = 'view' THEN 'STANDARD' ELSE e.hazard END AS hazard, e.needs_review AND l.decision IS NULL AS needs_review,
    CASE l.decision WHEN 'purchase' THEN 'confirmed' WHEN 'view' THEN 'relabelled' END AS method FROM event_all e LEFT JOIN log l ON l.well_id = e.well_id AND e.needs_review WHERE l.decision IS DISTINCT FROM 'signup'""")
def review_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after the review log is replayed: the last decision for each key counts; a confirmed event is trusted, a rejected one goes, another is relabelled."""
    log = b.table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup", "view"))
    log = log.groupBy(F.col("user_id").alias("w")).agg(F.max_by("event_type", "ts").alias("decision"))
    rows = b.events(spark, sf_dir, trusted=False)
    rows = rows.join(log, (rows["well_id"] == log["w"]) & rows["needs_review"], "left").where(~F.col("decision").eqNullSafe("signup"))
    method = F.when(F.col("decision") == "purchase", "confirmed").when(F.col("decision") == "view", "relabelled")
    hazard = F.when(F.col("decision") == "view", "STANDARD").otherwise(F.col("hazard"))
    return rows.select("well_id", "document_id", "formation", "md", "day", hazard.alias("hazard"), (F.col("needs_review") & F.col("decision").isNull()).alias("needs_review"), method.alias("method"))


@query("verdict_counts", sql="SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("neighbour_count", "well", sql="""
SELECT a.well_id, count(*) AS neighbours FROM well a JOIN well c ON c.well_id <> a.well_id AND 2 * 6371008.8 * asin(sqrt(pow(sin(radians(c.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - a.lon) / 2), 2))) <= 5000 GROUP BY 1
""")
def neighbour_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = b.wells(spark, sf_dir).select("well_id", "lat", "lon")
    return joins.within_radius(w, w, 5000.0).groupBy("well_id").agg(F.count("*").alias("neighbours"))


@query("surface_corners", "well", more={
    "corner": "SELECT * FROM (VALUES (1, 58.0e0, 2.0e0), (2, 58.0e0, 4.0e0), (3, 59.0e0, 2.0e0), (4, 59.0e0, 4.0e0)) v(corner, lat0, lon0)",
    "d": "SELECT corner, td, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2))) AS d FROM well, corner"},
    sql="SELECT CAST(corner AS BIGINT) AS corner, round(CASE WHEN min(d) < 2 THEN arg_min(td, d) ELSE sum(td / (d * d)) / sum(1 / (d * d)) END, 2) AS depth FROM d GROUP BY 1")
def surface_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth at the four corners of the map, weighted by inverse squared distance; exact within two metres of a well."""
    corners = spark.createDataFrame([(1, 58.0, 2.0), (2, 58.0, 4.0), (3, 59.0, 2.0), (4, 59.0, 4.0)], "corner long, lat0 double, lon0 double")
    rows = b.wells(spark, sf_dir).select("td", "lat", "lon").crossJoin(F.broadcast(corners))  # the map's four corners
    rows = rows.withColumn("d", geo.haversine(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")))
    weight = F.when(F.col("d") > 0, 1 / (F.col("d") * F.col("d")))
    out = rows.groupBy("corner").agg(F.min("d").alias("near"), F.min_by("td", "d").alias("exact"), (F.sum(F.col("td") * weight) / F.sum(weight)).alias("mean"))
    return out.select("corner", F.round(F.when(F.col("near") < 2, F.col("exact")).otherwise(F.col("mean")), 2).alias("depth"))


@query("inferred_column", *BASE, more=CELLS, sql="SELECT o.well_id, t.formation, median(t.top) AS top, count(*) AS donors FROM offset_well o JOIN top t ON t.well_id = o.offset_id WHERE o.rank <= 3 GROUP BY 1, 2")
def inferred_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers a well may expect: median tops over its three most similar wells."""
    donors = hazards.well_offsets(spark, sf_dir).where("rank <= 3").select("well_id", "offset_id")
    tops = b.tops(spark, sf_dir).select(F.col("well_id").alias("offset_id"), "formation", "top")
    return donors.join(tops, "offset_id").groupBy("well_id", "formation").agg(F.median("top").alias("top"), F.count("*").alias("donors"))


@query("common_formations", "top", "well", sql="""
SELECT country, formation FROM top JOIN well USING (well_id) GROUP BY 1, 2
HAVING count(DISTINCT well_id) = (SELECT count(DISTINCT w.well_id) FROM well w JOIN top t ON t.well_id = w.well_id WHERE w.country = well.country)
""")
def common_formations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers that all wells of a country have."""
    tops = b.tops(spark, sf_dir)
    shown = tops.join(b.wells(spark, sf_dir).select("well_id", "country"), "well_id")
    every = shown.groupBy("country").agg(F.countDistinct("well_id").alias("n"))
    return shown.groupBy("country", "formation").agg(F.countDistinct("well_id").alias("k")).join(every, "country").where("k = n").select("country", "formation")


SCOPES = {
    "act": "SELECT *, unnest(action_types) AS action FROM episode WHERE outcome <> 'unknown'",
    "wanted": "SELECT DISTINCT formation, hazard FROM event_all",
    "c1": "SELECT formation, hazard, action, count(*) AS n, count_if(outcome = 'resolved') + 0.5e0 * count_if(outcome = 'partial') AS k FROM act WHERE quantity >= 48 GROUP BY 1, 2, 3",
    "c2": "SELECT hazard, action, count(*) AS n, count_if(outcome = 'resolved') + 0.5e0 * count_if(outcome = 'partial') AS k FROM act GROUP BY 1, 2",
    "u": "SELECT w.formation, w.hazard, 1 AS scope, action, n, k FROM wanted w JOIN c1 USING (formation, hazard) WHERE n >= 4 UNION ALL SELECT w.formation, w.hazard, 2, action, n, k FROM wanted w JOIN c2 USING (hazard)",
    "r": f"SELECT *, min(scope) OVER (PARTITION BY formation, hazard) AS best, row_number() OVER (PARTITION BY formation, hazard, scope ORDER BY round({WILSON.format(p='(k/n)', n='n')}, 6) DESC, n DESC, action) AS rank FROM u",
}


@query("fix_scope", "episode", "event_all", more=SCOPES, sql="SELECT formation, hazard, CAST(scope AS BIGINT) AS scope, rank, action, n FROM r WHERE scope = best AND rank <= 3")
def fix_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best fixes for each layer and problem: from the same layer where it has enough cases, else from the problem anywhere."""
    rows = b.episodes(spark, sf_dir).where("outcome <> 'unknown'").withColumn("action", F.explode("action_types"))
    wanted = b.events(spark, sf_dir, trusted=False).select("formation", "hazard").distinct()
    k = F.count_if(F.col("outcome") == "resolved") + 0.5 * F.count_if(F.col("outcome") == "partial")
    own = rows.where("quantity >= 48").groupBy("formation", "hazard", "action").agg(F.count("*").alias("n"), k.alias("k")).where("n >= 4")
    anywhere = rows.groupBy("hazard", "action").agg(F.count("*").alias("n"), k.alias("k"))
    cols = ["formation", "hazard", "scope", "action", "n", "k"]
    both = wanted.join(own, ["formation", "hazard"]).withColumn("scope", F.lit(1)).select(cols).unionByName(wanted.join(anywhere, "hazard").withColumn("scope", F.lit(2)).select(cols))
    both = both.withColumn("best", F.min("scope").over(Window.partitionBy("formation", "hazard"))).where("scope = best").withColumn("lb", F.round(stats.wilson_low(F.col("k"), F.col("n")), 6))
    out = sequences.top_n(both, 3, ["formation", "hazard"], [F.col("lb").desc(), F.col("n").desc(), F.col("action")])
    return out.select("formation", "hazard", F.col("scope").cast("long").alias("scope"), F.col("rank").cast("long").alias("rank"), "action", "n")


@query("depth_claims", "event", "top", sql="SELECT e.well_id, e.document_id, e.formation, e.hazard, e.md, e.day, round(e.md - t.top, 4) AS below_top, CASE WHEN e.md > t.base THEN 'R3_outside_layer' END AS rule FROM event e JOIN top t USING (well_id, formation)")
def depth_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's depth held against the top and base of the layer that it names."""
    tops = b.tops(spark, sf_dir).select("well_id", "formation", "top", "base")
    rows = b.events(spark, sf_dir).join(tops, ["well_id", "formation"])
    return rows.select("well_id", "document_id", "formation", "hazard", "md", "day", F.round(F.col("md") - F.col("top"), 4).alias("below_top"), F.when(F.col("md") > F.col("base"), "R3_outside_layer").alias("rule"))


@query("trust_share", "event", "line", more={"bad": "SELECT DISTINCT document_id FROM line WHERE seq = 4 AND discount >= 0.09"}, sql="SELECT hazard, count(*) AS refs, CAST(count(bad.document_id) AS BIGINT) AS in_conflict, round(1 - count(bad.document_id) / count(*), 6) AS trust FROM (SELECT DISTINCT hazard, document_id FROM event) e LEFT JOIN bad USING (document_id) GROUP BY 1")
def trust_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each problem's cited reports without an open conflict."""
    bad = b.lines(spark, sf_dir).where("seq = 4 and discount >= 0.09").select("document_id", F.lit(1).alias("bad")).distinct()
    rows = b.events(spark, sf_dir).select("hazard", "document_id").distinct().join(bad, "document_id", "left")
    return rows.groupBy("hazard").agg(F.count("*").alias("refs"), F.count("bad").alias("in_conflict"), F.round(1 - F.count("bad") / F.count("*"), 6).alias("trust"))


@query("brier", *BASE, more=CELLS, sql="SELECT source, count(*) AS n, round(avg(pow(mean - y, 2)), 8) AS model, round(avg(pow(base - y, 2)), 8) AS base, round(avg(CASE WHEN status = 'ok' THEN pow(mean - y, 2) END), 8) AS model_ok FROM flagged GROUP BY 1")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared error of the left-out posterior against the left-out base rate."""
    error = lambda c: F.pow(F.col(c) - F.col("y"), 2)
    return hazards.cells(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(error("mean")), 8).alias("model"), F.round(F.avg(error("base")), 8).alias("base"), F.round(F.avg(F.when(F.col("status") == "ok", error("mean"))), 8).alias("model_ok"))


@query("budget_curve", *BASE, more=CELLS | {
    "budget": "SELECT budget, CAST(round_even(budget * (SELECT count(DISTINCT well_id) FROM flagged), 0) AS BIGINT) AS k FROM (VALUES (1), (3), (6)) v(budget)",
    "s": "SELECT *, row_number() OVER (ORDER BY round(mean, 8) DESC, well_id, formation, hazard) AS r FROM flagged"},
    sql="SELECT CAST(budget AS BIGINT) AS budget, count(*) AS alerts, CAST(sum(y) AS BIGINT) AS hits, count(DISTINCT (well_id, formation)) AS layers FROM budget JOIN s ON s.r <= budget.k GROUP BY 1")
def budget_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a number of alerts for each well would have caught: the cells with the highest scores over all wells."""
    rows = hazards.cells(spark, sf_dir).select("well_id", "formation", F.concat_ws("\u0001", "formation", "hazard").alias("cell"), "y", F.round("mean", 8).alias("s"))
    total = rows.agg(F.countDistinct("well_id").alias("wells")).withColumn("budget", F.explode(F.array(*[F.lit(x) for x in (1, 3, 6)]))).select("budget", F.bround(F.col("budget") * F.col("wells")).cast("long").alias("k"))
    rows = rows.withColumn("band", F.floor(F.col("s") * 10_000)).crossJoin(F.broadcast(total))  # three rows
    held = first_n(rows, ["budget"], [("band", True), ("s", True), ("well_id", False), ("cell", False)], "k")
    layers = held.groupBy("budget", "well_id", "formation").agg(F.count("*").alias("a"), F.sum("y").alias("h"))
    return layers.groupBy(F.col("budget").cast("long").alias("budget")).agg(F.sum("a").alias("alerts"), F.sum("h").alias("hits"), F.count("*").alias("layers"))


@query("region_result", *BASE, more=CELLS | {
    "fc": """SELECT f.*, field, round(mean, 8) AS s, row_number() OVER (PARTITION BY f.well_id, formation ORDER BY round(mean, 8) DESC, hazard) AS place FROM flagged f JOIN well w ON w.well_id = f.well_id""",
    "ranked": """SELECT *, CAST(count_if(y = 1) OVER (PARTITION BY field) AS DOUBLE) AS n1, CAST(count_if(y = 0) OVER (PARTITION BY field) AS DOUBLE) AS n0,
        rank() OVER (PARTITION BY field ORDER BY s) + (count(*) OVER (PARTITION BY field, s) - 1) / 2 AS r FROM fc"""},
    sql="""SELECT field, count(DISTINCT well_id) AS wells, CAST(sum(y) AS BIGINT) AS events, CAST(count_if(flag) AS BIGINT) AS alerts, CAST(count_if(flag AND y = 1) AS BIGINT) AS hits, CAST(count_if(y = 1 AND place <= 3) AS BIGINT) AS top3,
    round((sum(r) FILTER (y = 1) - any_value(n1) * (any_value(n1) + 1) / 2) / nullif(any_value(n1) * any_value(n0), 0), 6) AS auc FROM ranked GROUP BY 1""")
def region_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's own blind result: wells, events, alerts, hits, problems among their layer's three likeliest, area under the ROC curve."""
    place = F.row_number().over(Window.partitionBy("well_id", "formation").orderBy(F.round("mean", 8).desc(), "hazard"))
    rows = hazards.cells(spark, sf_dir).select("well_id", "y", "flag", F.round("mean", 8).alias("s"), place.alias("place")).join(b.wells(spark, sf_dir).select("well_id", "field"), "well_id")
    hit = F.col("y") == 1
    each = rows.groupBy("well_id", "field").agg(F.sum("y").alias("e"), F.count_if("flag").alias("a"), F.count_if(F.col("flag") & hit).alias("h"), F.count_if(hit & (F.col("place") <= 3)).alias("t"))
    out = each.groupBy("field").agg(F.count("*").alias("wells"), F.sum("e").alias("events"), F.sum("a").alias("alerts"), F.sum("h").alias("hits"), F.sum("t").alias("top3"))
    return out.join(hazards.auc(rows, ["field"], "s", "y").select("field", F.round("auc", 6).alias("auc")), "field", "left")


@query("replay_auc_interval")
def replay_auc_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AUC's spread over 200 draws of wells: each well is drawn a Poisson number of times, from a hash, in each."""
    import numpy as np

    areas = ranking.auc_draws(hazards.cells(spark, sf_dir).select("well_id", "y", F.round("mean", 8).alias("s")), "well_id", "s", "y")
    areas = areas[~np.isnan(areas)]
    low, high = np.percentile(areas, [2.5, 97.5]).tolist() if len(areas) else (None, None)
    return spark.createDataFrame([(low, high, len(areas))], "auc_lo double, auc_hi double, draws long")


@query("high_spans", "sample", more={
    "f": "SELECT *, CASE WHEN value > 25 THEN 1 ELSE 0 END AS high FROM sample",
    "g": "SELECT *, sum(1 - high) OVER (PARTITION BY well_id ORDER BY t, event_id) AS grp FROM f"},
    sql="SELECT well_id, min(t) AS first_t, max(t) AS last_t, count(*) AS n, round(min(value - 25), 4) AS least, round(max(value - 25), 4) AS most FROM g WHERE high = 1 GROUP BY well_id, grp HAVING max(t) - min(t) >= INTERVAL 2 HOUR")
def high_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous spans above a limit that are long enough, with the least and most excess, as washouts are found in a caliper."""
    rows = b.samples(spark, sf_dir).withColumn("high", (F.col("value") > 25).cast("int"))
    rows = rows.withColumn("grp", F.sum(1 - F.col("high")).over(Window.partitionBy("well_id").orderBy("t", "event_id")))
    out = rows.where("high = 1").groupBy("well_id", "grp").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"), F.round(F.min(F.col("value") - 25), 4).alias("least"), F.round(F.max(F.col("value") - 25), 4).alias("most"))
    return out.where(F.col("last_t") - F.col("first_t") >= F.expr("INTERVAL 2 HOURS")).drop("grp")


@query("place_at_depth", "event", "line", more={
    "st": "SELECT DISTINCT well_id, CAST(50 * b + well_id % 40 AS DOUBLE) AS md, min(quantity) AS x FROM line GROUP BY well_id, b",
    "seg": "SELECT *, lead(md) OVER w AS md2, lead(x) OVER w AS x2 FROM st WINDOW w AS (PARTITION BY well_id ORDER BY md)",
    "ask": "SELECT DISTINCT well_id, md FROM event"},
    sql="SELECT ask.well_id, ask.md, round(CASE WHEN seg.md2 IS NULL THEN seg.x ELSE seg.x + (seg.x2 - seg.x) * (ask.md - seg.md) / (seg.md2 - seg.md) END, 6) AS x FROM ask ASOF JOIN seg ON ask.well_id = seg.well_id AND ask.md >= seg.md")
def place_at_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A survey's coordinate at each event's depth, linear between stations and flat beyond the last."""
    stations = b.lines(spark, sf_dir).groupBy("well_id", (50 * F.col("b") + F.col("well_id") % 40).cast("double").alias("at")).agg(F.min("quantity").alias("x"))
    w = Window.partitionBy("well_id").orderBy("at")
    stations = stations.select("well_id", "at", "x", F.lead("at").over(w).alias("at2"), F.lead("x").over(w).alias("x2"))
    rows = joins.as_of(b.events(spark, sf_dir).select("well_id", "md").distinct(), stations, ["well_id"], "md", "at", ["at", "x", "at2", "x2"])
    x = F.coalesce(F.col("x") + (F.col("x2") - F.col("x")) * (F.col("md") - F.col("at")) / (F.col("at2") - F.col("at")), F.col("x"))
    return rows.where("at is not null").select("well_id", "md", F.round(x, 6).alias("x"))


@query("subject_hazard", "event_all", sql="SELECT well_id, arg_max(hazard, (n, hazard)) AS hazard FROM (SELECT *, lead(n) OVER (PARTITION BY well_id ORDER BY n DESC, hazard DESC) AS second, row_number() OVER (PARTITION BY well_id ORDER BY n DESC, hazard DESC) AS r FROM (SELECT well_id, hazard, count(*) AS n FROM event_all GROUP BY 1, 2)) WHERE r = 1 AND n >= 2 AND n >= 2 * coalesce(second, 0) GROUP BY 1")
def subject_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a well's reports are about: mentioned at least twice, and twice as often as the next."""
    counts = b.events(spark, sf_dir, trusted=False).groupBy("well_id", "hazard").agg(F.count("*").alias("n"))
    w = Window.partitionBy("well_id").orderBy(F.col("n").desc(), F.col("hazard").desc())
    rows = counts.withColumn("r", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("n").over(w), F.lit(0)))
    return rows.where((F.col("r") == 1) & (F.col("n") >= 2) & (F.col("n") >= 2 * F.col("second"))).select("well_id", "hazard")


@query("question_sample", "event", sql="SELECT well_id, document_id, hazard, md FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY document_id * 7919 % 10007, document_id, hazard, md, formation) AS r FROM event) WHERE r = 1 ORDER BY well_id * 7919 % 10007, well_id LIMIT 25")
def question_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five questions, one for each of as many wells, in an order that a rule shuffles."""
    order = [F.col("document_id") * 7919 % 10007, F.col("document_id"), F.col("hazard"), F.col("md"), F.col("formation")]
    one = sequences.top_n(b.events(spark, sf_dir), 1, ["well_id"], order)
    return one.orderBy(F.col("well_id") * 7919 % 10007, "well_id").limit(25).select("well_id", "document_id", "hazard", "md")


@query("index_encoded_wells", "well", sql="SELECT well_id, dense_rank() OVER (ORDER BY country) - 1 AS country_i, dense_rank() OVER (ORDER BY field) - 1 AS field_i, round(lat, 5) AS lat, round(lon, 5) AS lon FROM well")
def index_encoded_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's payload: texts as places in the sorted lists of countries and fields."""
    from borelog.sources.files import compact_payload

    rows = compact_payload(b.wells(spark, sf_dir), ["country", "field"])
    return rows.select("well_id", F.col("country_i").cast("long").alias("country_i"), F.col("field_i").cast("long").alias("field_i"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))
