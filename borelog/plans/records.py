"""Queries over wells, reports, events and episodes: filters, joins, counts, ledger, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from borelog.functions import stats
from borelog.operators import joins, sequences

from . import bindings as b

QUERIES, SQL = {}, {}


def query(name: str, *ctes: str, sql: str | None = None, more: dict[str, str] | None = None, recursive: bool = False):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = b.sql(sql, *ctes, more=more, recursive=recursive)
        return f

    return add


WILSON = "({p} + 1.96*1.96/(2*{n}) - 1.96*sqrt({p}*(1-{p})/{n} + 1.96*1.96/(4e0*{n}*{n})))/(1 + 1.96*1.96/{n})"


@query("ledger_by_action", "episode", sql=f"""
SELECT action, n, round(k, 6) AS k, round(k / n, 6) AS rate, round({WILSON.format(p='(k/n)', n='n')}, 6) AS wilson_lb, n_resolved, n_partial, n_unresolved, n_worsened, n_unknown,
       median_hours, n < 3 AS anecdotal
FROM (SELECT action, count(*) AS n, count_if(outcome = 'resolved') + 0.5e0 * count_if(outcome = 'partial') AS k, CAST(count_if(outcome = 'resolved') AS BIGINT) AS n_resolved,
      CAST(count_if(outcome = 'partial') AS BIGINT) AS n_partial, CAST(count_if(outcome = 'unresolved') AS BIGINT) AS n_unresolved, CAST(count_if(outcome = 'worsened') AS BIGINT) AS n_worsened,
      CAST(count_if(outcome = 'unknown') AS BIGINT) AS n_unknown, median(hours) AS median_hours
      FROM (SELECT *, unnest(action_types) AS action FROM episode) GROUP BY action)
""")
def ledger_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(b.episodes(spark, sf_dir))


def ledger(episodes: DataFrame) -> DataFrame:
    """What each action led to: counts, Wilson's lower bound (a partial success counts half), median hours; best first."""
    rows = episodes.withColumn("action", F.explode("action_types"))
    counts = {f"n_{o}": F.count_if(F.col("outcome") == o) for o in ("resolved", "partial", "unresolved", "worsened", "unknown")}
    out = rows.groupBy("action").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in counts.items()], F.median("hours").alias("median_hours"))
    k, n = F.col("n_resolved") + 0.5 * F.col("n_partial"), F.col("n")
    out = out.select("action", "n", F.round(k, 6).alias("k"), F.round(k / n, 6).alias("rate"), F.round(stats.wilson_low(k, n), 6).alias("wilson_lb"), *counts, "median_hours", (n < 3).alias("anecdotal"))
    return out.orderBy(F.col("wilson_lb").desc_nulls_last(), F.col("n").desc(), "action")


@query("country_counts", "well", "documented", "event", "episode", sql="""
SELECT country, count(*) AS wells, CAST(count(d.well_id) AS BIGINT) AS documented, CAST(coalesce(sum(e.n), 0) AS BIGINT) AS events, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS episodes, CAST(coalesce(sum(o.n), 0) AS BIGINT) AS reports
FROM well LEFT JOIN documented d USING (well_id) LEFT JOIN (SELECT well_id, count(*) AS n FROM event GROUP BY 1) e USING (well_id)
LEFT JOIN (SELECT well_id, count(*) AS n FROM episode GROUP BY 1) p USING (well_id) LEFT JOIN (SELECT o_custkey AS well_id, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1) o USING (well_id)
GROUP BY country
""")
def country_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wells = b.wells(spark, sf_dir).select("well_id", "country")
    per = lambda df, name: df.groupBy("well_id").agg(F.count("*").alias(name))
    reports = b.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("well_id")).agg(F.countDistinct("o_orderkey").alias("reports"))
    rows = wells.join(b.documented(spark, sf_dir).withColumn("documented", F.lit(1)), "well_id", "left")
    for side in (per(b.events(spark, sf_dir), "events"), per(b.episodes(spark, sf_dir), "episodes"), reports):
        rows = rows.join(side, "well_id", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("documented", "events", "episodes", "reports")]
    return rows.groupBy("country").agg(F.count("*").alias("wells"), *sums).orderBy(F.col("country") != "INDIA", F.col("events").desc(), F.col("wells").desc())


@query("well_search", "well", "documented", sql="""
SELECT well_id, name, country, round(lat, 6) AS lat, round(lon, 6) AS lon FROM well JOIN documented USING (well_id)
WHERE name ILIKE '%1%' AND lat BETWEEN 58.2 AND 58.8 AND lon BETWEEN 2 AND 3.5 AND (source IS NULL OR source NOT IN ('MACHINERY', 'FURNITURE'))
""")
def well_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    wells = b.wells(spark, sf_dir).where(F.col("name").ilike("%1%") & F.col("lat").between(58.2, 58.8) & F.col("lon").between(2, 3.5))
    kept = wells.where(F.col("source").isNull() | ~F.col("source").isin("MACHINERY", "FURNITURE")).join(b.documented(spark, sf_dir), "well_id", "left_semi")
    return kept.select("well_id", "name", "country", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("event_filter", "event", "well", sql="SELECT well_id, name, formation, hazard, md, day FROM event JOIN well USING (well_id) WHERE hazard IN ('PROMO', 'LARGE') AND formation BETWEEN 'Brand#1' AND 'Brand#2' AND country IS NOT NULL")
def event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.events(spark, sf_dir).where(F.col("hazard").isin("PROMO", "LARGE") & F.col("formation").between("Brand#1", "Brand#2"))
    return rows.join(b.wells(spark, sf_dir).where("country is not null").select("well_id", "name"), "well_id").select("well_id", "name", "formation", "hazard", "md", "day")


@query("episode_action_filter", "episode", sql="SELECT well_id, document_id, seq, formation, hazard, outcome, hours, list_sort(list_distinct(action_types)) AS actions, quantity FROM episode WHERE list_contains(action_types, 'widget') AND outcome <> 'unknown' AND quantity >= 45")
def episode_action_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.episodes(spark, sf_dir).where(F.array_contains("action_types", "widget") & (F.col("outcome") != "unknown") & (F.col("quantity") >= 45))
    return rows.select("well_id", "document_id", "seq", "formation", "hazard", "outcome", "hours", F.array_sort(F.array_distinct("action_types")).alias("actions"), "quantity")


@query("review_queue", "event_all", sql="SELECT well_id, document_id, formation, hazard, md, day FROM event_all WHERE needs_review AND hazard = 'SMALL' ORDER BY well_id, document_id, formation, md, day LIMIT 50 OFFSET 20")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.events(spark, sf_dir, trusted=False).where(F.col("needs_review") & (F.col("hazard") == "SMALL"))
    return rows.select("well_id", "document_id", "formation", "hazard", "md", "day").orderBy("well_id", "document_id", "formation", "md", "day").offset(20).limit(50)


@query("status_counts", "event_all", sql="""
SELECT 'wells' AS what, CAST((SELECT count(*) FROM customer) AS BIGINT) AS n UNION ALL SELECT 'reports', (SELECT count(*) FROM orders) UNION ALL SELECT 'trusted', (SELECT count(*) FROM event_all WHERE NOT needs_review)
UNION ALL SELECT 'review', (SELECT count(*) FROM event_all WHERE needs_review) UNION ALL SELECT 'samples', (SELECT count(*) FROM events) UNION ALL SELECT 'passages', (SELECT count(*) FROM documents)
""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(df: DataFrame, **named) -> DataFrame:
        """One pass over a table: a row for each count."""
        row = df.agg(*[c.alias(n) for n, c in named.items()])
        return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("n")) for n in named])))

    tables = {"wells": "customer", "reports": "orders", "samples": "events", "passages": "documents"}
    parts = [count(b.table(spark, sf_dir, t), **{name: F.count("*")}) for name, t in tables.items()]
    parts.append(count(b.events(spark, sf_dir, trusted=False), trusted=F.count_if(~F.col("needs_review")), review=F.count_if("needs_review")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("replay_range", "sample", sql="SELECT well_id, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM sample GROUP BY well_id")
def replay_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.samples(spark, sf_dir).groupBy("well_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))


@query("formation_register", "top", "event", sql="""
SELECT formation, wells, coalesce(events, 0) AS events, coalesce(well_events, 0) AS well_events FROM (SELECT formation, count(DISTINCT well_id) AS wells FROM top GROUP BY 1)
LEFT JOIN (SELECT formation, count(*) AS events, count(DISTINCT well_id) AS well_events FROM event GROUP BY 1) USING (formation) WHERE wells >= 10
""")
def formation_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    wells = b.tops(spark, sf_dir).groupBy("formation").agg(F.countDistinct("well_id").alias("wells")).where("wells >= 10")
    found = b.events(spark, sf_dir).groupBy("formation").agg(F.count("*").alias("events"), F.countDistinct("well_id").alias("well_events"))
    return wells.join(found, "formation", "left").select("formation", "wells", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "well_events")])


@query("top_hazard", "event", sql="SELECT well_id, arg_max(hazard, (n, -first, hazard)) AS hazard, max(n) AS n FROM (SELECT well_id, hazard, count(*) AS n, min(document_id) AS first FROM event GROUP BY 1, 2) GROUP BY well_id")
def top_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = b.events(spark, sf_dir).groupBy("well_id", "hazard").agg(F.count("*").alias("n"), F.min("document_id").alias("first"))
    return counts.groupBy("well_id").agg(F.max_by("hazard", F.struct("n", -F.col("first"), "hazard")).alias("hazard"), F.max("n").alias("n"))


@query("reports_per_well", sql="SELECT o_custkey AS well_id, o_orderpriority AS kind, count(*) AS reports FROM orders GROUP BY 1, 2")
def reports_per_well(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("well_id"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("reports"))


@query("formation_at", "top", "event_all", sql="""
SELECT DISTINCT well_id, document_id, hazard, md, day, coalesce(f.formation, g.formation) AS at_formation FROM event_all e
LEFT JOIN LATERAL (SELECT CASE WHEN e.md <= arg_max(base, top) THEN arg_max(formation, top) END AS formation FROM top t WHERE t.well_id = e.well_id AND t.level = 'FORMATION' AND t.top <= e.md) f ON true
LEFT JOIN LATERAL (SELECT CASE WHEN e.md <= arg_max(base, top) THEN arg_max(formation, top) END AS formation FROM top t WHERE t.well_id = e.well_id AND t.level = 'GROUP' AND t.top <= e.md) g ON true
""")
def formation_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.events(spark, sf_dir, trusted=False).select("well_id", "document_id", "hazard", "md", "day").distinct()
    return layer_at(rows, b.tops(spark, sf_dir)).withColumnRenamed("at", "at_formation")


def layer_at(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """``rows`` (well_id, md, ...) with the layer they are in: the last formation's top at or above md if its base is not above it, else the last group's, else null."""
    for level, name in (("FORMATION", "_f"), ("GROUP", "_g")):
        own = tops.where(F.coalesce("level", F.lit("FORMATION")) == level).select("well_id", "top", F.col("base").alias(f"{name}b"), F.col("formation").alias(name))
        rows = joins.as_of(rows, own, ["well_id"], "md", "top", [f"{name}b", name])
        rows = rows.withColumn(name, F.when(F.col(f"{name}b").isNull() | (F.col("md") <= F.col(f"{name}b")), F.col(name))).drop(f"{name}b")
    return rows.withColumn("at", F.coalesce("_f", "_g")).drop("_f", "_g")


MUD = {"mud": "SELECT DISTINCT well_id, 50 * b + quantity AS md, 8 + tax * 50 AS mw FROM line WHERE seq = 2", "ask": "SELECT DISTINCT well_id, document_id, md FROM event_all"}


@query("nearest_mud", "line", "event_all", more=MUD, sql="""
SELECT well_id, document_id, md, CASE WHEN gap <= 150 THEN round(mw, 4) END AS mw FROM (
  SELECT ask.well_id, ask.document_id, ask.md, min(abs(mud.md - ask.md)) AS gap, arg_min(mud.mw, (abs(mud.md - ask.md), mud.md, -mud.mw)) AS mw FROM ask LEFT JOIN mud ON ask.well_id = mud.well_id GROUP BY 1, 2, 3)
""")
def nearest_mud(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = b.events(spark, sf_dir, trusted=False).select("well_id", "document_id", "md").distinct()
    readings = b.lines(spark, sf_dir).where("seq = 2").select("well_id", (50 * F.col("b") + F.col("quantity")).alias("mud_md"), (8 + F.col("tax") * 50).alias("mw"))
    readings = readings.groupBy("well_id", "mud_md").agg(F.max("mw").alias("mw"))  # of readings at one depth the heaviest counts
    return joins.nearest(asked, readings, ["well_id"], "md", "mud_md", ["mw"], 150).withColumn("mw", F.round("mw", 4))


@query("mud_in_force", "line", "event", more={"mud": "SELECT well_id, CAST(reported AS DATE) AS day, max(8 + tax * 50) AS mw FROM line GROUP BY 1, 2", "ask": "SELECT DISTINCT well_id, day FROM event"},
       sql="SELECT ask.well_id, ask.day, round(mud.mw, 4) AS mw FROM ask ASOF LEFT JOIN mud ON ask.well_id = mud.well_id AND ask.day >= mud.day")
def mud_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = b.lines(spark, sf_dir).groupBy("well_id", F.col("reported").cast("date").alias("mud_day")).agg(F.max(8 + F.col("tax") * 50).alias("mw"))
    return joins.as_of(b.events(spark, sf_dir).select("well_id", "day").distinct(), readings, ["well_id"], "day", "mud_day", ["mw"]).withColumn("mw", F.round("mw", 4))


@query("formation_column", "top", more={"child": "SELECT g.well_id, g.formation, min(f.top) AS child FROM top g JOIN top f ON f.well_id = g.well_id AND f.level = 'FORMATION' AND f.top >= g.top AND f.top < g.top + 120 WHERE g.level = 'GROUP' GROUP BY 1, 2"}, sql="""
SELECT well_id, formation, level, top, CASE WHEN level = 'GROUP' AND child IS NOT NULL THEN child ELSE base END AS base, row_number() OVER (PARTITION BY well_id ORDER BY top) AS place, lead(top) OVER (PARTITION BY well_id ORDER BY top) - top AS thickness
FROM top LEFT JOIN child USING (well_id, formation) WHERE level <> 'GROUP' OR child IS NULL OR child - top > 60
""")
def formation_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers of each well in order: a group whose first formation begins close below goes, others end where it begins."""
    rows = b.tops(spark, sf_dir)
    below = Window.partitionBy("well_id").orderBy("top").rowsBetween(1, Window.unboundedFollowing)
    child = F.min(F.when(F.col("level") == "FORMATION", F.col("top"))).over(below)
    rows = rows.withColumn("child", F.when((F.col("level") == "GROUP") & (child < F.col("top") + 120), child))
    rows = rows.where((F.col("level") != "GROUP") | F.col("child").isNull() | (F.col("child") - F.col("top") > 60))
    order = Window.partitionBy("well_id").orderBy("top")
    return rows.select("well_id", "formation", "level", "top", F.coalesce("child", "base").alias("base"), F.row_number().over(order).cast("long").alias("place"), (F.lead("top").over(order) - F.col("top")).alias("thickness"))


@query("mud_window", "line", more={
    "evidence": "SELECT DISTINCT formation, 'lower' AS side, 8 + tax * 50 AS v FROM line WHERE seq = 2 AND tax <= 0.04 UNION ALL SELECT DISTINCT formation, 'upper', 9 + discount * 50 FROM line WHERE seq = 3 AND discount >= 0.05"},
    sql="""SELECT formation, round(lo, 4) AS lower_ppg, round(hi, 4) AS upper_ppg, n_lower, n_upper, CASE WHEN lo IS NULL THEN 'upper_only' WHEN hi IS NULL THEN 'lower_only' WHEN lo > hi THEN 'conflict' ELSE 'window' END AS status,
    round(CASE WHEN n_lower >= 3 THEN p10 END, 4) AS p10, round(CASE WHEN n_lower >= 3 THEN p90 END, 4) AS p90 FROM (
    SELECT formation, max(v) FILTER (side = 'lower') AS lo, min(v) FILTER (side = 'upper') AS hi, count(*) FILTER (side = 'lower') AS n_lower, count(*) FILTER (side = 'upper') AS n_upper,
    quantile_cont(v, 0.1) FILTER (side = 'lower') AS p10, quantile_cont(v, 0.9) FILTER (side = 'lower') AS p90 FROM evidence GROUP BY formation)""")
def mud_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.lines(spark, sf_dir)
    lower = rows.where("seq = 2 and tax <= 0.04").select("formation", F.lit("lower").alias("side"), (8 + F.col("tax") * 50).alias("v")).distinct()
    upper = rows.where("seq = 3 and discount >= 0.05").select("formation", F.lit("upper").alias("side"), (9 + F.col("discount") * 50).alias("v")).distinct()
    low, high = F.when(F.col("side") == "lower", F.col("v")), F.when(F.col("side") == "upper", F.col("v"))
    out = lower.unionByName(upper).groupBy("formation").agg(F.max(low).alias("lo"), F.min(high).alias("hi"), F.count(low).alias("n_lower"), F.count(high).alias("n_upper"), F.percentile(low, 0.1).alias("p10"), F.percentile(low, 0.9).alias("p90"))
    status = F.when(F.col("lo").isNull(), "upper_only").when(F.col("hi").isNull(), "lower_only").when(F.col("lo") > F.col("hi"), "conflict").otherwise("window")
    enough = lambda c: F.round(F.when(F.col("n_lower") >= 3, F.col(c)), 4).alias(c)
    return out.select("formation", F.round("lo", 4).alias("lower_ppg"), F.round("hi", 4).alias("upper_ppg"), "n_lower", "n_upper", status.alias("status"), enough("p10"), enough("p90"))


@query("casing_lessons", "line", "event", more={"shoe": "SELECT well_id, b AS od, round(50 * b + quantity) AS shoe, min(document_id) AS document_id FROM line WHERE seq = 4 GROUP BY 1, 2, 3"},
       sql="SELECT s.well_id, s.od, s.shoe, s.document_id, count(e.md) AS issues, coalesce(list_sort(list(e.md) FILTER (e.md IS NOT NULL)), []) AS depths FROM shoe s LEFT JOIN (SELECT well_id, md FROM event WHERE hazard IN ('ECONOMY', 'PROMO')) e ON e.well_id = s.well_id AND abs(e.md - s.shoe) <= 300 GROUP BY ALL")
def casing_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    shoes = b.lines(spark, sf_dir).where("seq = 4").groupBy("well_id", F.col("b").alias("od"), F.round(50 * F.col("b") + F.col("quantity")).alias("shoe")).agg(F.min("document_id").alias("document_id"))
    issues = b.events(spark, sf_dir).where(F.col("hazard").isin("ECONOMY", "PROMO")).select(F.col("well_id").alias("w"), "md")
    joined = shoes.join(issues, (F.col("well_id") == F.col("w")) & (F.abs(F.col("md") - F.col("shoe")) <= 300), "left")
    return joined.groupBy("well_id", "od", "shoe", "document_id").agg(F.count("md").alias("issues"), F.sort_array(F.collect_list("md")).alias("depths"))


BOTH = {"fam": "SELECT well_id FROM event_all GROUP BY 1 HAVING count_if(kind IN ('1-URGENT', '2-HIGH')) > 0 AND count_if(kind NOT IN ('1-URGENT', '2-HIGH')) > 0",
        "summary": "SELECT DISTINCT well_id, hazard, md FROM event_all WHERE kind IN ('1-URGENT', '2-HIGH') AND well_id IN (SELECT well_id FROM fam)",
        "daily": "SELECT DISTINCT well_id, hazard, md FROM event_all WHERE kind NOT IN ('1-URGENT', '2-HIGH') AND well_id IN (SELECT well_id FROM fam)"}


@query("audit_tolerance_anti", "event_all", more=BOTH, sql="""
SELECT 'summary_only' AS rule, * FROM summary s WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE d.well_id = s.well_id AND d.hazard = s.hazard AND abs(d.md - s.md) <= 30)
UNION ALL SELECT 'daily_only', * FROM daily s WHERE NOT EXISTS (SELECT 1 FROM summary d WHERE d.well_id = s.well_id AND d.hazard = s.hazard AND abs(d.md - s.md) <= 30)
""")
def audit_tolerance_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.events(spark, sf_dir, trusted=False).withColumn("summary", F.col("kind").isin("1-URGENT", "2-HIGH"))
    both = rows.groupBy("well_id").agg(F.bool_or("summary").alias("s"), F.bool_or(~F.col("summary")).alias("d")).where("s and d").select("well_id")
    rows = rows.join(both, "well_id", "left_semi").select("well_id", "hazard", "md", "summary").distinct()
    summary, daily = rows.where("summary").drop("summary"), rows.where("not summary").drop("summary")
    sides = (("summary_only", summary, daily), ("daily_only", daily, summary))
    first, second = (joins.unmatched(x, y, ["well_id", "hazard"], "md", 30.0).select(F.lit(rule).alias("rule"), "well_id", "hazard", "md") for rule, x, y in sides)
    return first.unionByName(second)


@query("shoe_conflicts", "line", sql="SELECT well_id, b AS od, min(quantity) AS low, max(quantity) AS high, arg_min(document_id, (quantity, document_id)) AS low_ref, arg_max(document_id, (quantity, -document_id)) AS high_ref FROM line WHERE seq = 4 GROUP BY 1, 2 HAVING max(quantity) - min(quantity) > 0.5")
def shoe_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = b.lines(spark, sf_dir).where("seq = 4").groupBy("well_id", F.col("b").alias("od")).agg(F.min("quantity").alias("low"), F.max("quantity").alias("high"), F.min_by("document_id", F.struct("quantity", "document_id")).alias("low_ref"), F.max_by("document_id", F.struct("quantity", -F.col("document_id"))).alias("high_ref"))
    return out.where("high - low > 0.5")


@query("rig_hours", "line", sql="""
SELECT hazard, count(*) AS n, CAST(count_if(h IS NULL) AS BIGINT) AS untimed, round(coalesce(sum(h), 0), 4) AS hours, round(coalesce(sum(h) FILTER (state = 'O'), 0), 4) AS hours_open
FROM (SELECT DISTINCT hazard, state, well_id, document_id, seq, quantity, shipped, CASE WHEN quantity * 0.6e0 > 0 AND quantity * 0.6e0 <= 24 THEN round(quantity * 0.6e0, 2) END AS h FROM line WHERE flag <> 'N') GROUP BY hazard
""")
def rig_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("quantity") * 0.6
    rows = b.lines(spark, sf_dir).where("flag <> 'N'").select("hazard", "state", "well_id", "document_id", "seq", "quantity", "shipped", F.when((h > 0) & (h <= 24), F.round(h, 2)).alias("h")).distinct()
    total = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 4)
    return rows.groupBy("hazard").agg(F.count("*").alias("n"), F.count_if(F.col("h").isNull()).alias("untimed"), total(F.col("h")).alias("hours"), total(F.when(F.col("state") == "O", F.col("h"))).alias("hours_open"))


REPEATS = {
    "place": "SELECT well_id, lat, lon, family, spud FROM well JOIN spud USING (well_id)",
    "rec": "SELECT DISTINCT well_id, formation, hazard FROM event",
    "hit": """SELECT a.well_id, a.formation, a.hazard, any_value(p.spud) AS spud, count(q.well_id) AS n, max(q.spud) AS latest FROM rec a JOIN place p ON p.well_id = a.well_id
        LEFT JOIN rec c ON c.formation = a.formation AND c.hazard = a.hazard LEFT JOIN place q ON q.well_id = c.well_id AND q.family <> p.family AND q.spud < p.spud GROUP BY 1, 2, 3"""}


def repeat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recorded problem once for each well and layer, with its day ``d`` and the last earlier day (``latest``) on which a well of another family had it in the same layer.

    A layer's and problem's records are reduced to days; the last earlier day with another family follows from windows over them, without a self-join."""
    place = b.wells(spark, sf_dir).join(b.spuds(spark, sf_dir), "well_id").select("well_id", "family", "spud")
    rows = b.events(spark, sf_dir).select("well_id", "formation", "hazard").distinct().join(place, "well_id")
    rows = rows.withColumn("d", F.datediff("spud", F.lit("1970-01-01")))
    layer = ["formation", "hazard"]
    days = rows.groupBy(*layer, "d").agg(F.min("family").alias("a"), F.max("family").alias("z"), F.count("*").alias("c"))
    order = Window.partitionBy(*layer).orderBy("d")
    single = F.when(F.col("a") == F.col("z"), F.col("a"))
    days = days.withColumn("single", single).withColumn("before", F.lag("d").over(order))
    new = F.when(F.col("single").isNotNull() & (F.col("single") == F.lag("single").over(order)), 0).otherwise(1)
    days = days.withColumn("island", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # before a run of days on which one family alone has records: the last day on which another has
    days = days.withColumn("other", F.first("before").over(Window.partitionBy(*layer, "island").orderBy("d")))
    days = days.select(*layer, "d", F.col("before").alias("last"), *[F.lag(c).over(order).alias(f"last_{c}") for c in ("a", "z", "other")])
    own = F.col("family")
    return rows.join(days, [*layer, "d"]).withColumn("latest", F.when((F.col("last_a") != own) | (F.col("last_z") != own), F.col("last")).otherwise(F.col("last_other")))


@query("repeats", "event", "well", "spud", more=REPEATS,
    sql="SELECT hazard, CAST(year(spud) // 10 * 10 AS INTEGER) AS decade, count(*) AS n, CAST(count_if(n > 0) AS BIGINT) AS k, round(avg(CASE WHEN n > 0 THEN (spud - latest) / 365.25e0 END), 6) AS gap_years FROM hit GROUP BY 1, 2")
def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many recorded problems an earlier well of another family had in the same layer, archive-wide, and the years since the last one."""
    rows = repeat_rows(spark, sf_dir)
    decade = (F.floor(F.year("spud") / 10) * 10).cast("int")
    return rows.groupBy("hazard", decade.alias("decade")).agg(F.count("*").alias("n"), F.count("latest").alias("k"), F.round(F.avg((F.col("d") - F.col("latest")) / 365.25), 6).alias("gap_years"))


@query("analog_overlap", "top", "event", more={"q": "SELECT * FROM (VALUES (100e0, 180e0), (400e0, 460e0), (900e0, 1000e0)) v(lo, hi)"}, sql="""
SELECT lo, hi, country, count(*) AS intervals, count(DISTINCT well_id) AS wells, round(CAST(sum(CAST(least(1, ov / (base - top)) AS DECIMAL(18, 10))) AS DOUBLE) / count(*), 9) AS fraction FROM (
  SELECT lo, hi, top.*, greatest(0, least(hi, base) - greatest(lo, top)) AS ov FROM top, q) JOIN well USING (well_id) WHERE ov >= 10 GROUP BY 1, 2, 3
""")
def analog_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from borelog.functions import geo

    bands = F.broadcast(spark.createDataFrame([(100.0, 180.0), (400.0, 460.0), (900.0, 1000.0)], "lo double, hi double"))  # the query's own three bands
    ov = geo.overlap(F.col("lo"), F.col("hi"), F.col("top"), F.col("base"))
    rows = b.tops(spark, sf_dir).join(bands, (F.col("top") < F.col("hi")) & (F.col("base") > F.col("lo"))).withColumn("ov", ov).where("ov >= 10")
    rows = rows.join(b.wells(spark, sf_dir).select("well_id", "country"), "well_id")
    part = F.least(F.lit(1.0), F.col("ov") / (F.col("base") - F.col("top"))).cast("decimal(18,10)")  # an exact sum, whatever the order of its rows
    return rows.groupBy("lo", "hi", "country").agg(F.count("*").alias("intervals"), F.countDistinct("well_id").alias("wells"), F.round(F.sum(part).cast("double") / F.count("*"), 9).alias("fraction"))


@query("greedy_dedup", "event_all", recursive=True, more={
    "o": "SELECT well_id, hazard, md, row_number() OVER (PARTITION BY well_id, hazard ORDER BY md) AS r FROM (SELECT DISTINCT well_id, hazard, md FROM event_all)",
    "k": "SELECT well_id, hazard, md, r, md AS held, true AS keep FROM o WHERE r = 1 UNION ALL SELECT o.well_id, o.hazard, o.md, o.r, CASE WHEN o.md - k.held > 30 THEN o.md ELSE k.held END, o.md - k.held > 30 FROM k JOIN o ON o.well_id = k.well_id AND o.hazard = k.hazard AND o.r = k.r + 1"},
    sql="SELECT well_id, hazard, md FROM k WHERE keep")
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.greedy_keep(b.events(spark, sf_dir, trusted=False).select("well_id", "hazard", "md").distinct(), ["well_id", "hazard"], "md", ["md"], 30.0)


@query("formation_runs", "line", more={
    "s": "SELECT well_id, shipped, formation, b, state, row_number() OVER (PARTITION BY well_id ORDER BY shipped, document_id, seq, b, quantity) AS i FROM (SELECT DISTINCT * FROM (SELECT well_id, shipped, document_id, seq, b, quantity, formation, state FROM line))",
    "g": "SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY well_id ORDER BY i) OR i = 1 THEN 1 ELSE 0 END AS n FROM s"},
    sql="SELECT well_id, run, any_value(state) AS state, min(i) AS first, max(i) AS last, count(*) AS n FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY well_id ORDER BY i) AS BIGINT) AS run FROM g) GROUP BY 1, 2")
def formation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.lines(spark, sf_dir).select("well_id", "shipped", "document_id", "seq", "b", "quantity", "formation", "state").distinct()
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("well_id").orderBy("shipped", "document_id", "seq", "b", "quantity")).cast("long"))
    return sequences.runs(rows, ["well_id"], ["i"], "state")


@query("next_reports", "well", "documented", "spud", sql="""
SELECT well_id, neighbours, size, CAST(total AS BIGINT) AS total FROM (SELECT *, sum(size) OVER (ORDER BY neighbours DESC, well_id) AS total FROM (
  SELECT a.well_id, count(c.well_id) AS neighbours, CAST(floor(a.td) AS BIGINT) AS size FROM well a JOIN spud s ON s.well_id = a.well_id AND s.spud >= DATE '1985-01-01'
  LEFT JOIN well c ON c.well_id <> a.well_id AND 2 * 6371008.8 * asin(sqrt(pow(sin(radians(c.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - a.lon) / 2), 2))) <= 5000
  WHERE a.well_id NOT IN (SELECT well_id FROM documented) GROUP BY 1, a.td ORDER BY neighbours DESC, a.well_id LIMIT 200)) WHERE total < 200000
""")
def next_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which wells' reports to load next: without any yet, most neighbours first, within a budget of size; the best 200 are looked at."""
    wells = b.wells(spark, sf_dir)
    asked = wells.join(b.documented(spark, sf_dir), "well_id", "left_anti").join(b.spuds(spark, sf_dir).where("spud >= '1985-01-01'").select("well_id"), "well_id", "left_semi")
    near = joins.within_radius(asked.select("well_id", "lat", "lon"), wells.select("well_id", "lat", "lon"), 5000.0).groupBy("well_id").agg(F.count("*").alias("n"))
    best = asked.join(near, "well_id", "left").select("well_id", F.coalesce("n", F.lit(0)).alias("neighbours"), F.floor("td").cast("long").alias("size"))
    best = best.orderBy(F.col("neighbours").desc(), "well_id").limit(200)
    return best.withColumn("total", F.sum("size").over(Window.orderBy(F.col("neighbours").desc(), "well_id"))).where("total < 200000")
