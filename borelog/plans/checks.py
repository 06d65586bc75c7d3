"""Extraction over report lines whose content the tables tell, and the smaller checks, registers and normalisers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borelog.functions import text as fn
from borelog.operators import extraction, lithology, sequences

from . import bindings as b

QUERIES, SQL = {}, {}


def query(name: str, *ctes: str, sql: str | None = None, more: dict[str, str] | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = b.sql(sql, *ctes, more=more)
        return f

    return add


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("well_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").cast("date").alias("day"))


@query("report_events", sql="""
SELECT o_orderkey AS passage_id, CASE o_orderkey % 6 WHEN 0 THEN 'kick' WHEN 1 THEN 'stuck_pipe' ELSE 'lost_circulation' END AS hazard,
       CASE o_orderkey % 6 WHEN 3 THEN round((1000 + o_custkey % 900) * 0.3048e0, 1) WHEN 5 THEN NULL ELSE CAST(1000 + o_custkey % 900 AS DOUBLE) END AS md,
       CASE o_orderkey % 6 WHEN 0 THEN CAST(10 + o_custkey % 50 AS DOUBLE) WHEN 3 THEN 1200e0 WHEN 4 THEN 5e0 WHEN 5 THEN 40e0 END AS quantity,
       CASE WHEN o_orderkey % 6 = 0 THEN 10.5e0 END AS mud_weight_ppg, CASE o_orderkey % 6 WHEN 3 THEN 'high' WHEN 5 THEN 'low' ELSE 'medium' END AS severity,
       CASE WHEN o_orderkey % 6 = 5 THEN 0.55e0 ELSE 0.7e0 END AS confidence, o_orderkey % 6 = 5 AS needs_review
FROM orders WHERE o_orderkey % 6 <> 2
""")
def report_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from sentences built of the orders' numbers: problems, denials, depths in both units and beside distances, amounts, weights."""
    md = (1000 + F.col("well_id") % 900).cast("string")
    said = {
        0: ["Took a kick at ", md, " m, gained ", (10 + F.col("well_id") % 50).cast("string"), " bbl with 10.50 ppg mud, 30 m above the last shoe."],
        1: ["Drilled another 40 m; string stuck at ", md, " m (9000 ft)."],
        2: ["Drilled on without losses to ", md, " m, then kicked off: kick-off at 300 m."],
        3: ["Severe losses at ", md, " ft, lost 1,200 bbl."],
        4: ["Losses of 5 m3 per hour at ", md, " m, 12 m below the shoe."],
        5: ["Slight losses, 40 bbl."],
    }
    text = F.coalesce(*[F.when(F.col("id") % 6 == k, F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])) for k, parts in said.items()])
    rows = orders(spark, sf_dir).select(F.col("id").alias("passage_id"), F.col("id").alias("document_id"), F.lit(1).alias("seq"), text.alias("text"))
    found = extraction.events(rows)
    return found.select("passage_id", "hazard", "md", "quantity", "mud_weight_ppg", "severity", "confidence", "needs_review")


@query("report_episodes", more={
    "o": "SELECT o_orderkey AS id, o_custkey AS well_id FROM orders",
    "e": "SELECT id, well_id, i FROM o, range(6) r(i) WHERE (id + i) % 5 = 0"},
    sql="""SELECT 10 * id + i AS passage_id, 'stuck_pipe' AS hazard, CAST(1000 + well_id % 900 AS DOUBLE) AS md, CASE WHEN i <= 3 THEN 'resolved' ELSE 'unknown' END AS outcome,
    CASE WHEN i <= 4 THEN 'spot_pill' ELSE '' END AS actions, CASE WHEN i <= 2 THEN 6e0 END AS npt_hours, CASE WHEN i <= 3 THEN 0.595e0 ELSE 0.7e0 END AS episode_confidence, least(5, 6 - i) AS rows_read FROM e""")
def report_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of six report lines for each order: a problem, and what the next four lines of its document say of it."""
    k = (F.col("id") + F.col("seq")) % 5
    stuck = F.concat(F.lit("Stuck at "), (1000 + F.col("well_id") % 900).cast("string"), F.lit(" m."))
    text = F.when(k == 0, stuck).when(k == 1, "Spotted acid around the bit.").when(k == 2, "Pipe came free.").when(k == 3, "Waited on weather, 6 hrs.").otherwise("Drilled ahead.")
    rows = orders(spark, sf_dir).withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(5)))).select((10 * F.col("id") + F.col("seq")).alias("passage_id"), F.col("id").alias("document_id"), "seq", F.concat(F.lit("p1."), F.col("seq")).alias("locator"), text.alias("text"))
    found = extraction.episodes(rows, extraction.events(rows))
    return found.select("passage_id", "hazard", "md", "outcome", F.array_join("action_types", ",").alias("actions"), "npt_hours", "episode_confidence", F.col("rows_read").cast("long").alias("rows_read"))


@query("extraction_gate", sql="""
SELECT kind, CAST(count(*) AS BIGINT) AS lines, CAST(count_if(kind <> '5-LOW' AND (kind <> '1-URGENT' OR k <> 1) AND NOT (kind = '2-HIGH' AND k = 0)) AS BIGINT) AS kept
FROM (SELECT o_orderpriority AS kind, o_orderkey % 3 AS k FROM orders) GROUP BY 1
""")
def extraction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines may hold events: by kind of document, drilling context of incidents, and work that is only planned."""
    text = F.element_at(F.array(F.lit("Plan to run casing."), F.lit("The coffee was cold."), F.lit("Stuck while running casing as planned.")), (F.col("id") % 3 + 1).cast("int"))
    ok = extraction.extractable(F.col("kind"), text, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], context_kinds=["1-URGENT"], planned_kinds=["2-HIGH"])
    return orders(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("lines"), F.count_if(ok).alias("kept"))


@query("wells_named", sql="SELECT c_custkey AS well_id, (1 + c_custkey % 30) || '/' || (1 + c_custkey % 9) || '-' || (1 + c_custkey % 20) || CASE WHEN c_custkey % 2 = 0 THEN ' S' ELSE '' END AS named, CAST(1 + c_custkey % 2 AS BIGINT) AS n FROM customer")
def wells_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wells that a sentence names, in canonical form, however they are written."""
    key = F.col("c_custkey")
    name = F.concat((1 + key % 30).cast("string"), F.lit("/"), (1 + key % 9).cast("string"), F.lit("-"), (1 + key % 20).cast("string"), F.when(key % 2 == 0, " S").otherwise(""))
    text = F.concat(F.lit("Losses in NO "), name, F.lit(" and in "), name, F.when(key % 2 == 1, ", as in well Zulu-7 before.").otherwise("."))
    found = b.table(spark, sf_dir, "customer").select(key.alias("well_id"), extraction.wells_named(text).alias("w"))
    return found.select("well_id", F.get("w", F.lit(0)).alias("named"), F.size("w").cast("long").alias("n"))


AUDIT = {
    "flag": """SELECT well_id, 'R1' AS rule, count(*) AS n FROM event_all JOIN well USING (well_id) WHERE md > td GROUP BY 1
        UNION ALL SELECT well_id, 'R2', count(*) FROM (SELECT well_id, document_id, seq FROM line WHERE shipped < reported GROUP BY ALL) GROUP BY 1
        UNION ALL SELECT well_id, 'R3', count(*) FROM (SELECT well_id, document_id, hazard FROM line GROUP BY ALL HAVING count(DISTINCT formation) > 1) GROUP BY 1
        UNION ALL SELECT well_id, 'R4', count(*) FROM (SELECT well_id, formation FROM line GROUP BY ALL HAVING max(quantity) - min(quantity) > 30) GROUP BY 1
        UNION ALL SELECT well_id, 'R5', count(*) FROM (SELECT well_id, formation FROM event WHERE formation NOT IN (SELECT formation FROM line WHERE flag = 'R' AND quantity > 45) GROUP BY ALL) GROUP BY 1
        UNION ALL SELECT well_id, 'R6', count(*) FROM (SELECT DISTINCT well_id, formation, hazard FROM event) e ANTI JOIN (SELECT DISTINCT well_id, formation, hazard FROM line WHERE flag = 'N') l USING (well_id, formation, hazard) GROUP BY 1""",
}


def audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(well_id, rule, n): events below the total depth, dates in the wrong order, one problem in two layers, quantities of a layer
    that differ, layers never met elsewhere, and problems that no later line repeats."""
    lines, wells = b.lines(spark, sf_dir), b.wells(spark, sf_dir)
    every, trusted = b.events(spark, sf_dir, trusted=False), b.events(spark, sf_dir)
    seen = lines.where((F.col("flag") == "R") & (F.col("quantity") > 45)).select("formation").distinct()
    three = ["well_id", "formation", "hazard"]
    rules = {
        "R1": every.join(wells.select("well_id", "td"), "well_id").where("md > td"),
        "R2": lines.where("shipped < reported").select("well_id", "document_id", "seq").distinct(),
        "R3": lines.groupBy("well_id", "document_id", "hazard").agg(F.countDistinct("formation").alias("k")).where("k > 1"),
        "R4": lines.groupBy("well_id", "formation").agg((F.max("quantity") - F.min("quantity")).alias("k")).where("k > 30"),
        "R5": trusted.join(seen, "formation", "left_anti").select("well_id", "formation").distinct(),
        "R6": trusted.select(*three).distinct().join(lines.where("flag = 'N'").select(*three).distinct(), three, "left_anti"),
    }
    out = None
    for rule, rows in rules.items():
        part = rows.groupBy("well_id").agg(F.count("*").alias("n")).select("well_id", F.lit(rule).alias("rule"), "n")
        out = part if out is None else out.union(part)
    return out


@query("report_audit", "event", "well", more=AUDIT, sql="SELECT well_id, rule, n FROM flag")
def report_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_flags(spark, sf_dir)


@query("audit_filter", "event", "well", more=AUDIT, sql="SELECT well_id, name, country, rule, n, CASE WHEN n > 5 THEN 'conflict' ELSE 'check' END AS status FROM flag LEFT JOIN well USING (well_id) WHERE rule IN ('R1', 'R3', 'R4') AND n >= 2 AND country <> 'CANADA'")
def audit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's flags by rule, status and country."""
    rows = audit_flags(spark, sf_dir).where(F.col("rule").isin("R1", "R3", "R4") & (F.col("n") >= 2))
    rows = rows.join(b.wells(spark, sf_dir).select("well_id", "name", "country"), "well_id", "left").where("country <> 'CANADA'")
    return rows.select("well_id", "name", "country", "rule", "n", F.when(F.col("n") > 5, "conflict").otherwise("check").alias("status"))


@query("review_page", "event_all", sql="""
SELECT well_id, document_id, formation, md, day, (SELECT count(*) FROM event_all WHERE needs_review AND hazard = 'SMALL') AS total
FROM event_all WHERE needs_review AND hazard = 'SMALL' ORDER BY well_id, document_id, formation, md, day LIMIT 25 OFFSET 25
""")
def review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the review queue with the number of all that wait."""
    rows = b.events(spark, sf_dir, trusted=False).where(F.col("needs_review") & (F.col("hazard") == "SMALL"))
    page = rows.select("well_id", "document_id", "formation", "md", "day").orderBy("well_id", "document_id", "formation", "md", "day").offset(25).limit(25)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


@query("coordinate_bounds", "well", sql="""
SELECT country, CAST(count(*) AS BIGINT) AS wells, CAST(count_if(lat BETWEEN 48 AND 58.5 AND lon BETWEEN -10 AND 3) AS BIGINT) AS inside, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north,
       (min(lon) + max(lon)) / 2 AS centre_lon, (min(lat) + max(lat)) / 2 AS centre_lat FROM well GROUP BY 1
""")
def coordinate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wells within sane bounds, and each country's box and the centre of its ring."""
    inside = F.col("lat").between(48, 58.5) & F.col("lon").between(-10, 3)
    rows = b.wells(spark, sf_dir).groupBy("country").agg(F.count("*").alias("wells"), F.count_if(inside).alias("inside"), F.array(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).alias("box"))
    corners = [F.element_at("box", i + 1).alias(n) for i, n in enumerate(("west", "south", "east", "north"))]
    ring = F.array(*[F.struct(F.element_at("box", x).alias("x"), F.element_at("box", y).alias("y")) for x, y in ((1, 2), (3, 2), (3, 4), (1, 4))])
    middle = lambda places: (F.array_min(places) + F.array_max(places)) / 2
    centre = [middle(F.transform(ring, lambda p: p["x"])).alias("centre_lon"), middle(F.transform(ring, lambda p: p["y"])).alias("centre_lat")]
    return rows.select("country", "wells", "inside", *corners, *centre)


@query("source_mode", "event", "well", sql="SELECT formation, source, n FROM (SELECT formation, source, count(*) AS n, row_number() OVER (PARTITION BY formation ORDER BY count(*) DESC, source) AS k FROM (SELECT DISTINCT formation, well_id FROM event) JOIN well USING (well_id) GROUP BY 1, 2) WHERE k = 1")
def source_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest source among the wells that give evidence for a layer; ties by name."""
    rows = b.events(spark, sf_dir).select("formation", "well_id").distinct().join(b.wells(spark, sf_dir).select("well_id", "source"), "well_id")
    counts = rows.groupBy("formation", "source").agg(F.count("*").alias("n"))
    return sequences.top_n(counts, 1, ["formation"], [F.col("n").desc(), F.col("source")]).drop("rank")


@query("evidence_order", "event", "well", sql="""
SELECT formation, array_to_string(list_slice(list(well_id ORDER BY y DESC, weight DESC, well_id), 1, 5), ',') AS first_five, CAST(count(*) AS BIGINT) AS n
FROM (SELECT formation, well_id, max(CASE WHEN hazard = 'SMALL' THEN 1 ELSE 0 END) AS y, round(max(1e0 / (1 + abs(lat - 58.5e0))), 6) AS weight FROM event JOIN well USING (well_id) GROUP BY 1, 2) GROUP BY 1
""")
def evidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of each layer as an array of structs: wells with the problem first, then by weight."""
    rows = b.events(spark, sf_dir).join(b.wells(spark, sf_dir).select("well_id", "lat"), "well_id")
    each = rows.groupBy("formation", "well_id").agg(F.max((F.col("hazard") == "SMALL").cast("int")).alias("y"), F.round(F.max(1 / (1 + F.abs(F.col("lat") - 58.5))), 6).alias("weight"))
    first = sequences.top_n(each, 5, ["formation"], [F.col("y").desc(), F.col("weight").desc(), F.col("well_id")])
    held = first.groupBy("formation").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "well_id"))), lambda e: e["well_id"].cast("string")).alias("evidence"))
    counts = each.groupBy("formation").agg(F.count("*").alias("n"))
    return counts.join(held, "formation").select("formation", F.array_join("evidence", ",").alias("first_five"), "n")


@query("striking_examples", "episode", sql="SELECT document_id, seq, formation, hazard, outcome, hours, quantity FROM (SELECT DISTINCT document_id, seq, formation, hazard, outcome, hours, quantity FROM episode WHERE quantity >= 48) ORDER BY hours ASC NULLS LAST, quantity DESC, document_id, seq, formation, hazard, outcome LIMIT 8")
def striking_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight soonest solved of the largest problems, unsolved ones last."""
    cols = ["document_id", "seq", "formation", "hazard", "outcome", "hours", "quantity"]
    return b.episodes(spark, sf_dir).where("quantity >= 48").select(*cols).distinct().orderBy(F.asc_nulls_last("hours"), F.desc("quantity"), *cols[:5]).limit(8)


@query("dates", sql="SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS from_millis, CAST(o_orderdate AS DATE) AS from_short, CAST(o_orderdate AS DATE) AS from_digits, CAST(o_orderdate AS DATE) - 20000 AS before_1970 FROM orders")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days out of epoch milliseconds (also negative ones), of years in two digits and of eight digits."""
    day, base = F.col("day"), F.lit("1970-01-01").cast("date")
    millis = F.datediff(day, base).cast("long") * 86_400_000
    rows = orders(spark, sf_dir)
    return rows.select("id", fn.day_of_millis(millis + 5000).alias("from_millis"), fn.day_of(F.upper(F.date_format(day, "dd-MMM-yy"))).alias("from_short"), fn.day_of(F.date_format(day, "yyyyMMdd")).alias("from_digits"), fn.day_of_millis(millis - 20_000 * 86_400_000 + 5000).alias("before_1970"))


@query("header_rows", sql="SELECT n_nationkey AS id, 'Name: ' || n_name || ' | Region: ' || r_name || ' | Key: ' || n_nationkey AS line FROM nation JOIN region ON n_regionkey = r_regionkey")
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows as text: each value behind its column's heading."""
    rows = b.table(spark, sf_dir, "nation").join(F.broadcast(b.table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    heads = F.array(*map(F.lit, ("Name", "Region", "Key")))
    values = F.array("n_name", "r_name", F.col("n_nationkey").cast("string"))
    return rows.select(F.col("n_nationkey").alias("id"), F.array_join(F.zip_with(heads, values, lambda h, v: F.concat(h, F.lit(": "), v)), " | ").alias("line"))


@query("document_country", "well", sql="SELECT o_orderkey AS id, coalesce(well.country, CASE o_orderkey % 3 WHEN 0 THEN 'norway' WHEN 1 THEN 'india' END) AS country FROM orders LEFT JOIN well ON well_id = o_custkey AND td >= 5000")
def document_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's country: its well's, else the folder it was landed in."""
    path = F.element_at(F.array(F.lit("/data/raw/norway/a.pdf"), F.lit("/data/raw/india/b.pdf"), F.lit("/data/c.pdf")), (F.col("id") % 3 + 1).cast("int"))
    folder = F.nullif(F.regexp_extract(path, "raw/([^/]+)", 1), F.lit(""))
    rows = orders(spark, sf_dir).join(b.wells(spark, sf_dir).where("td >= 5000").select("well_id", "country"), "well_id", "left")
    return rows.select("id", F.coalesce("country", folder).alias("country"))


@query("shown_rock", "top", sql="SELECT well_id, formation, level, coalesce(CASE WHEN (well_id + b) % 4 = 0 THEN 'salt' END, CASE WHEN b < 20 THEN 'shale' WHEN b < 40 THEN 'sandstone' END) AS rock FROM top")
def shown_rock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer's rock: the report's, else the lexicon's by its name; and its level by the word in its name."""
    tops = b.tops(spark, sf_dir)
    lexicon = F.broadcast(tops.sparkSession.createDataFrame([(n, "shale" if n < 20 else "sandstone") for n in range(40)], "b int, said string"))  # a closed list
    reported = F.when((F.col("well_id") + F.col("b")) % 4 == 0, "salt")
    name = F.concat("formation", F.when(F.col("b") % 5 == 0, " Gp").otherwise(" Fm"))
    return tops.join(lexicon, "b", "left").select("well_id", "formation", fn.level_of(name).alias("level"), F.coalesce(reported, "said").alias("rock"))


@query("lease_keys", sql="SELECT c_custkey AS well_id, 'green ' || (c_custkey % 7) || ' canyon' AS area, lpad(CAST(c_custkey % 977 AS VARCHAR), 4, '0') AS block FROM customer")
def lease_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas and blocks in one form."""
    key = F.col("c_custkey")
    area = F.concat(F.lit(" Green  "), (key % 7).cast("string"), F.lit(" CANYON , South Addition"))
    return b.table(spark, sf_dir, "customer").select(key.alias("well_id"), fn.area_key(area).alias("area"), fn.block_key(F.concat(F.lit(" "), (key % 977).cast("string"), F.lit(" "))).alias("block"))


@query("subject_well", "line", more={"m": "SELECT formation, kind, well_id, count(*) AS n, row_number() OVER (PARTITION BY formation, kind ORDER BY count(*) DESC, well_id) AS k FROM line GROUP BY 1, 2, 3"},
    sql="SELECT formation, kind, CASE WHEN a.n >= 3 AND a.n >= 1.5 * coalesce(c.n, 0) THEN a.well_id END AS well_id, a.n FROM m a LEFT JOIN (SELECT formation, kind, n FROM m WHERE k = 2) c USING (formation, kind) WHERE a.k = 1")
def subject_well(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The well that a group of lines is about: the one named most, if three times or more and well ahead of the next."""
    return subject(b.lines(spark, sf_dir), ["formation", "kind"], "well_id", 3, 1.5)


def subject(rows: DataFrame, by: list[str], what: str, least: int = 3, ahead: float = 3.0) -> DataFrame:
    counts = rows.groupBy(*by, what).agg(F.count("*").alias("n"))
    two = sequences.top_n(counts, 2, by, [F.col("n").desc(), F.col(what)]).groupBy(*by).agg(F.min_by(what, "rank").alias(what), F.max("n").alias("n"), F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("next"))
    sure = (F.col("n") >= least) & (F.col("n") >= ahead * F.coalesce("next", F.lit(0)))
    return two.select(*by, F.when(sure, F.col(what)).alias(what), "n")


JUDGED = {"j": "SELECT doc_id, quality, toxic, CASE WHEN n_chars >= 2000 THEN 1 WHEN n_chars >= 300 THEN 0 END AS said, doc_id % 4 AS round FROM labels JOIN documents USING (doc_id)"}


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("n_chars") >= 2000, 1).when(F.col("n_chars") >= 300, 0)
    return b.table(spark, sf_dir, "labels").join(b.table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "quality", "toxic", said.alias("said"), (F.col("doc_id") % 4).alias("round"))


@query("outcome_accuracy", more=JUDGED, sql="""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(said) AS BIGINT) AS assigned, round(avg(CASE WHEN coalesce(said, -1) = quality THEN 1e0 ELSE 0 END), 6) AS accuracy,
       round(sum(CASE WHEN said = quality THEN 1e0 ELSE 0 END) / count(said), 6) AS precision_assigned, round(avg(CASE WHEN toxic = 1 THEN 1e0 ELSE 0 END), 6) AS no_episode FROM j
""")
def outcome_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes against labels: accuracy, precision where one was assigned, share that is no episode."""
    right = F.coalesce((F.col("said") == F.col("quality")).cast("double"), F.lit(0.0))
    return judged(spark, sf_dir).agg(
        F.count("*").alias("n"), F.count("said").alias("assigned"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.sum(right) / F.count("said"), 6).alias("precision_assigned"),
        F.round(F.avg((F.col("toxic") == 1).cast("double")), 6).alias("no_episode"),
    )


@query("precision_rounds", more=JUDGED, sql="SELECT round, CAST(count(said) AS BIGINT) AS n, CAST(count_if(said = quality) AS BIGINT) AS k, round(count_if(said = quality) / count(said), 6) AS precision FROM j GROUP BY 1")
def precision_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k of n in each round of labels."""
    rows = judged(spark, sf_dir).groupBy("round").agg(F.count("said").alias("n"), F.count_if(F.col("said") == F.col("quality")).alias("k"))
    return rows.select("round", "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("precision"))


@query("recount", sql="SELECT source, round(avg(n_chars), 6) AS stored, round(avg(length(text)), 6) AS counted, abs(avg(n_chars) - avg(length(text))) < 5e-4 AS same FROM documents GROUP BY 1")
def recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored figures against the same counted anew."""
    rows = b.table(spark, sf_dir, "documents").groupBy("source").agg(F.avg("n_chars").alias("a"), F.avg(F.length("text")).alias("c"))
    return rows.select("source", F.round("a", 6).alias("stored"), F.round("c", 6).alias("counted"), (F.abs(F.col("a") - F.col("c")) < 5e-4).alias("same"))


@query("data_register", "well", sql="""
SELECT name, rows, origin FROM (SELECT 'source ' || source AS name, count(*) AS rows, 'counted' AS origin FROM well GROUP BY source
UNION ALL SELECT * FROM (VALUES ('source BUILDING', -1, 'old'), ('hand kept', 7, 'old')) v(name, rows, origin) WHERE name NOT IN (SELECT 'source ' || source FROM well))
""")
def data_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register of data sources: counted rows take the place of those with their name, others stay."""
    counted = b.wells(spark, sf_dir).groupBy(F.concat(F.lit("source "), F.col("source")).alias("name")).agg(F.count("*").alias("rows")).withColumn("origin", F.lit("counted"))
    old = spark.createDataFrame([("source BUILDING", -1, "old"), ("hand kept", 7, "old")], "name string, rows long, origin string")
    return counted.unionByName(old.join(counted, "name", "left_anti"))


@query("basin_suggestions", "line", "well", more={
    "p": """SELECT field AS basin, document_id * 10 + seq AS ref, formation, b, 50 * b + well_id % 40 AS md,
        'Drilled ' || formation || ', ' || CASE b % 6 WHEN 0 THEN 'clean sands' WHEN 1 THEN 'grey claystone' WHEN 2 THEN 'chalk' WHEN 3 THEN 'rock salt' WHEN 4 THEN 'black coal' ELSE 'no sample' END || ', to ' || (50 * b + well_id % 40) || ' m.' AS text FROM line JOIN well USING (well_id)""",
    "s": """SELECT basin, ref, text, md, 'lithology' AS type, CASE b % 6 WHEN 0 THEN 'sandstone' WHEN 1 THEN 'claystone' WHEN 2 THEN 'chalk' WHEN 3 THEN 'salt' WHEN 4 THEN 'coal' END AS value FROM p
        UNION ALL SELECT basin, ref, text, md, 'formation', formation FROM p WHERE formation IN ('Brand#12', 'Brand#34')"""},
    sql="""SELECT basin, type, value, ref, CASE WHEN md >= 100 THEN CAST(md AS VARCHAR) END AS depth FROM (
        SELECT *, row_number() OVER (PARTITION BY basin, type, value ORDER BY ref, text) AS r FROM s WHERE value IS NOT NULL) WHERE r = 1""")
def basin_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First passage of each rock and listed layer in each region, over sentences built of the report lines."""
    rock = F.element_at(F.array(*[F.lit(x) for x in ("clean sands", "grey claystone", "chalk", "rock salt", "black coal", "no sample")]), F.col("b") % 6 + 1)
    md = (50 * F.col("b") + F.col("well_id") % 40).cast("string")
    lines = b.lines(spark, sf_dir).select("well_id", (F.col("document_id") * 10 + F.col("seq")).alias("ref"), F.concat(F.lit("Drilled "), "formation", F.lit(", "), rock, F.lit(", to "), md, F.lit(" m.")).alias("text"))
    passages = lines.join(b.wells(spark, sf_dir).select("well_id", F.col("field").alias("basin")), "well_id")
    return lithology.suggestions(passages, ["Brand#12", "Brand#34"]).select("basin", "type", "value", "ref", F.get("depths", F.lit(0)).alias("depth"))


@query("age_near_name", sql="""
SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Upper Miocene' WHEN 1 THEN 'Miocene' WHEN 3 THEN 'Early Eocene' END AS age, CASE WHEN o_orderkey % 5 = 3 THEN CAST(1000 + o_custkey % 900 AS DOUBLE) END AS depth FROM orders
""")
def age_near_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The age that a sentence gives a layer, and the depth just before its name."""
    md = (1000 + F.col("well_id") % 900).cast("string")
    said = {
        0: ["The Tipam of Upper Miocene age lies above the Eocene."],
        1: ["Eocene beds, then Miocene Tipam sands."],
        2: ["Tipam sands; below them and after more than forty characters, Eocene."],
        3: ["Early Eocene rocks: ", md, "-m Tipam sand."],
        4: ["Eocene beds without a name."],
    }
    text = F.coalesce(*[F.when(F.col("id") % 5 == k, F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])) for k, parts in said.items()])
    rows = orders(spark, sf_dir).select("id", text.alias("text"))
    return rows.select("id", lithology.nearest_age(F.col("text"), "Tipam").alias("age"), lithology.depth_before(F.col("text"), "Tipam").alias("depth"))
