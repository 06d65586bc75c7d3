"""The domain tables as views of the driver's star schema, in DataFrames and in SQL.

Wells are customers, reports are orders, layers are part brands, problems are part types, sensor samples are events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    places = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    key = F.col("c_custkey")
    return c.join(F.broadcast(places), c["c_nationkey"] == places["n_nationkey"]).select(
        key.alias("well_id"), F.col("c_name").alias("name"), F.col("n_name").alias("country"), F.col("r_name").alias("field"), F.col("c_mktsegment").alias("source"),
        (1000 + F.abs("c_acctbal")).alias("td"), (58 + (key * 37 % 997).cast("double") / 997.0).alias("lat"), (2 + (key * 53 % 1009).cast("double") / 504.5).alias("lon"),
        F.floor(key / 3).cast("long").alias("family"),
    )


def spuds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("well_id")).agg(F.min(F.col("o_orderdate").cast("date")).alias("spud"))


def documented(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).select(F.col("o_custkey").alias("well_id")).distinct()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report lines: order lines with their order and part."""
    lines, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    p = p.withColumn("b", F.regexp_extract("p_brand", r"(\d+)", 1).cast("int"))  # once for a part, not for each line
    joined = lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).join(p, lines["l_partkey"] == p["p_partkey"])
    return joined.select(
        F.col("o_custkey").alias("well_id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("reported"),
        F.col("l_linenumber").alias("seq"), F.col("p_brand").alias("formation"), "b", F.col("p_type").alias("hazard"), F.col("p_name").alias("p_name"),
        F.col("l_quantity").alias("quantity"), (F.col("l_discount") + 0.0).alias("discount"), (F.col("l_tax") + 0.0).alias("tax"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("state"), F.col("l_shipdate").alias("shipped"), F.col("l_extendedprice").alias("price"),
    )


def tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of each well, with base and level."""
    rows = lines(spark, sf_dir).select("well_id", "formation", "b").distinct()
    top = (50 * F.col("b") + F.col("well_id") % 40).cast("double")
    rows = rows.withColumn("top", top).join(wells(spark, sf_dir).select("well_id", "td"), "well_id")
    base = F.coalesce(F.lead("top").over(Window.partitionBy("well_id").orderBy("top")), F.greatest("td", F.col("top") + 50))
    level = F.when(F.col("b") % 5 == 0, "GROUP").otherwise("FORMATION")
    return rows.select("well_id", "formation", "b", "top", base.alias("base"), level.alias("level"))


def events(spark: SparkSession, sf_dir: str, trusted: bool = True) -> DataFrame:
    """Problem events; ``trusted`` leaves out those that wait for review."""
    rows = lines(spark, sf_dir).where((F.col("seq") == 1) & (F.col("flag") == "A"))
    md = 50 * F.col("b") + F.col("well_id") % 40 + F.col("quantity")
    rows = rows.select("well_id", "document_id", "kind", "formation", "hazard", md.alias("md"), (F.col("state") == "O").alias("needs_review"), F.col("shipped").cast("date").alias("day")).distinct()
    return rows.where(~F.col("needs_review")) if trusted else rows


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("flag", "state")
    outcome = F.when(key == "AF", "resolved").when(key == "AO", "partial").when(key == "NF", "unresolved").when(key == "NO", "unknown").when(key == "RF", "worsened").otherwise("resolved")
    days = F.datediff("shipped", "reported")
    rows = lines(spark, sf_dir).distinct().withColumn("outcome", outcome)
    hours = F.when(F.col("outcome").isin("resolved", "partial") & (days >= 0), (days * 24).cast("double"))
    return rows.select("well_id", "document_id", "seq", "formation", "hazard", F.split("p_name", " ").alias("action_types"), "outcome", hours.alias("hours"), "quantity", "shipped")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor rows: one channel, a second one from the JSON, and whether mud circulates."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("well_id"), F.col("ts").alias("t"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"), (F.col("event_type") != "error").alias("flowing"))


CTE = {
    "well": """SELECT c_custkey AS well_id, c_name AS name, n_name AS country, r_name AS field, c_mktsegment AS source, 1000 + abs(c_acctbal) AS td,
        58 + CAST(c_custkey * 37 % 997 AS DOUBLE) / 997e0 AS lat, 2 + CAST(c_custkey * 53 % 1009 AS DOUBLE) / 504.5e0 AS lon, c_custkey // 3 AS family
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "spud": "SELECT o_custkey AS well_id, min(CAST(o_orderdate AS DATE)) AS spud FROM orders GROUP BY 1",
    "documented": "SELECT DISTINCT o_custkey AS well_id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "line": """SELECT o_custkey AS well_id, o_orderkey AS document_id, o_orderpriority AS kind, o_orderdate AS reported, l_linenumber AS seq, p_brand AS formation,
        CAST(substr(p_brand, 7) AS INTEGER) AS b, p_type AS hazard, p_name, l_quantity AS quantity, l_discount + 0.0 AS discount, l_tax + 0.0 AS tax,
        l_returnflag AS flag, l_linestatus AS state, l_shipdate AS shipped, l_extendedprice AS price
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "top": """SELECT well_id, formation, b, top, coalesce(lead(top) OVER (PARTITION BY well_id ORDER BY top), greatest(td, top + 50)) AS base,
        CASE WHEN b % 5 = 0 THEN 'GROUP' ELSE 'FORMATION' END AS level
        FROM (SELECT DISTINCT well_id, formation, b, CAST(50 * b + well_id % 40 AS DOUBLE) AS top FROM line) JOIN well USING (well_id)""",
    "event_all": """SELECT DISTINCT well_id, document_id, kind, formation, hazard, 50 * b + well_id % 40 + quantity AS md, state = 'O' AS needs_review, CAST(shipped AS DATE) AS day
        FROM line WHERE seq = 1 AND flag = 'A'""",
    "event": "SELECT * FROM event_all WHERE NOT needs_review",
    "episode": """SELECT well_id, document_id, seq, formation, hazard, string_split(p_name, ' ') AS action_types, outcome, quantity, shipped,
        CASE WHEN outcome IN ('resolved', 'partial') AND CAST(shipped AS DATE) >= CAST(reported AS DATE) THEN CAST((CAST(shipped AS DATE) - CAST(reported AS DATE)) * 24 AS DOUBLE) END AS hours
        FROM (SELECT DISTINCT *, CASE flag || state WHEN 'AF' THEN 'resolved' WHEN 'AO' THEN 'partial' WHEN 'NF' THEN 'unresolved' WHEN 'NO' THEN 'unknown' WHEN 'RF' THEN 'worsened' ELSE 'resolved' END AS outcome FROM line)""",
    "sample": """SELECT event_id, user_id AS well_id, ts AS t, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type <> 'error' AS flowing FROM events""",
}
NEEDS = {"top": ("line", "well"), "event_all": ("line",), "event": ("event_all",), "episode": ("line",)}


def sql(query: str, *names: str, more: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``query`` below the common table expressions it names, in the order they need each other, then ``more``."""
    seen: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, ()):
            add(other)
        if name not in seen:
            seen.append(name)

    for name in names:
        add(name)
    parts = [f"{k} AS ({CTE[k]})" for k in seen] + [f"{k} AS ({v})" for k, v in (more or {}).items()]
    return ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n" if parts else "") + query
