"""Claims of report texts held against tables: casing shoes, layers' tops, and what summaries and daily reports tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borelog.functions.text import inches

from . import joins

#: How texts state a casing's depth and a layer's top, and the suffix of each kind of unit.
CASING = r"(?i)(\d{1,2}(?: \d/\d{1,2})?)\s?(?:\"|”|''|inch|in\.?)\s*(?:casing|liner|conductor)\b[^.]{0,60}?\b(?:set|landed|cemented|run|installed|ran)\b[^.]{0,25}?\b(?:at|to|in|@)\s+(\d{2,4}(?:\.\d)?)\s?m\b"
TOP = r"\btop (?:of )?(?:the )?([A-ZÆØÅ][a-zæøåA-ZÆØÅ]+)\s+(Formation|Group|Fm)\b[^.;]{0,40}?\b(?:at|was at|came in at|encountered at|penetrated at)\s+(\d{3,4}(?:\.\d)?)\s?m\b(?!\s*(?:TVD|MSL|below sea|bsl))"
#: Metres that a text and a table may differ by, inches that are one size.
METRES, INCHES = 30.0, 0.01


def _all(text: Column, form: str, *groups: int) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(form), F.lit(g)).alias(f"g{g}") for g in groups])


def casing_claims(passages: DataFrame) -> DataFrame:
    """(…, said, od_in, md): the casing depths that each passage (well_id, ref, text) states."""
    rows = passages.withColumn("_c", F.explode(_all(F.col("text"), CASING, 0, 1, 2)))
    return rows.select(*passages.columns, F.col("_c.g0").alias("said"), inches(F.col("_c.g1")).alias("od_in"), F.col("_c.g2").cast("double").alias("md"))


def casing_conflicts(passages: DataFrame, casings: DataFrame, metres: float = METRES) -> DataFrame:
    """Casing claims (well_id, ref, said, text, od_in, md) that differ by over ``metres`` from the nearest shoe of that size and well in ``casings`` (well_id, od_in, shoe_md, ref), with it and the difference.

    Sizes within a hundredth of an inch are one: cells of that width are joined, each claim also with the two beside its own.
    Of shoes equally near the first by ref counts; a size that the table does not hold is no conflict."""
    cell = lambda c: F.floor(c / INCHES).cast("long")
    said = casing_claims(passages).withColumn("_cell", F.explode(F.array(*[cell(F.col("od_in")) + k for k in (-1, 0, 1)])))
    shoes = casings.select("well_id", F.col("od_in").alias("_od"), F.col("shoe_md").cast("double").alias("shoe_md"), F.col("ref").alias("table_ref"), cell(F.col("od_in")).alias("_cell")).where("shoe_md is not null")
    pairs = said.join(shoes, ["well_id", "_cell"]).where(F.abs(F.col("od_in") - F.col("_od")) < INCHES)
    near = F.min(F.struct(F.abs(F.col("md") - F.col("shoe_md")).alias("gap"), "table_ref", "shoe_md"))
    best = pairs.groupBy("well_id", "ref", "text", "said", "od_in", "md").agg(near.alias("n"))
    out = best.select("well_id", "ref", "text", "said", "od_in", "md", "n.shoe_md", "n.table_ref", (F.col("md") - F.col("n.shoe_md")).alias("delta"))
    return out.where(F.abs("delta") > metres)


def top_claims(passages: DataFrame) -> DataFrame:
    """(…, said, formation, md): the layers' tops that each passage states along the hole, with the layer's name as tables write it (``HUGIN FM``)."""
    rows = passages.withColumn("_c", F.explode(_all(F.col("text"), TOP, 0, 1, 2, 3)))
    key = F.concat(F.upper("_c.g1"), F.when(F.col("_c.g2") == "Group", " GP").otherwise(" FM"))
    return rows.select(*passages.columns, F.col("_c.g0").alias("said"), key.alias("formation"), F.col("_c.g3").cast("double").alias("md"))


def top_conflicts(passages: DataFrame, tops: DataFrame, metres: float = METRES) -> DataFrame:
    """Top claims that differ by over ``metres`` from the table (well_id, formation, top, ref; of several rows of a layer the last by ref counts): low up to three times that, medium beyond."""
    table = tops.groupBy("well_id", "formation").agg(F.max_by(F.struct("top", "ref"), "ref").alias("t")).select("well_id", "formation", F.col("t.top").alias("table_top"), F.col("t.ref").alias("table_ref")).where("table_top is not null")
    rows = top_claims(passages).join(table, ["well_id", "formation"]).withColumn("delta", F.col("md") - F.col("table_top")).where(F.abs("delta") > metres)
    return rows.withColumn("severity", F.when(F.abs("delta") < 3 * metres, "low").otherwise("medium"))


def report_conflicts(events: DataFrame, documents: DataFrame, metres: float = METRES) -> DataFrame:
    """Events (well_id, hazard, md, ref, document_id) of summaries that no daily report of the well tells within ``metres``, and the other way round, with a reference to the first report searched.

    ``documents`` is (well_id, document_id, summary); only wells with reports of both kinds are compared, and only events with a depth."""
    anchor = documents.groupBy("well_id").agg(F.min(F.when(F.col("summary"), F.col("document_id"))).alias("summary_ref"), F.min(F.when(~F.col("summary"), F.col("document_id"))).alias("daily_ref"), F.count_if(~F.col("summary")).alias("dailies"))
    both = anchor.where("summary_ref is not null and daily_ref is not null")
    rows = events.where("md is not null").join(documents.select("document_id", "summary"), "document_id").join(both.select("well_id"), "well_id", "left_semi")
    cols = ["well_id", "hazard", "md", "ref"]
    summary, daily = rows.where("summary").select(cols), rows.where("not summary").select(cols)
    only = joins.unmatched(summary, daily.select("well_id", "hazard", "md"), ["well_id", "hazard"], "md", metres).withColumn("severity", F.lit("medium"))
    other = joins.unmatched(daily, summary.select("well_id", "hazard", "md"), ["well_id", "hazard"], "md", metres).withColumn("severity", F.lit("low"))
    flags = only.unionByName(other).join(both, "well_id")
    return flags.select(*cols, "severity", F.when(F.col("severity") == "medium", F.col("daily_ref")).otherwise(F.col("summary_ref")).alias("checked_ref"), "dailies")


def differing_shoes(casings: DataFrame, least: float = 0.5, metres: float = METRES) -> DataFrame:
    """Casings of a well (well_id, casing_type, od_in, shoe_md, ref) whose shoe differs by over ``least`` between reports: the least and the greatest, with the first report of each."""
    rows = casings.where("shoe_md is not null").withColumn("at", F.round("shoe_md", 1))
    key = ["well_id", "casing_type", "od_in"]
    out = rows.groupBy(*key).agg(F.min(F.struct("at", "ref")).alias("low"), F.max("at").alias("high"))
    ends = rows.groupBy(*key, "at").agg(F.min("ref").alias("high_ref")).withColumnRenamed("at", "high")
    out = out.where(F.col("high") - F.col("low.at") > least).join(ends, [*key, "high"])
    return out.select(*key, F.col("low.at").alias("low"), "high", F.col("low.ref").alias("low_ref"), "high_ref", F.when(F.col("high") - F.col("low.at") > metres, "medium").otherwise("low").alias("severity"))


def depth_conflicts(reports: DataFrame, samples: DataFrame, metres: float = METRES, hour: int = 6, before_h: float = 2.0, rows: int = 360) -> DataFrame:
    """Reports (well_id, document_id, day, md) whose depth differs by over ``metres`` from the deepest of the last ``rows`` + 1 samples (well_id, t, md_m) up to ``hour`` o'clock, if the last of them is at most ``before_h`` hours old."""
    deepest = F.max(F.coalesce("md_m", F.lit(0.0))).over(Window.partitionBy("well_id").orderBy("t").rowsBetween(-rows, 0))
    seen = samples.withColumn("sensor", deepest).select("well_id", F.col("t").alias("sampled"), "sensor")
    asked = reports.where("md is not null").withColumn("until", F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + hour * 3600))
    out = joins.as_of(asked, seen, ["well_id"], "until", "sampled", ["sensor", "sampled"])
    out = out.where((F.unix_timestamp("until") - F.unix_timestamp("sampled") <= before_h * 3600)).withColumn("delta", F.col("md") - F.col("sensor"))
    return out.where(F.abs("delta") > metres).select("well_id", "document_id", "md", "sensor", "sampled", "delta")


def unseen_losses(losses: DataFrame, samples: DataFrame, drop: float = 5.0, minutes: int = 60, hours: int = 6, least: int = 10) -> DataFrame:
    """Reported losses (well_id, ref, t) after which the pit (well_id, t, pit_vol) never fell by ``drop``: from ``minutes`` before to ``hours`` after, from its first greatest volume on, with ``least`` values or more.

    Samples are joined by cells of the window's length, so a report meets three cells at most."""
    width = minutes * 60 + hours * 3600
    at = F.unix_micros(F.col("t").cast("timestamp")) / 1e6
    said = losses.where("t is not null").select("well_id", "ref", at.alias("told")).withColumn("_cell", F.explode(F.sequence(F.floor((F.col("told") - minutes * 60) / width), F.floor((F.col("told") + hours * 3600) / width))))
    pits = samples.where("pit_vol is not null").select("well_id", at.alias("at"), "pit_vol").withColumn("_cell", F.floor(F.col("at") / width))
    rows = said.join(pits, ["well_id", "_cell"]).where((F.col("at") >= F.col("told") - minutes * 60) & (F.col("at") <= F.col("told") + hours * 3600))
    key = ["well_id", "ref", "told"]
    peak = rows.groupBy(*key).agg(F.max(F.struct("pit_vol", (-F.col("at")).alias("less"))).alias("p"), F.count("*").alias("n")).where(F.col("n") >= least)
    after = rows.join(peak, key).where(F.col("at") >= -F.col("p.less"))
    out = after.groupBy(*key).agg((F.first("p.pit_vol") - F.min("pit_vol")).alias("fell"))
    return out.where(F.col("fell") < drop).select("well_id", "ref", "fell")
