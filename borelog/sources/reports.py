"""Daily reports: lines with times, tables that go on over lines, paragraphs, scraped checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_report(pages: DataFrame, key_pattern: str = r"(?im)report for\s*:?\s*(\S+)") -> DataFrame:
    """Pages (document_id, page, text) with ``report``: the key last seen, and ``part``: a number that grows where it changes."""
    w = Window.partitionBy("document_id").orderBy("page")
    key = F.nullif(F.regexp_extract("text", key_pattern, 1), F.lit(""))
    rows = pages.withColumn("report", F.last(key, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("part", F.sum(F.when(F.col("report").eqNullSafe(F.lag("report").over(w)), 0).otherwise(1)).over(w))


def stamp(day: Column, clock: Column, start_hour: int = 6) -> Column:
    """``hh:mm`` on a report's day; times before the day's start belong to the next day, 24:00 is its end."""
    hour, minute = (F.regexp_extract(clock, r"^\s*(\d{1,2}):(\d{2})", g).try_cast("int") for g in (1, 2))
    late = F.when(hour < start_hour, 1).otherwise(0)
    ok = hour.between(0, 24) & minute.between(0, 59)
    return F.when(ok, F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + (late * 24 + hour) * 3600 + minute * 60))


def timed_lines(lines: DataFrame) -> DataFrame:
    """Lines (document_id, day, seq, line) as activities: rows ``hh:mm - hh:mm text``; a line without times goes on from the row before."""
    times = r"^\s*(\d{1,2}:\d{2})\s*-\s*(\d{1,2}:\d{2})\s*:?\s*(.*)$"
    rows = lines.withColumn("_new", F.col("line").rlike(times).cast("int"))
    rows = rows.withColumn("activity", F.sum("_new").over(Window.partitionBy("document_id").orderBy("seq"))).where("activity > 0")
    part = F.when(F.col("_new") == 1, F.regexp_extract("line", times, 3)).otherwise(F.trim("line"))
    grouped = rows.groupBy("document_id", "day", "activity").agg(F.min_by("line", "seq").alias("first"), F.sort_array(F.collect_list(F.struct("seq", part.alias("part")))).alias("parts"))
    return grouped.select("document_id", "activity", stamp(F.col("day"), F.regexp_extract("first", times, 1)).alias("t_start"), stamp(F.col("day"), F.regexp_extract("first", times, 2)).alias("t_end"), F.trim(F.array_join(F.transform("parts", lambda p: p["part"]), " ")).alias("text"))


def duration_hours(start: Column, end: Column) -> Column:
    """Hours of a line, null unless above 0 and at most 24."""
    h = (F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600
    return F.when((h > 0) & (h <= 24), F.round(h, 2))


def joined_paragraphs(text: Column, least: int = 30, long: int = 200) -> Column:
    """Wrapped lines joined; a blank line ends a paragraph, as does a sentence's end beyond ``long`` characters; short ones go."""
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, line: Column) -> Column:
        grown = F.trim(F.concat_ws(" ", s["now"], F.trim(line)))
        ends = (F.trim(line) == "") | ((F.length(grown) > long) & grown.rlike(r"[.!?]$"))
        return F.struct(F.when(ends, "").otherwise(grown).alias("now"), F.when(ends, F.concat(s["done"], F.array(grown))).otherwise(s["done"]).alias("done"))

    folded = F.aggregate(F.split(text, r"\r?\n"), start, step, lambda s: F.concat(s["done"], F.array(s["now"])))
    return F.filter(folded, lambda p: F.length(p) >= least)


def ocr_mean(words: DataFrame) -> DataFrame:
    """(document_id, page, text, ocr) from words (document_id, page, place, word, conf): blanks and negative confidences left out."""
    good = words.where("conf >= 0 and trim(word) <> ''").groupBy("document_id", "page").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("w"), F.avg("conf").alias("ocr"))
    return good.select("document_id", "page", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"), "ocr")


def mud_checks(pages: DataFrame) -> DataFrame:
    """Mud weights stated on report pages, in ppg within 7 to 20."""
    from borelog.functions import units

    rows = pages.select("document_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?im)(?:mud weight|\bMW)\s*:?\s*(\d{1,2}(?:\.\d+)?\s*(?:ppg|sg))"))).alias("m"))
    value, unit = F.regexp_extract("m", r"([\d.]+)", 1).try_cast("double"), F.regexp_extract("m", "(?i)(ppg|sg)", 1)
    return rows.select("document_id", value.alias("raw_value"), unit.alias("raw_unit"), F.round(units.mud_weight(value, unit), 3).alias("mw_ppg")).where("mw_ppg is not null")


def incident_records(lines: DataFrame) -> DataFrame:
    """Records of labelled lines (``Date:`` starts one) as fields and remarks, from lines (document_id, seq, line)."""
    w = Window.partitionBy("document_id").orderBy("seq")
    rows = lines.withColumn("record", F.sum(F.col("line").rlike(r"(?i)^\s*date\s*:").cast("int")).over(w)).where("record > 0")
    label = F.regexp_extract("line", r"^\s*([A-Za-z ]{3,30}?)\s*:\s*(.*)$", 1)
    rows = rows.withColumn("_label", F.nullif(F.lower(label), F.lit(""))).withColumn("field", F.last("_label", ignorenulls=True).over(Window.partitionBy("document_id", "record").orderBy("seq")))
    value = F.when(F.col("_label").isNotNull(), F.regexp_extract("line", r"^\s*[A-Za-z ]{3,30}?\s*:\s*(.*)$", 1)).otherwise(F.trim("line"))
    parts = rows.groupBy("document_id", "record", "field").agg(F.sort_array(F.collect_list(F.struct("seq", value.alias("v")))).alias("vs"))
    parts = parts.withColumn("value", F.trim(F.array_join(F.transform("vs", lambda v: v["v"]), " ")))
    return parts.groupBy("document_id", "record").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
