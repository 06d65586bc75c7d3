"""Rig feeds: WITSML logs and WITS level 0 records, both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borelog.functions import units

#: What each channel's curves are called in WITSML logs.
CURVES = {
    "time": ["TIME", "DATETIME", "INDEX_TIME"],
    "md_m": ["DEPT", "DEPTH", "DMEA", "HDTH", "HOLE_DEPTH", "DEPTH_HOLE", "MD"],
    "bit_md_m": ["DBTM", "BDEP", "BIT_DEPTH", "DEPTH_BIT", "BITDEPTH"],
    "rop": ["ROPA", "ROP", "ROP_AVG"],
    "wob": ["SWOB", "WOBA", "WOB", "WOB_AVG"],
    "rpm": ["RPMA", "RPM", "TRPM", "SURF_RPM"],
    "torque": ["TQA", "TORQUE", "STOR", "TQ", "TORQUE_AVG"],
    "spp": ["SPPA", "SPP", "STANDPIPE_PRESSURE"],
    "flow_in": ["MFIA", "TFLO", "FLOWIN", "FLOW_IN", "MUD_FLOW_IN"],
    "pit_vol": ["TVA", "PVT", "TVT", "PITVOL", "PIT_VOL", "ACTIVE_PIT_VOLUME"],
    "hookload": ["HKLA", "HKLD", "HOOKLOAD", "HOOK_LOAD"],
    "mw_in_ppg": ["MWIN"],
}
MNEMONICS = {name: channel for channel, names in CURVES.items() for name in names}
#: Items of WITS record 01, and the unit of each in a sender's unit set (the records carry none).
WITS0 = {"0108": "bit_md_m", "0110": "md_m", "0113": "rop", "0114": "hookload", "0116": "wob", "0118": "torque", "0120": "rpm", "0121": "spp", "0126": "pit_vol", "0130": "flow_in"}
WITS0_UNITS = {
    "metric": {"md_m": "m", "bit_md_m": "m", "rop": "m/h", "hookload": "kN", "wob": "kN", "torque": "kN.m", "rpm": "rpm", "spp": "kPa", "pit_vol": "m3", "flow_in": "L/min"},
    "imperial": {"md_m": "ft", "bit_md_m": "ft", "rop": "ft/h", "hookload": "klbf", "wob": "klbf", "torque": "kft.lbf", "rpm": "rpm", "spp": "psi", "pit_vol": "bbl", "flow_in": "gal/min"},
}
#: Fixed value: rows that one post may hold.
MOST_ROWS = 20_000
LOG = r"(?s)<(?:\w+:)?log\b[^>]*>(.*?)</(?:\w+:)?log>"
ROW = r"(?s)<(?:\w+:)?data>(.*?)</(?:\w+:)?data>"
RECORD = r"(?s)&&(.*?)!!"
CHANNELS = ["md_m", "bit_md_m", "rop", "wob", "rpm", "torque", "spp", "flow_in", "pit_vol", "hookload", "mw_in_ppg"]


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _tag(xml: Column, name: str) -> Column:
    return F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{name}\b[^>]*>(.*?)</(?:\w+:)?{name}>", 1)


def refusal(payload: Column, most: int = MOST_ROWS) -> Column:
    """Why a post is refused whole, or null: entities of its own, no log and no record in it, or more rows than ``most``."""
    rows = F.regexp_count(payload, F.lit(ROW)) + F.regexp_count(payload, F.lit(RECORD))
    return (
        F.when(payload.isNull() | (F.trim(payload) == ""), "empty").when(payload.rlike("(?i)<!(DOCTYPE|ENTITY)"), "entities")
        .when(~payload.rlike(LOG) & ~payload.rlike(RECORD), "no log or record").when(rows > most, "too many rows")
    )


def witsml(payloads: DataFrame, xml: str = "xml", most: int = MOST_ROWS) -> DataFrame:
    """(well, t, row, channel, raw, unit, value, unknown) for every reading of the logs in ``payloads``.

    A payload with a ``refusal`` gives no rows. Null tokens are left out, an unknown curve or unit gives
    no value and is named in ``unknown``; the first of several curves for one channel counts."""
    safe = payloads.where(refusal(F.col(xml), most).isNull()).withColumn("_p", F.monotonically_increasing_id())
    logs = safe.select("_p", F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(LOG))).alias("_l", "log"))
    upper = lambda name: F.transform(F.split(_tag(F.col("log"), name), ","), lambda m: F.upper(F.trim(m)))
    rows = logs.select("_p", "_l", _tag(F.col("log"), "nameWell").alias("well"), upper("mnemonicList").alias("names"), F.transform(F.split(_tag(F.col("log"), "unitList"), ","), lambda x: F.trim(x)).alias("units"), F.posexplode(F.regexp_extract_all("log", F.lit(ROW))).alias("row", "data"))
    rows = rows.withColumn("values", F.split("data", ",")).withColumn("z", F.arrays_zip("names", "units", "values"))
    at = F.get(F.filter("z", lambda c: F.element_at(_map(MNEMONICS), c["names"]) == "time"), F.lit(0))["values"]
    each = rows.select("_p", "_l", "well", "row", instant(at).alias("t"), F.posexplode("z").alias("i", "c"))
    each = each.select("_p", "_l", "well", "row", "t", "i", F.col("c.names").alias("curve"), F.element_at(_map(MNEMONICS), F.col("c.names")).alias("channel"), F.trim("c.values").alias("raw"), F.col("c.units").alias("unit"))
    each = each.where(~F.coalesce(F.col("channel") == "time", F.lit(False)) & ~F.col("raw").isin("", "-999.25", "-9999"))
    each = units.convert(each.withColumn("number", F.col("raw").try_cast("double")), "number", "unit")
    first = F.row_number().over(Window.partitionBy("_p", "_l", "row", "channel").orderBy("i"))
    unknown = F.when(F.col("channel").isNull(), F.col("curve")).when(F.col("converted").isNull(), F.concat_ws(" ", "channel", "unit"))
    return each.withColumn("_first", first).where("_first = 1 or channel is null").select("well", "t", "row", "channel", "raw", "unit", F.when(F.col("channel").isNotNull(), F.col("converted")).alias("value"), unknown.alias("unknown"))


def instant(text: Column) -> Column:
    """ISO time; without a zone it is UTC; null for anything else."""
    return F.coalesce(F.try_to_timestamp(F.trim(text)), F.try_to_timestamp(F.concat(F.trim(text), F.lit("Z"))))


def samples(readings: DataFrame) -> DataFrame:
    """Readings as one row for each well and time; md_m falls back to the bit's depth."""
    wide = readings.where("channel is not null").groupBy("well", "t").pivot("channel", CHANNELS).agg(F.first("value", ignorenulls=True))
    return wide.withColumn("md_m", F.coalesce("md_m", "bit_md_m"))


def wits0(payloads: DataFrame, text: str = "text", well: str = "well", unit_set: str = "metric", most: int = MOST_ROWS) -> DataFrame:
    """(well, block, t, channel, value) of the items of record 01 in ``&& ... !!`` blocks, in the units of the replay.

    The sender says which unit set it uses. A payload with a ``refusal`` gives no rows; other items, and values that are no numbers, are left out."""
    unit_of = _map(WITS0_UNITS[unit_set])
    safe = payloads.where(refusal(F.col(text), most).isNull())
    blocks = safe.select(F.col(well).alias("well"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(RECORD))).alias("block", "body"))
    lines = F.filter(F.transform(F.split("body", r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^01\d{2}"))
    items = F.transform(lines, lambda x: F.struct(F.substring(x, 1, 4).alias("code"), F.trim(F.substr(x, F.lit(5))).alias("raw")))
    rows = blocks.withColumn("items", items)
    pick = lambda code: F.get(F.filter("items", lambda i: i["code"] == code), F.lit(0))["raw"]
    day, clock = pick("0105"), pick("0106")
    rows = rows.withColumn("t", F.when((F.length(day) == 6) & (F.length(clock) >= 6), F.try_to_timestamp(F.concat(day, F.substring(clock, 1, 6)), F.lit("yyMMddHHmmss"))))
    each = rows.select("well", "block", "t", F.explode("items").alias("i")).withColumn("channel", F.element_at(_map(WITS0), F.col("i.code"))).where("channel is not null")
    each = units.convert(each.withColumns({"number": F.col("i.raw").try_cast("double"), "unit": unit_of[F.col("channel")]}), "number")
    return each.select("well", "block", "t", "channel", F.col("converted").alias("value")).where("value is not null")


def chunked(rows: DataFrame, rows_each: int) -> DataFrame:
    """``rows`` (well, t, …) with ``chunk``: runs of at most ``rows_each`` rows of a well that follow each other in time, ascending with it. No well comes into one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "well", "t").sortWithinPartitions("well", "t").withColumn("chunk", F.expr(f"monotonically_increasing_id() div {rows_each}"))


def to_witsml(rows: DataFrame, channels: list[str], rows_each: int = 5000) -> DataFrame:
    """(well, chunk, xml): logs of at most ``rows_each`` rows (well, t, channels...) each, in order of ``chunk``, which witsml() reads back."""
    names = {"md_m": ("DEPT", "m"), "bit_md_m": ("DBTM", "m"), "rop": ("ROPA", "m/h"), "wob": ("SWOB", "klbf"), "rpm": ("RPMA", "rpm"), "torque": ("TQA", "kft.lbf"), "spp": ("SPPA", "psi"), "flow_in": ("MFIA", "gal/min"), "pit_vol": ("TVA", "bbl"), "hookload": ("HKLA", "klbf"), "mw_in_ppg": ("MWIN", "ppg")}
    line = F.concat(F.lit("<data>"), F.concat_ws(",", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"), *[F.coalesce(F.col(c).cast("string"), F.lit("-999.25")) for c in channels]), F.lit("</data>"))
    head = f"<logData><mnemonicList>TIME,{','.join(names[c][0] for c in channels)}</mnemonicList><unitList>s,{','.join(names[c][1] for c in channels)}</unitList>"
    logs = chunked(rows, rows_each).groupBy("well", "chunk").agg(F.sort_array(F.collect_list(F.struct("t", line.alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return logs.select("well", "chunk", F.concat(F.lit("<logs><log><nameWell>"), "well", F.lit("</nameWell>" + head), body, F.lit("</logData></log></logs>")).alias("xml"))


def to_wits0(rows: DataFrame, channels: list[str], unit_set: str = "metric", rows_each: int = 5000) -> DataFrame:
    """(well, chunk, text): WITS level 0 records of at most ``rows_each`` rows (well, t, channels...) each, in the units of ``unit_set``, which wits0() reads back."""
    codes = {v: k for k, v in WITS0.items()}
    value = lambda c: F.col(c) / units.factor(F.lit(WITS0_UNITS[unit_set][c]))
    items = [F.when(F.col(c).isNotNull(), F.concat(F.lit(codes[c]), value(c).cast("string"))) for c in channels]
    record = F.concat_ws("\n", F.lit("&&"), F.concat(F.lit("0105"), F.date_format("t", "yyMMdd")), F.concat(F.lit("0106"), F.date_format("t", "HHmmss")), *items, F.lit("!!"))
    texts = chunked(rows, rows_each).groupBy("well", "chunk").agg(F.sort_array(F.collect_list(F.struct("t", record.alias("r")))).alias("rs"))
    return texts.select("well", "chunk", F.array_join(F.transform("rs", lambda x: x["r"]), "\n").alias("text"))
