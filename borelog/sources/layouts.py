"""Records out of the lines of reports: time tables with continuation lines, casing and leak-off rows, incident volumes of three layouts.

Each layout is a small automaton over lines (which table is open, which record, whether remarks go on). Its states are run by
``operators.scans``, so a document of any length is read in pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borelog.functions import units
from borelog.operators.scans import PIECE, scanned

#: How time tables begin and end, their two row forms, depths in feet, and phases and codes named in a row.
STARTS = r"^(TIME BREAKDOWN|Operations Summary)"
STOPS = r"^(TOTAL HRS|Management Summary|www\.wellez|Comments|Casing/Tubular|Bit Information|Mud Information|Mud Reports|24 Hr Summary)"
ROW_LONG = r"^(\d{1,2}:\d{2})\s+(\d{1,2}:\d{2})\s+(\d+\.\d{2})\s+([\d,]+)\s+([A-Z0-9][A-Z0-9-]{0,9})\s+(.*?)(\s+X)?$"
ROW_SHORT = r"^(\d{1,2}:\d{2})\s+(\d{1,2}:\d{2})\s+(\d+(?:\.\d+)?)\s+(.*)$"
FEET = r"([\d,]{2,7})(?:\.\d+)?\s?['’]"
PHASE = r"\b(Production|Intermediate|Surface|Conductor) (?:Drilling|Casing)?\s*(Drilling|Trips|Reaming|Cond Mud & Circ|Fishing|Cementing|Other|Rig Repair|Lost Circulation|Stuck Pipe|Well Control|Logging|Casing)\b"
#: Casing, leak-off and mud rows of daily reports.
CASING = r"^(Conductor|Surface|Intermediate|Production|Liner)\s+(\d+\.\d+)\s+[\d.]+\s+\S+\s+([\d,]+)\s+([\d,]+)\s*$"
LAST_CASING = r"Last Casing:\s*(\d+\.\d+)\s+at\s+([\d,]+)"
LEAK_OFF = r"Last Casing:\s*[\d.]+\s+at\s+([\d,]+)\s+LOT \(lbs/gal\):\s*(\d{1,2}\.\d{1,2})"
MUD = [(r"(?m)TIME MW FV[^\n]*\n\d{1,2}:\d{2}\s+(\d{1,2}\.\d)", 1), (r"(?m)Mud Pits, Type:[^\n]*\n(\d{1,2}\.\d{1,2})\s", 9), (r"(?m)^\d{2}-[A-Za-z]{3}-\d{2} \d{1,2}:\d{2} (\d{1,2}\.\d{1,2}) ", 9)]
#: Headers of incident records, where remarks begin and what ends them.
LABELLED = {
    "date_raw operator": r"^Date:\s*([\d]{1,2}[-/][A-Za-z]{3}[-/][\d]{2,4})\s+Operator:\s*(.*)$",
    "investigation activity": r"^(?:Investigation|MMS Investigation Report):\s*(.*?)\s+Activity:\s*(.*)$",
    "lease events": r"^Lease:\s*(.*?)\s+Event\(s\):\s*(.*)$",
    "area operation": r"^Area:\s*(.*?)\s+Operation:\s*(.*)$",
    "block cause": r"^Block:\s*(.*?)\s+Cause:\s*(.*)$",
    "rig water_depth": r"^Rig/Platform:\s*(.*?)\s+Water Depth:\s*(.*)$",
}
COMPACT = r"^([A-Za-z][A-Za-z .'/-]{2,30}?)\s+(\d{2}-\d{2}-\d{2})\s+([A-Za-z/ ]+?)\s+([A-Za-z/ ]+?)\s+(\d+)\s*$"
PAGE_NUMBER, SECTION = r"^\d{1,4}$", r"^[A-Z][A-Za-z ]+[-–]\s*\d{4}$|^[A-Z][A-Za-z ()]*\d+ total\)$|Collision No\. \d+"
AREAS = [
    "South Marsh Island", "South Timbalier", "South Pass", "Eugene Island", "West Cameron", "East Cameron", "Ship Shoal", "West Delta", "Main Pass", "Vermilion", "Grand Isle", "High Island", "Galveston",
    "Matagorda Island", "Mustang Island", "Brazos", "Viosca Knoll", "Mississippi Canyon", "Green Canyon", "Garden Banks", "Ewing Bank", "East Breaks", "Breton Sound", "Chandeleur", "Mobile", "Sabine Pass", "Pelto",
]
SCANNED = r"\b(" + "|".join(AREAS) + r")\s+(\d{2}-\d{2}-\d{2})\b"
#: Fixed value: remarks of so many characters or fewer are none.
LEAST_REMARKS = 20


def _plain(number: Column) -> Column:
    return F.replace(number, F.lit(","), F.lit("")).try_cast("double")


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def activities(lines: DataFrame, piece: int = PIECE) -> DataFrame:
    """Rows of time tables from lines (document_id, page, seq, line), numbered within a document.

    A table is open from a start mark to a stop mark or the page's end. A line in it that is no row, or of neither form, goes
    on from the row before, also over pages; column headings do not. md_ft is the row's end depth, else the deepest depth
    that its text states."""
    rows = lines.withColumn("s", F.trim("line"))
    s = F.col("s")
    mark = F.when(s.rlike(STARTS), True).when(s.rlike(STOPS), False)
    rows = scanned(rows, ["document_id", "page"], "seq", last={"_open": mark}, piece=piece)
    inside = F.coalesce(F.col("_open"), F.lit(False)) & ~s.rlike(STARTS) & ~s.rlike(STOPS)
    long = s.rlike(ROW_LONG)
    is_row = inside & (long | s.rlike(ROW_SHORT))
    rows = scanned(rows.withColumns({"_inside": inside, "_row": is_row}), ["document_id"], "seq", total={"row": F.col("_row").cast("int")}, piece=piece)
    goes_on = ~F.col("_row") & (s != "") & ~s.rlike(r"^(FROM|From To)")
    rows = rows.where(F.col("_inside") & (F.col("row") > 0) & (F.col("_row") | goes_on))
    at = lambda form, g: F.regexp_extract("s", form, g)
    text = F.when(F.col("_row") & long, F.trim(at(ROW_LONG, 6))).when(F.col("_row"), F.trim(at(ROW_SHORT, 4))).otherwise(s)
    head = F.when(F.col("_row"), F.struct("page", "s", long.alias("long")))
    each = rows.groupBy("document_id", "row").agg(F.max(head).alias("h"), F.sort_array(F.collect_list(F.struct("seq", text.alias("text")))).alias("parts"))
    each = each.select("document_id", "row", "h.page", "h.s", "h.long", F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))
    is_long = F.col("long")
    code = F.when(is_long, at(ROW_LONG, 5)).otherwise(_some(F.regexp_extract("text", PHASE, 2)))
    depths = F.filter(F.transform(F.regexp_extract_all("text", F.lit(FEET), F.lit(1)), lambda d: F.replace(d, F.lit(","), F.lit(""))), lambda d: d.rlike(r"^\d+$"))
    end = F.when(is_long, _plain(at(ROW_LONG, 4)))
    return each.select(
        "document_id", "row", "page", at(ROW_SHORT, 1).alias("t0"), at(ROW_SHORT, 2).alias("t1"), at(ROW_SHORT, 3).try_cast("double").alias("hours"), end.alias("end_md_ft"), code.alias("code"),
        F.when(~is_long, _some(F.regexp_extract("text", PHASE, 1))).alias("phase"), (is_long & at(ROW_LONG, 7).rlike("X")).alias("npt"), "text",
        F.coalesce(F.when(end != 0, end), F.array_max(F.transform(depths, lambda d: d.cast("double")))).alias("md_ft"),
    )


def clock_times(rows: DataFrame, day: str, start_hour: int = 6) -> DataFrame:
    """``activities`` with t_start and t_end: a report of ``day`` tells of the 24 hours that end at its ``start_hour``."""
    hour, minute = (F.regexp_extract("t0", r"^(\d{1,2}):(\d{2})", g).cast("int") for g in (1, 2))
    offset = (hour - 24) * 3600 + minute * 60
    start = F.unix_timestamp(F.col(day).cast("timestamp")) + F.when(offset < (start_hour - 24) * 3600, offset + 86_400).otherwise(offset)
    return rows.withColumns({"t_start": F.timestamp_seconds(start), "t_end": F.timestamp_seconds(start + F.col("hours") * 3600)})


def casing_rows(lines: DataFrame) -> DataFrame:
    """Casing strings of report lines (document_id, seq, line): type, diameter (in), shoe and its vertical depth (ft)."""
    line = F.col("line")
    row = F.when(line.rlike(CASING), F.struct(*[F.regexp_extract(line, CASING, g).alias(n) for g, n in ((1, "type"), (2, "od"), (3, "shoe"), (4, "tvd"))]))
    row = F.coalesce(row, F.when(line.rlike(LAST_CASING), F.struct(F.lit("Last casing").alias("type"), F.regexp_extract(line, LAST_CASING, 1).alias("od"), F.regexp_extract(line, LAST_CASING, 2).alias("shoe"), F.lit(None).cast("string").alias("tvd"))))
    rows = lines.withColumn("_c", row).where("_c is not null")
    return rows.select("document_id", "seq", "_c.type", F.col("_c.od").cast("double").alias("od_in"), _plain(F.col("_c.shoe")).alias("shoe_ft"), _plain(F.col("_c.tvd")).alias("tvd_ft"), F.trim("line").alias("quote"))


def leak_off_tests(lines: DataFrame) -> DataFrame:
    """Leak-off tests of report headers, each once a well (columns well_id, document_id, seq, line): the first report's."""
    rows = lines.where(F.col("line").rlike(LEAK_OFF)).select("well_id", "document_id", "seq", F.regexp_extract("line", LEAK_OFF, 2).cast("double").alias("emw_ppg"), _plain(F.regexp_extract("line", LEAK_OFF, 1)).alias("shoe_ft"), F.regexp_extract("line", LEAK_OFF, 0).alias("quote"))
    return rows.groupBy("well_id", "emw_ppg", "shoe_ft").agg(F.min(F.struct("document_id", "seq", "quote")).alias("r")).select("well_id", "emw_ppg", "shoe_ft", "r.document_id", "r.quote")


def mud_weights(pages: DataFrame) -> DataFrame:
    """Mud weights of report pages (document_id, page, text) in the three forms of daily reports, within 7 to 20 ppg."""
    found = F.flatten(F.array(*[F.slice(F.regexp_extract_all("text", F.lit(form), F.lit(1)), 1, most) for form, most in MUD]))
    rows = pages.select("document_id", "page", F.explode(found).alias("m")).withColumn("mw_ppg", units.mud_weight(F.col("m").cast("double"), F.lit("ppg")))
    return rows.where("mw_ppg is not null").select("document_id", "page", "mw_ppg")


def _with_remarks(rows: DataFrame, header: Column, stop: Column, remarks: str, fields: Column, piece: int) -> DataFrame:
    """(document_id, page, record, …): the header's and fields' rows of each record, and its remarks: what follows ``remarks`` up to a stop or the next header."""
    s = F.col("s")
    key = ["document_id", "page"]
    kind = F.when(header, "head").when(stop, "stop").when(fields, "field").when(s.rlike(remarks), "remarks").otherwise("text")
    rows = rows.where(s != "").withColumn("_kind", kind)
    going = F.when(F.col("_kind").isin("head", "stop"), False).when(F.col("_kind") == "remarks", True)
    rows = scanned(rows, key, "seq", last={"_going": going}, total={"record": (F.col("_kind") == "head").cast("int")}, piece=piece)
    said = F.when(F.col("_kind") == "remarks", _some(F.regexp_extract("s", r"(?i)^Remarks:\s*(.*)$", 1))).when((F.col("_kind") == "text") & F.col("_going"), s)
    return rows.where("record > 0").withColumn("_said", said)


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.filter(parts, lambda p: p["said"].isNotNull())), lambda p: p["said"]), " ")


def labelled_incidents(lines: DataFrame, piece: int = PIECE) -> DataFrame:
    """Incident records of labelled fields (volumes of 1995 to 2000) from lines (document_id, page, seq, line); a record does not cross pages."""
    rows = lines.withColumn("s", F.trim("line"))
    s = F.col("s")
    forms = list(LABELLED.values())
    fields = F.lit(False)
    for form in forms[1:]:
        fields = fields | s.rlike(form)
    rows = _with_remarks(rows, s.rlike(forms[0]), s.rlike(PAGE_NUMBER) | s.rlike(SECTION) | s.contains("Region"), r"^Remarks:", fields, piece)
    picks = []
    for names, form in LABELLED.items():
        for g, name in enumerate(names.split(" "), 1):
            picks.append(F.max_by(F.when(s.rlike(form) & F.col("_kind").isin("head", "field"), F.regexp_extract(s, form, g)), F.when(s.rlike(form) & F.col("_kind").isin("head", "field"), F.col("seq"))).alias(name))
    out = rows.groupBy("document_id", "page", "record").agg(*picks, _joined(F.collect_list(F.struct("seq", F.col("_said").alias("said")))).alias("remarks"))
    return out.where(F.length("remarks") > LEAST_REMARKS).withColumn("day", incident_day(F.col("date_raw")))


def compact_incidents(lines: DataFrame, piece: int = PIECE) -> DataFrame:
    """Incident records below a one-line header (volume of 1991 to 1994); a line in capitals ends remarks."""
    rows = lines.withColumn("s", F.trim("line"))
    s = F.col("s")
    capitals = (s == F.upper(s)) & s.rlike(r"\p{L}")
    rows = _with_remarks(rows, s.rlike(COMPACT), s.rlike(PAGE_NUMBER) | capitals, r"(?i)^remarks:", F.lit(False), piece)
    head = F.max(F.when(F.col("_kind") == "head", s)).alias("h")
    out = rows.groupBy("document_id", "page", "record").agg(head, _joined(F.collect_list(F.struct("seq", F.col("_said").alias("said")))).alias("remarks"))
    cols = [F.trim(F.regexp_extract("h", COMPACT, g)).alias(n) for g, n in ((2, "date_raw"), (1, "area"), (3, "type"), (4, "accident_type"))]
    return out.where(F.length("remarks") > LEAST_REMARKS).select("document_id", "page", "record", *cols, "remarks").withColumn("day", short_day(F.col("date_raw")))


def scanned_incidents(pages: DataFrame) -> DataFrame:
    """Incident records of read scans (volume of 1956 to 1990) from pages (document_id, page, text): a record begins at an area's name with a date and holds all up to the next, since columns run into each other."""
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    pieces = F.slice(F.split(F.regexp_replace(body, SCANNED, "\u0001$0"), "\u0001"), 2, 1 << 30)
    rows = pages.select("document_id", "page", F.posexplode(F.transform(pieces, lambda p: F.trim(p))).alias("i", "remarks"))
    lease = _some(F.regexp_extract("remarks", r"\bOCS(?:-G)?[ -]?(\d{3,5}[A-Z]?)\b", 1))
    out = rows.select(
        "document_id", "page", (F.col("i") + 1).alias("record"), F.regexp_extract("remarks", SCANNED, 1).alias("area"), F.regexp_extract("remarks", SCANNED, 2).alias("date_raw"),
        F.regexp_extract("remarks", r"\bBlock\s+(\d{1,4})\b", 1).alias("block"), F.coalesce(F.concat(F.lit("OCS "), lease), F.lit("")).alias("lease"), "remarks",
    )
    return out.withColumn("day", F.try_to_date(F.regexp_replace("date_raw", r"^(\d{2})-(\d{2})-(\d{2})$", "19$3-$1-$2")))


def incident_day(text: Column) -> Column:
    """``5-JAN-97`` and its like; years of two digits lie between 1951 and 2050."""
    form = r"^(\d{1,2})[-/]([A-Za-z]{3})[-/](\d{2,4})"
    year = F.regexp_extract(text, form, 3).try_cast("int")
    year = F.when(year < 100, year + F.when(year > 50, 1900).otherwise(2000)).otherwise(year)
    return F.try_to_date(F.concat_ws("-", F.lpad(F.regexp_extract(text, form, 1), 2, "0"), F.initcap(F.regexp_extract(text, form, 2)), F.lpad(year.cast("string"), 4, "0")), "dd-MMM-yyyy")


def short_day(text: Column) -> Column:
    """``93-04-21``: a year of two digits, between 1951 and 2050, then month and day."""
    year = F.regexp_extract(text, r"^(\d{2})-", 1).try_cast("int")
    year = year + F.when(year > 50, 1900).otherwise(2000)
    return F.try_to_date(F.concat(year.cast("string"), F.substring(text, 3, 6)))
