"""National registers' raw rows as well headers, layers, casing, tests and mud checks.

Each register is a ``Register``: which raw field fills which column, in which unit. Raw rows are a map of text (``p``) with ``lon`` and ``lat``,
as ``files.feature_json`` gives them or ``as_map`` makes them from a table. Nothing is guessed: a value that cannot be read is null, a row that
cannot be used is kept with the reason in ``rejected``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borelog.functions import text, units
from borelog.operators import joins, sequences

from . import reports

HEADER = {"field": "string", "kb_m": "double", "water_m": "double", "spud": "date", "td_m": "double", "tvd_m": "double", "status": "string", "purpose": "string", "well_type": "string", "operator": "string", "parent": "string"}
#: What stands for nothing in a register's text fields.
NOTHING = ["", "No Data Available"]
#: Codes of the lithology labels.
LITHOLOGY = {
    30000: "Sandstone", 65030: "Sandstone/Shale", 65000: "Shale", 80000: "Marl", 74000: "Dolomite", 70000: "Limestone", 70032: "Chalk",
    88000: "Halite", 86000: "Anhydrite", 99000: "Tuff", 90000: "Coal", 93000: "Basement",
}


def as_map(df: DataFrame) -> DataFrame:
    """A table's rows as maps of text, without coordinates."""
    p = F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns]))
    return df.select(p.alias("p"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"))


def said(*keys: str) -> Column:
    """The first of the fields that says something."""
    return F.coalesce(*[F.when(~F.trim(F.col("p")[k]).isin(NOTHING), F.trim(F.col("p")[k])) for k in keys])


def number(*keys: str) -> Column:
    return F.coalesce(*[text.number(F.col("p")[k]) for k in keys])


def feet(key: str) -> Column:
    return number(key) * units.FT_M


def leading(key: str) -> Column:
    """The number at the start of ``3657.6m``."""
    return text.number(F.regexp_extract(F.col("p")[key], r"-?\d+(?:[.,]\d+)?", 0))


def in_unit(key: str, unit: str) -> Column:
    """A length whose unit another field names; metres unless it says feet."""
    return F.when(F.lower(F.trim(F.col("p")[unit])).isin("ft", "feet", "'"), feet(key)).otherwise(number(key))


def millis(*keys: str) -> Column:
    return F.coalesce(*[text.day_of_millis(F.col("p")[k].try_cast("double")) for k in keys])


def day(key: str, form: str | None = None) -> Column:
    value = F.trim(F.col("p")[key])
    return F.try_to_date(value, form) if form else text.day_of(value)


@dataclass(frozen=True)
class Register:
    """``spare`` ids tell rows of one name apart: they get it in brackets (``apart``), or only the least one stays."""

    source: str
    country: str
    prefix: str
    name: Callable[[], Column]
    spare: Callable[[], Column]
    columns: Callable[[], dict[str, Column]]
    place: Callable[[], tuple[Column, Column]] = field(default=lambda: (F.col("lon"), F.col("lat")))
    box: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)
    must_have_place: bool = False
    apart: bool = False


def headers(raw: DataFrame, r: Register) -> DataFrame:
    """Well headers of a register, a row for each raw row; ``rejected`` says why a row is no well of its own (null: it is one).

    A place outside the register's box is null. Of rows with one name the least id (then the least place) is the well."""
    lon, lat = r.place()
    west, south, east, north = r.box
    inside = lon.between(west, east) & lat.between(south, north)
    given = r.columns()
    rows = raw.select(
        r.name().alias("_name"), r.spare().alias("external_id"), F.when(inside, lon).alias("lon"), F.when(inside, lat).alias("lat"),
        *[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in HEADER.items()],
    )
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_name").orderBy("external_id", "lon", "lat")))
    twin = F.row_number().over(Window.partitionBy("_name", "external_id").orderBy("_nth"))
    rows = rows.withColumn("_twin", twin)
    again = ((F.col("_twin") > 1) | F.col("external_id").isNull()) if r.apart else F.lit(True)
    reason = F.when(F.col("_name").isNull(), "no name").when(F.lit(r.must_have_place) & F.col("lon").isNull(), "no place").when((F.col("_nth") > 1) & again, "same name")
    shown = F.when((F.col("_nth") > 1) & F.lit(r.apart), F.concat("_name", F.lit(" ("), "external_id", F.lit(")"))).otherwise(F.col("_name"))
    return rows.select(F.concat(F.lit(r.prefix), shown).alias("name"), F.col("_name").alias("alias"), "external_id", F.lit(r.source).alias("source"), F.lit(r.country).alias("country"), "lon", "lat", *HEADER, reason.alias("rejected"))


SODIR = Register(
    "sodir", "Norway", "", lambda: text.canonical_well(said("wlbWellboreName")), lambda: said("wlbNpdidWellbore"),
    lambda: {
        "field": said("wlbField"), "kb_m": number("wlbKellyBushElevation"), "water_m": number("wlbWaterDepth"), "spud": day("wlbEntryDate"), "td_m": number("wlbTotalDepth"), "tvd_m": number("wlbFinalVerticalDepth"),
        "status": said("wlbStatus"), "purpose": said("wlbPurpose"), "well_type": said("wlbWellType"), "operator": said("wlbDrillingOperator"), "parent": text.canonical_well(said("wlbWell")),
    }, place=lambda: (number("wlbEwDecDeg"), number("wlbNsDecDeg")),
)
NSTA = Register(
    "nsta", "United Kingdom", "GB: ", lambda: F.regexp_replace(text.squeeze(said("WELLREGNO")), r"\s*-\s*", "-"), lambda: said("WELLORIGIN"),
    lambda: {
        "field": said("TARGETFLD"), "kb_m": F.coalesce(number("DATELEV_M"), feet("DATELEV_F")), "water_m": F.coalesce(number("WATDEP_M"), feet("WATDEP_F")), "spud": millis("SPUDDATE"),
        "td_m": F.coalesce(number("TDMDDEPM"), feet("TDMDDEPF")), "tvd_m": F.coalesce(number("TDTVDSSM"), feet("TDTVDSSF")), "status": said("WELLBRSTAT", "WELLOPSTAT", "COMPLESTAT"),
        "purpose": said("ORIGINTENT"), "well_type": said("DEVTYPE"), "operator": said("RESWOP", "SUBAREAOP"),
    }, place=lambda: tuple(F.when(F.upper(said("TOPHOLEDTM")).isin("WGS84", "ETRS89"), number(k)) for k in ("TOPHOLEXDD", "TOPHOLEYDD")), box=(-10.0, 48.0, 4.0, 63.0),
)
NLOG = Register(
    "nlog", "Netherlands", "NL: ", lambda: said("boreholeName"), lambda: said("nitgNr", "uwi", "boreholeDbk"),
    lambda: {
        "field": F.coalesce(said("fieldName"), F.concat(F.lit("Block "), said("blockCd"))), "kb_m": number("drpHeightInMeters"), "spud": millis("startDate"), "td_m": number("endAhDepthInMeters"), "tvd_m": number("tvdInMeters"),
        "status": said("statusDescription"), "purpose": said("purposeDescription", "purposeCd"), "well_type": F.when(said("onOffshore") == "OFF", "offshore").otherwise("onshore"), "operator": said("clientOrgName"),
        "parent": F.concat(F.lit("NL: "), text.parent_name(said("boreholeName"))),
    }, place=lambda: (number("longitudeWgs84"), number("latitudeWgs84")),
)
SARIG = Register(
    "sarig", "Australia", "AU: ", lambda: said("WELL_NAME"), lambda: said("DRILLHOLE_NO"),
    lambda: {"field": F.coalesce(said("BASIN"), F.lit("South Australia")), "kb_m": F.nullif(number("KB__M"), F.lit(0.0)), "spud": F.try_to_date(F.substring(said("SPUDDED"), 1, 10), "yyyy-MM-dd"), "td_m": F.nullif(number("TD__M"), F.lit(0.0)), "status": said("STATUS_RIG_RELEASE", "WELL_TYPE"), "well_type": said("CLASS"), "operator": said("OPERATOR")},
)
NZPAM = Register(
    "nzpam", "New Zealand", "NZ: ", lambda: said("FullName", "PBWellID"), lambda: said("PBWellID"),
    lambda: {"kb_m": in_unit("Elevation", "ElevUnit"), "water_m": in_unit("WaterDepth", "DepthUnit"), "spud": millis("SpudDate"), "td_m": in_unit("TotalMD", "TotMDunit"), "tvd_m": in_unit("TVD", "TVDUnit"), "status": said("Status"), "well_type": said("WellType"), "operator": said("Operator")},
    place=lambda: (number("LongtudeDD"), number("LatitudeDD")), apart=True,
)
CNSOPB = Register(
    "cnsopb", "Canada", "CA: ", lambda: F.nullif(F.concat_ws(" ", said("Well_Name"), said("Well_Nam_1")), F.lit("")), lambda: F.lit(None).cast("string"),
    lambda: {"field": F.lit("Scotian Basin (offshore Nova Scotia)"), "kb_m": number("RT_Elevati"), "water_m": number("Water_Dept"), "spud": day("Spud_Date"), "td_m": number("Total_Dept"), "status": said("Well_1"), "purpose": said("Well"), "well_type": said("Well_Type"), "operator": said("Company")},
    place=lambda: (F.coalesce(number("longitud_1"), F.col("lon")), F.coalesce(number("latitude_d"), F.col("lat"))),
)
CNLOPB = Register(
    "cnlopb", "Canada", "CA: ", lambda: said("Wellname"), lambda: said("UWI", "WellNumber"),
    lambda: {"field": F.lit("Jeanne d'Arc / Flemish Pass (offshore Newfoundland & Labrador)"), "water_m": leading("WaterDepth"), "spud": day("SpudDate", "MMMM d, yyyy"), "td_m": leading("TotDpthMD"), "status": said("WellStatus"), "well_type": said("Classifi"), "operator": said("Operator")},
    place=lambda: (number("DecimalLon"), number("DecimalLat")), apart=True,
)
SASK = Register(
    "sask_energy", "Canada", "CA: ", lambda: said("LEGACYWELLNAME", "WELL_CWI", "WELLBORE_UWI"), lambda: said("WELL_CWI"),
    lambda: {
        "field": said("SURFACEGEOAREA"), "spud": millis("WELLDERIVEDSPUDDATE"), "td_m": leading("WELLBORE_BH_MEASUREDDEPTH"), "tvd_m": leading("WELLBORE_BH_TRUEVERTICALDEPTH"), "status": said("WELLSTATUS"), "well_type": said("WELLDRILLINGTRAJECTORY"),
        "operator": F.regexp_replace(said("WELLLICENCEBUSINESSASSOCIATE"), r"\s*\[\d+\]$", ""),
    }, place=lambda: (number("SURFACELONGITUDE"), number("SURFACELATITUDE")), apart=True,
)
#: The borehole file has no header: c0, c1, … are its columns (``files.positional``).
BSEE = Register(
    "bsee", "USA", "US: ", lambda: F.when(said("c0").rlike(r"^\d+$"), said("c0")), lambda: said("c0"),
    lambda: {
        "field": said("c11"), "water_m": F.round(feet("c19"), 1), "spud": day("c5", "yyyyMMdd"), "td_m": F.round(feet("c8"), 1), "tvd_m": F.round(feet("c9"), 1),
        "well_type": F.when(said("c28") == "STR", "straight").when(said("c28") == "DIR", "directional").when(said("c28") == "HOR", "horizontal"),
    }, place=lambda: (number("c20"), number("c21")), box=(-179.0, -89.0, 179.0, 89.0), must_have_place=True,
)
REGISTERS = {r.source: r for r in (SODIR, NSTA, NLOG, SARIG, NZPAM, CNSOPB, CNLOPB, SASK, BSEE)}


def linked(rows: DataFrame, wells: DataFrame, name: Column) -> DataFrame:
    """Rows with the well_id, td_m and kb_m of the well of that name; null where there is none."""
    known = wells.select(F.col("name").alias("_n"), "well_id", "td_m", "kb_m")
    return rows.withColumn("_w", name).join(known, F.col("_w") == F.col("_n"), "left").drop("_w", "_n")


def sodir_tops(raw: DataFrame, wells: DataFrame) -> DataFrame:
    """Layers of the two levels that are kept; ``grp`` is the group a formation belongs to."""
    level, name = said("lsuLevel"), said("lsuName")
    rows = linked(raw, wells, text.canonical_well(said("wlbName"))).where(level.isin("FORMATION", "GROUP"))
    reason = F.when(F.col("well_id").isNull(), "no well").when(name.isNull(), "no name")
    return rows.select("well_id", name.alias("formation"), level.alias("level"), F.when(level == "GROUP", name).otherwise(said("lsuNameParent")).alias("grp"), number("lsuTopDepth").alias("top"), number("lsuBottomDepth").alias("base"), reason.alias("rejected"))


def sodir_casing(raw: DataFrame, wells: DataFrame) -> DataFrame:
    """Casing strings; a shoe below the well's end is not believed, a depth of 0 is none."""
    shoe, hole = (F.nullif(number(k), F.lit(0.0)) for k in ("wlbCasingDepth", "wlbHoleDepth"))
    rows = linked(raw, wells, text.canonical_well(said("wlbName")))
    kept = F.when(F.coalesce(shoe > F.col("td_m") + 1, F.lit(False)), F.lit(None)).otherwise(shoe)
    return rows.select("well_id", said("wlbCasingType").alias("casing_type"), text.inches(said("wlbCasingDiameter")).alias("od_in"), text.inches(said("wlbHoleDiameter")).alias("hole_in"), kept.alias("shoe"), hole.alias("hole"), F.when(F.col("well_id").isNull(), "no well").alias("rejected"))


def sodir_tests(raw: DataFrame, wells: DataFrame) -> DataFrame:
    """Leak-off and integrity tests of the casing rows; a density of 0 means that none was made. They may lie up to 4 ppg above drilling mud."""
    kind, sg = F.upper(said("wlbFormationTestType")), number("wlbLotMudDencity")
    rows = linked(raw, wells, text.canonical_well(said("wlbName"))).where((sg > 0) & kind.isin("LOT", "FIT", "XLOT", "XLO"))
    ppg = sg * units.SG_PPG
    reason = F.when(F.col("well_id").isNull(), "no well").when(~ppg.between(7, 24), "out of range")
    return rows.select("well_id", F.when(kind == "FIT", "FIT").otherwise("LOT").alias("kind"), number("wlbCasingDepth").alias("md"), F.round(ppg, 2).alias("emw_ppg"), sg.alias("raw_value"), reason.alias("rejected"))


def sodir_mud(raw: DataFrame, wells: DataFrame) -> DataFrame:
    md, sg = number("wlbMD"), number("wlbMudWeightAtMD")
    rows = linked(raw, wells, text.canonical_well(said("wlbName"))).where(md.isNotNull() & sg.isNotNull())
    ppg = sg * units.SG_PPG
    reason = F.when(F.col("well_id").isNull(), "no well").when(~ppg.between(7, 20), "mud weight").when(md > F.col("td_m") + 1, "depth")
    return rows.select("well_id", md.alias("md"), F.round(ppg, 2).alias("mw_ppg"), sg.alias("raw_value"), said("wlbMudType").alias("mud_type"), day("wlbMudDateMeasured").alias("measured"), reason.alias("rejected"))


def nsta_tops(raw: DataFrame, wells: DataFrame) -> DataFrame:
    """Up to four reservoirs stand in one row; each becomes a layer without depth, its age in brackets."""
    rows = linked(raw, wells, F.concat(F.lit(NSTA.prefix), NSTA.name()))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), said(f"R{n}_NAME").alias("name"), said(f"R{n}_AGE").alias("age"), said(f"R{n}_ROCK").alias("rock")) for n in (1, 2, 3, 4)]))
    rows = rows.select("well_id", each.alias("r")).where("r.name is not null")
    named = F.when(F.col("r.age").isNotNull(), F.concat("r.name", F.lit(" ("), "r.age", F.lit(")"))).otherwise(F.col("r.name"))
    return rows.select("well_id", named.alias("formation"), F.col("r.rock").alias("rock"), F.col("r.n").alias("reservoir"), F.when(F.col("well_id").isNull(), "no well").alias("rejected"))


def nlog_tops(raw: DataFrame, wells: DataFrame) -> DataFrame:
    """Layers joined by the stable id, or else by name; depths below sea level become depths below the derrick floor."""
    low, unit = F.lower(said("STRAT_UNIT_NM")), said("STRAT_UNIT_NM")
    level = F.when(low.contains("group") | low.contains("groep"), "GROUP").when(low.contains("member"), "MEMBER").otherwise("FORMATION")
    rows = raw.select(said("NITG_NR").alias("nitg"), F.concat(F.lit("NL: "), said("WELLBORE")).alias("well"), unit.alias("formation"), level.alias("level"), number("TOP_AH").alias("top"), number("BOTTOM_AH").alias("base"), number("TV_TOP_NAP").alias("nap"))
    rows = rows.where(F.upper("formation") != "NOT INTERPRETED")
    known = wells.select(F.col("external_id").alias("nitg_w"), F.col("name").alias("name_w"), "well_id")
    rows = joins.two_keys(rows.withColumnsRenamed({"nitg": "k1", "well": "k2"}), known.withColumnsRenamed({"nitg_w": "k1", "name_w": "k2"}), "k1", "k2", "well_id")
    rows = rows.join(wells.select("well_id", "kb_m"), "well_id", "left")
    return rows.select("well_id", "formation", "level", "top", "base", (F.col("nap") + F.col("kb_m")).alias("top_tvd"), F.when(F.col("well_id").isNull(), "no well").alias("rejected"))


def labelled_logs(samples: DataFrame, least: float = 5.0) -> DataFrame:
    """Lithology intervals (well, run, top, base, rock) of log samples (WELL, DEPTH_MD, FORCE_2020_LITHOFACIES_LITHOLOGY), thin ones merged."""
    code = F.col("FORCE_2020_LITHOFACIES_LITHOLOGY").try_cast("double").cast("int")
    names = F.create_map(*[F.lit(x) for pair in LITHOLOGY.items() for x in pair])
    rows = samples.select(text.canonical_well(F.col("WELL")).alias("well"), F.col("DEPTH_MD").try_cast("double").alias("md"), code.alias("code")).where("code is not null and md is not null")
    w = Window.partitionBy("well").orderBy("md")
    rows = rows.withColumn("new", F.when(F.col("code").eqNullSafe(F.lag("code").over(w)), 0).otherwise(1)).withColumn("next", F.lead("md").over(w))
    rows = rows.withColumn("grp", F.sum("new").over(w))
    runs = rows.groupBy("well", "grp").agg(F.min("md").alias("top"), F.max(F.coalesce("next", "md")).alias("base"), F.first("code").alias("code"))
    rock = F.coalesce(names[F.col("code")], F.concat(F.lit("unknown-code-"), F.col("code").cast("string")))
    return sequences.merge_short_runs(runs.select("well", "top", "base", rock.alias("rock")), "well", "top", "base", "rock", least)


def washouts(samples: DataFrame, inches: float = 2.0, least: float = 5.0) -> DataFrame:
    """Spans of ``least`` metres or more where the caliper reads more than ``inches`` over the bit, with a sentence that says so."""
    rows = samples.select(text.canonical_well(F.col("WELL")).alias("well"), *[F.col(c).try_cast("double").alias(c) for c in ("DEPTH_MD", "CALI", "BS")]).dropna()
    over, w = F.col("CALI") - F.col("BS"), Window.partitionBy("well").orderBy("DEPTH_MD")
    rows = rows.withColumn("over", over).withColumn("high", (over > inches).cast("int")).withColumn("grp", F.sum(1 - F.col("high")).over(w)).where("high = 1")
    spans = rows.groupBy("well", "grp").agg(F.min("DEPTH_MD").alias("top"), F.max("DEPTH_MD").alias("base"), F.min("over").alias("lo"), F.max("over").alias("hi")).where(F.col("base") - F.col("top") >= least)
    said = F.format_string("Caliper exceeds bit size by %.1f–%.1f in from %.1f to %.1f m MD (log-derived washout indicator).", "lo", "hi", "top", "base")
    return spans.select("well", "top", "base", "lo", "hi", F.round((F.col("top") + F.col("base")) / 2, 2).alias("md"), said.alias("text"))


def daily_reports(raw: DataFrame) -> DataFrame:
    """Activities (well, day, activity, t_start, t_end, text, document_id) of reports (instruction, input): the head names well and day, each line its times. A report that stands twice counts once; one without a head goes."""
    head = r"for well (.+?) on (\d{4}-\d{2}-\d{2})"
    rows = raw.select(text.canonical_well(F.regexp_extract("instruction", head, 1)).alias("well"), F.try_to_date(F.regexp_extract("instruction", head, 2)).alias("day"), "input").where("well <> '' and day is not null")
    rows = rows.withColumn("document_id", F.sha2(F.concat("well", F.col("day").cast("string"), "input"), 256)).dropDuplicates(["document_id"])
    lines = rows.select("document_id", "day", F.posexplode(F.split("input", r"\r?\n")).alias("seq", "line"))
    return reports.timed_lines(lines).join(rows.select("document_id", "well", "day"), "document_id").select("well", "day", "activity", "t_start", "t_end", "text", "document_id")
