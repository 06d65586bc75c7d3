"""Readers of landed files and writers of results, and the registry of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def source(name: str):
    """Registers a reader of (spark, path)."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = f
        return f

    return add


def load_all(spark: SparkSession, paths: dict[str, str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The tables of all named sources, and the errors of those that failed; one failure stops no other."""
    tables, errors = {}, {}
    for name, path in paths.items():
        try:
            tables[name] = REGISTRY[name](spark, path)
        except Exception as e:  # noqa: BLE001  a source's fault is reported, not raised
            errors[name] = f"{type(e).__name__}: {e}"
    return tables, errors


@source("csv")
def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with a header, quotes and line breaks within them."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', encoding="UTF-8")


@source("csv_semicolon")
def csv_semicolon(spark: SparkSession, path: str) -> DataFrame:
    """Semicolons, Latin-1, decimal commas left to functions.text.number."""
    return spark.read.csv(path, header=True, sep=";", encoding="ISO-8859-1", inferSchema=False, quote='"')


def positional(spark: SparkSession, path: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a file without a header that have the right number of columns, and the rejected lines."""
    rows = spark.read.text(path).withColumn("parts", F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names) + 1))))
    right = F.size(F.split("value", ',(?=(?:[^"]*"[^"]*")*[^"]*$)')) == len(names)
    return rows.where(right).select(*[F.trim(f"parts.c{i}").alias(n) for i, n in enumerate(names)]), rows.where(~right).select("value")


@source("sensor_csv")
def sensor_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, nullValue="-999.25", inferSchema=True)


def last_of_minute(rows: DataFrame, key: str, t: str) -> DataFrame:
    """The last row of each minute."""
    minute = F.date_trunc("minute", t)
    return rows.groupBy(key, minute.alias("_m")).agg(F.max_by(F.struct("*"), t).alias("r")).select("r.*")


def every_nth(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_i") % n == 1 if n > 1 else F.lit(True)).drop("_i")


@source("feature_json")
def feature_json(spark: SparkSession, path: str) -> DataFrame:
    """A feature collection (ArcGIS attributes or GeoJSON properties) as properties, lon and lat."""
    schema = "features array<struct<attributes:map<string,string>,properties:map<string,string>,geometry:struct<x:double,y:double,coordinates:array<double>>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    lon, lat = F.coalesce("f.geometry.x", F.get("f.geometry.coordinates", F.lit(0))), F.coalesce("f.geometry.y", F.get("f.geometry.coordinates", F.lit(1)))
    return f.select(F.coalesce("f.properties", "f.attributes").alias("properties"), lon.alias("lon"), lat.alias("lat"))


@source("report_jsonl")
def report_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A report a line: its header's well and date, and its lines with their places."""
    r = spark.read.schema("input string").json(path)
    well = F.regexp_extract("input", r"(?im)^\s*(?:well(?:bore)?|report for)\s*:\s*(.+?)\s*$", 1)
    day = F.try_to_date(F.regexp_extract("input", r"(\d{4}-\d{2}-\d{2})", 1))
    return r.select(F.nullif(well, F.lit("")).alias("well"), day.alias("day"), F.posexplode(F.split("input", "\n")).alias("seq", "line")).where("trim(line) <> ''")


def stations(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Survey stations (well_id and md, inc, azi, tvd, ns, ew as numbers) from rows of texts; ``wanted`` says which column holds what.

    Thousands commas go; a row without all six numbers is no station; of stations of one well at one depth the one with the
    least numbers stays."""
    names = ["md", "inc", "azi", "tvd", "ns", "ew"]
    out = rows.select("well_id", *[F.replace(F.trim(wanted[n]), F.lit(","), F.lit("")).try_cast("double").alias(n) for n in names]).dropna(subset=names)
    return out.groupBy("well_id", "md").agg(F.min(F.struct(*names[1:])).alias("s")).select("well_id", "md", "s.*")


def survey_csv(spark: SparkSession, path: str, well_id: int, first: int = 1) -> DataFrame:
    """A comma-separated survey; the six numbers begin at column ``first``."""
    rows = spark.read.text(path).select(F.lit(well_id).cast("long").alias("well_id"), F.from_csv("value", ", ".join(f"c{i} string" for i in range(first + 6))).alias("c"))
    return stations(rows.select("well_id", "c.*"), {n: f"c{first + i}" for i, n in enumerate(("md", "inc", "azi", "tvd", "ns", "ew"))})


def survey_text(spark: SparkSession, path: str, well_id: int, places: tuple[int, ...] = (0, 1, 2, 3, 5, 7), least: int = 11) -> DataFrame:
    """A survey report as text: lines that begin with ``least`` numbers, of which ``places`` are wanted."""
    line = rf"^\s*(?:-?\d[\d,]*(?:\.\d+)?(?:\s+|$)){{{least}}}"
    rows = spark.read.text(path).where(F.col("value").rlike(line)).select(F.lit(well_id).cast("long").alias("well_id"), F.split(F.trim("value"), r"\s+").alias("p"))
    return stations(rows.select("well_id", *[F.get("p", F.lit(k)).alias(f"c{i}") for i, k in enumerate(places)]), {n: f"c{i}" for i, n in enumerate(("md", "inc", "azi", "tvd", "ns", "ew"))})


def latest_round(spark: SparkSession, pattern: str) -> DataFrame:
    """The label file of the last round: the longest name, then the last."""
    rows = csv_text(spark, pattern).withColumn("_file", F.input_file_name())
    last = rows.agg(F.max(F.struct(F.length("_file"), "_file"))["_file"].alias("_last"))
    return rows.join(F.broadcast(last), F.col("_file") == F.col("_last"), "left_semi").drop("_file")  # one row


def well_key(name: Column) -> Column:
    from borelog.functions.text import canonical_well

    return canonical_well(name)


def link_wells(rows: DataFrame, wells: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Child rows with their well_id by canonical name, and the rows without a well."""
    keyed = rows.withColumn("_key", well_key(F.col(name)))
    known = wells.select(well_key(F.col("name")).alias("_key"), "well_id").groupBy("_key").agg(F.min("well_id").alias("well_id"))
    return keyed.join(known, "_key").drop("_key"), keyed.join(known, "_key", "left_anti").drop("_key")


def refresh(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A derived table anew; with ``by`` only the partitions that the rows belong to."""
    w = df.write.mode("overwrite")
    (w.option("partitionOverwriteMode", "dynamic").partitionBy(*by) if by else w).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def compact_payload(df: DataFrame, text_cols: list[str]) -> DataFrame:
    """Each text column with its place in the sorted list of its distinct values (``<name>_i``), for columns of few values."""
    out = df
    for c in text_cols:
        values = df.select(F.col(c).alias("_v")).where("_v is not null").distinct()
        values = values.withColumn(f"{c}_i", F.row_number().over(Window.orderBy("_v")) - 1)
        out = out.join(values, out[c] == values["_v"], "left").drop("_v")
    return out
