"""Incremental load: landed files go through a chain of tables, and only what they change is made anew.

A store holds one table for each step. A step makes its rows from those of the steps before it, in units: all rows of one
value of its key (a document, a well, a page). When units of an input change, the keys that their rows had before and have
now are the units to make anew; the same goes on to the next step, down to the pages that cite a document. Tables are cut
into buckets of their key, and only buckets with a changed unit are written.

Files are read by Structured Streaming, each batch once. The first table is written last: a batch that broke off is seen as
new when it is played again, and every write replaces whole units, so playing a batch twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from borelog.operators.tables import written

LANDED = "path string, landed timestamp, sha256 string, text string"


@dataclass(frozen=True)
class Step:
    """A table: its key, the tables that it is made of, and how. ``build`` gets the inputs' rows of the units to make, in the order of
    ``inputs``, and gives the units' rows. Every input has the key's columns; a row in which one of them is null belongs to no unit."""

    name: str
    key: tuple[str, ...]
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    schema: str


class Store:
    """The tables below ``path``, each in ``buckets`` parts."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def schema(self, schema: str) -> StructType:
        return self.spark.createDataFrame([], f"{schema}, _here boolean, _bucket int").schema

    def all(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema(schema)).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], self.schema(schema))

    def read(self, name: str, schema: str) -> DataFrame:
        return self.all(name, schema).where("_here").drop("_here", "_bucket")

    def bucket(self, df: DataFrame, key: tuple[str, ...]) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int"))

    def units(self, name: str, schema: str, key: tuple[str, ...], changed: DataFrame) -> DataFrame:
        """The rows of the changed units, read from their buckets alone."""
        rows = self.all(name, schema).where(F.col("_bucket").isin(self.touched(changed, key))).where("_here")
        return rows.join(changed.select(*key).distinct(), list(key), "left_semi").drop("_here", "_bucket")

    def touched(self, changed: DataFrame, key: tuple[str, ...]) -> list[int]:
        """Numbers of buckets: as many as there are buckets at most."""
        return [r[0] for r in self.bucket(changed.select(*key), key).select("_bucket").distinct().collect()]

    def replace(self, name: str, schema: str, key: tuple[str, ...], changed: DataFrame, rows: DataFrame) -> None:
        """The changed units' rows become ``rows``; buckets without a changed unit keep their files.

        A bucket is staged before it is overwritten, as its old rows are read from it. Each has a row that is not here, so that one without any other is overwritten too."""
        touched = self.touched(changed, key)
        if not touched:
            return
        names = [f.name for f in self.spark.createDataFrame([], schema).schema]
        stays = self.all(name, schema).where(F.col("_bucket").isin(touched)).where("_here").join(changed.select(*key).distinct(), list(key), "left_anti").select(*names, "_bucket")
        new = self.bucket(rows.select(*names), key)
        marks = self.spark.createDataFrame([(b,) for b in touched], "_bucket int").select(*[F.lit(None).alias(n) for n in names], F.lit(False).alias("_here"), "_bucket")
        out = stays.unionByName(new).withColumn("_here", F.lit(True)).unionByName(marks)
        staged = written(out, f"staged-{name}")
        staged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/{name}")


def landed(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of the files that are dropped below ``folder``: path, time of change, SHA-256 and text (line ends as one kind, no blanks at line ends).

    Each drop is a folder of its own, as a stream reads no file twice; the path of a file is that below its drop, so a later drop's file replaces an earlier one's of the same path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(folder)
    text = F.regexp_replace(F.expr("make_valid_utf8(cast(content as string))"), r"[ \t]*\r?\n", "\n")
    below = folder.split(":", 1)[-1].rstrip("/")
    path = F.regexp_replace("path", rf"^.*?\Q{below}\E/[^/]+/", "")
    return files.select(path.alias("path"), F.col("modificationTime").alias("landed"), F.sha2(text, 256).alias("sha256"), text.alias("text"))


def take(store: Store, first: str, batch: DataFrame, steps: list[Step]) -> dict[str, int]:
    """Loads a batch (see LANDED) into the table ``first`` (document_id, path, sha256, text, …) and everything made from it; returns the number of changed units of each table.

    A text that is loaded already is not loaded again, whatever its path; a path with another text replaces what it held; of
    several texts of one path the last landed counts, of several paths of one text the first in order."""
    spark = store.spark
    schema = "document_id string, path string, sha256 string, text string"
    last = batch.groupBy("path").agg(F.max_by(F.struct("sha256", "text"), F.struct("landed", "sha256")).alias("d")).select("path", "d.*")
    known = store.read(first, schema).select("document_id", "path", "sha256")
    moved = last.join(known.select("path", "sha256"), ["path", "sha256"], "left_anti")
    one = moved.groupBy("sha256").agg(F.min_by(F.struct("path", "text"), "path").alias("d")).select(F.sha2("d.path", 256).alias("document_id"), "d.path", "sha256", "d.text")
    elsewhere = known.join(moved.select("path"), "path", "left_anti").select("sha256")  # texts of paths that this batch does not replace
    fresh = written(one.join(elsewhere, "sha256", "left_anti").select("document_id", "path", "sha256", "text"), "fresh")
    gone = moved.join(fresh.select("path"), "path", "left_anti").join(known.select("path"), "path").select(F.sha2("path", 256).alias("document_id"))
    changed = written(fresh.select("document_id").union(gone), "changed")
    counts = {first: changed.count()}
    if not counts[first]:
        return counts
    schemas = {first: schema} | {s.name: s.schema for s in steps}
    keys = {first: ("document_id",)} | {s.name: s.key for s in steps}
    before, after = {first: written(store.units(first, schema, ("document_id",), changed), "old")}, {first: fresh}
    touched = {first: changed}
    for step in steps:
        key = list(step.key)
        hit = None
        for name in step.inputs:
            part = before[name].select(key).unionByName(after[name].select(key))
            hit = part if hit is None else hit.unionByName(part)
        units = written(hit.dropna().distinct(), "units")
        inputs = []
        for name in step.inputs:
            # The input as it is now: its unchanged units from the store, its changed ones as just made.
            stays = store.read(name, schemas[name]).join(touched[name], list(keys[name]), "left_anti")
            inputs.append(stays.unionByName(after[name].select(stays.columns)).join(units, key, "left_semi"))
        after[step.name] = written(step.build(*inputs), f"made-{step.name}")
        before[step.name], touched[step.name] = written(store.units(step.name, step.schema, step.key, units), f"old-{step.name}"), units
        counts[step.name] = units.count()
    for step in reversed(steps):
        store.replace(step.name, step.schema, step.key, touched[step.name], after[step.name])
    store.replace(first, schema, ("document_id",), changed, fresh)
    return counts


def run(spark: SparkSession, folder: str, store: Store, steps: list[Step], checkpoint: str, first: str = "documents", files_a_batch: int = 1000) -> StreamingQuery:
    """Loads all files that have landed below ``folder`` since the last run, and stops."""
    stream = landed(spark, folder, files_a_batch).writeStream.foreachBatch(lambda batch, _: take(store, first, batch, steps) and None)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def report_steps() -> list[Step]:
    """From report texts to pages: sentences, the problems they state, their episodes, what each page cites, and the pages of problems and wells.

    The well of a document is that which its first line names (``well: …``)."""
    from borelog.functions import text as fn
    from borelog.operators import extraction

    def passages(documents: DataFrame) -> DataFrame:
        well = F.nullif(F.regexp_extract("text", r"(?im)^\s*well\s*:\s*(.+?)\s*$", 1), F.lit(""))
        lines = documents.select("document_id", well.alias("well"), F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("paragraph", "body"))
        rows = lines.select("document_id", "well", "paragraph", F.posexplode(fn.sentences(F.col("body"))).alias("s", "text"))
        seq = (F.col("paragraph") * 10_000 + F.col("s")).cast("long")
        return rows.select("document_id", "well", F.concat_ws("#", "document_id", seq.cast("string")).alias("passage_id"), seq.alias("seq"), F.format_string("para %d.s%d", F.col("paragraph") + 1, F.col("s") + 1).alias("locator"), "text")

    def events(rows: DataFrame) -> DataFrame:
        return extraction.events(rows).select("document_id", "well", "passage_id", "hazard", "mention_end", "md", "confidence", "needs_review")

    def episodes(rows: DataFrame, found: DataFrame) -> DataFrame:
        out = extraction.episodes(rows, found)
        return out.select("document_id", "well", "passage_id", "hazard", "md", "action_types", "outcome")

    def citations(rows: DataFrame, found: DataFrame) -> DataFrame:
        said = found.join(rows.select("passage_id", "locator", "text"), "passage_id")
        pages = F.array(F.struct(F.lit("problem").alias("kind"), F.col("hazard").alias("name")), F.struct(F.lit("well").alias("kind"), F.col("well").alias("name")))
        each = said.select("document_id", "passage_id", "locator", "text", "hazard", "outcome", F.explode(pages).alias("p")).where("p.name is not null")
        return each.select("document_id", "p.kind", "p.name", "passage_id", "locator", "text", "hazard", "outcome")

    def pages(rows: DataFrame) -> DataFrame:
        return rows.groupBy("kind", "name").agg(F.count("*").alias("records"), F.countDistinct("document_id").alias("documents"), F.count_if(F.col("outcome") == "resolved").alias("resolved"))

    cites = "document_id string, kind string, name string, passage_id string, locator string, text string, hazard string, outcome string"
    return [
        Step("passages", ("document_id",), ("documents",), passages, "document_id string, well string, passage_id string, seq long, locator string, text string"),
        Step("events", ("document_id",), ("passages",), events, "document_id string, well string, passage_id string, hazard string, mention_end int, md double, confidence double, needs_review boolean"),
        Step("episodes", ("document_id",), ("passages", "events"), episodes, "document_id string, well string, passage_id string, hazard string, md double, action_types array<string>, outcome string"),
        Step("citations", ("document_id",), ("passages", "episodes"), citations, cites),
        Step("pages", ("kind", "name"), ("citations",), pages, "kind string, name string, records long, documents long, resolved long"),
    ]
