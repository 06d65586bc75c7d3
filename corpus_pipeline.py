"""The corpus pipeline: documents to token digests in five stages. Counts as part of borelog.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borelog.llm import bpe, contamination, jaccard, language, suffixes
from borelog.llm.common import cut, row_tag, text_digest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No single SQL statement expresses byte-pair encoding or the language model; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, fitted on the labelled rows outside the held-out fold; documents without a language go."""
    model = language.fit(docs.where(~language.held_out()))
    return language.predict(docs, model, keep=COLUMNS[1:]).where(F.col("lang_pred") != language.UNKNOWN).select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one row of each group of near duplicates stays, that with the least doc_id.

    Null ids come last; among rows with one id the least digest of the text decides, and of rows equal in both one stays.
    Texts without a word are no duplicates and all stay."""
    key = ["doc", "tag"]
    rows = jaccard.near_duplicates(docs, with_row=True).where("label is not null")
    each = cut(spark, rows.groupBy("label", *key).agg(F.count("*").alias("n")), "classes")
    first = each.groupBy("label").agg(F.min(F.struct(*key)).alias("one")).select("one.*")
    keyed = docs.withColumns({"doc": F.coalesce("doc_id", F.lit(jaccard.LAST)), "tag": row_tag(F.col("doc_id"), F.col("text"))})
    keyed = keyed.join(each.join(first, key, "left_anti").select(key), key, "left_anti")
    again = each.where("n > 1").join(first, key, "left_semi").select(key)
    return keyed.join(again, key, "left_anti").union(keyed.join(again, key, "left_semi").dropDuplicates(key)).select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: bytes in strings of 200 bytes that occur twice go; a character cut in two goes with them."""
    kept = suffixes.remove_repeats(docs, keep=["lang", "source"])
    whole = F.expr("coalesce(try_validate_utf8(cast(kept as string)), regexp_replace(make_valid_utf8(cast(kept as string)), '\\uFFFD', ''))")
    return kept.withColumn("text", whole).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold an item go. What a text holds is known by its digest, so ids do not matter."""
    found = contamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_tag=True).select("tag").distinct()
    return docs.withColumn("tag", text_digest(F.col("text"))).join(found, "tag", "left_anti").select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids and their decoded bytes, as digests."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


STAGES = [("language", identify), ("near duplicates", one_of_each), ("repeated strings", without_repeats), ("decontamination", decontaminated), ("encoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
