"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunks, contamination, jaccard, language, licenses, merkle, quality, ranked, suffixes, tokens, trie, urls
from .common import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(chunks.dedup(table(spark, sf_dir, "documents")))


def op2_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    tokens.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return tokens.read(spark, path)


def op3_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules)


def op4_qgram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("text")


def op6_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def removed(rows: DataFrame) -> DataFrame:
    """The digest columns of a removal: what stays, and how much went."""
    gone = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return rows.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()))
    rows = docs.withColumn("held_out", language.held_out())
    return language.predict(rows, model, keep=["held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered())


def op12_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), with_ids=False)


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "postings")
    ranked.build(table(spark, sf_dir, "documents"), path)
    return ranked.search(spark, path, table(spark, sf_dir, "benchmark"))


OPERATORS = (op1_gear_chunks, op2_bit_planes, op3_range_join, op4_qgram_lemma, op5_line_frequency, op6_bayes_jaccard, op7_licenses, op8_prefix_bpe, op9_suffix_array, op10_language, op11_merkle, op12_trie_bpe, op13_ranked)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}
ORACLE: dict[str, str] = {"op3_range_join": urls.SQL, "op5_line_frequency": quality.SQL, "op11_merkle": merkle.SQL, "op13_ranked": ranked.SQL}
