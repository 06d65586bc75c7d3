"""Helpers shared by the text operators: Arrow buffers as numpy arrays, hashing, work folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a task expands into 64-bit arrays at a time; bounds a worker's memory.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    A session of one machine that has none (as in tests) gets a folder in its warehouse; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor repeats nothing before it."""
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table that ``cut`` wrote and that nothing will read again."""
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: A key of fewer rows is never dealt over several tasks.
LEAST_HOT = 1000


def hot_keys(counts: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys whose number of rows ``n`` exceeds an even task's share, and in how many parts they are dealt; None if there is none.

    Fewer keys than there are tasks can hold more than a task's share, so these rows may go through the driver and be broadcast."""
    spark = counts.sparkSession
    share = max(LEAST_HOT, (counts.agg(F.sum("n")).first()[0] or 0) // int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = counts.where(F.col("n") > share).select(*keys, F.ceil(F.col("n") / share).cast("int").alias("_parts"))
    rows = hot.collect()
    return spark.createDataFrame(rows, hot.schema) if rows else None


def meet(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` on ``keys``; the rows of a hot key are dealt by a hash of the columns ``by``, and its rows of ``one`` go to every part.

    An aggregate joined on its own key is not shuffled again, so Spark cannot split such a key by itself."""
    if hot is None:
        return many.join(one, keys, how)
    hot = F.broadcast(hot)
    many = many.join(hot, keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    one = one.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return many.join(one, [*keys, "_part"], how).drop("_part")


def in_blocks(df: DataFrame, size: Column, limit: int, key: str) -> list[DataFrame]:
    """``df`` in blocks whose sizes come to ``limit`` and one key's rows at most, by ranges of the integer ``key``; rows of one key stay together.

    Several blocks are written first, so that each is read without what came before it."""
    total = df.agg(F.sum(size)).first()[0] or 0
    if total <= limit:
        return [df] if total else []
    parts = -(-total // limit)
    ranged = df.withColumn("_size", size.cast("long")).repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id())
    before = Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_first()).rangeBetween(Window.unboundedPreceding, -1)
    rows = cut(df.sparkSession, cut(df.sparkSession, ranged, "ranged").withColumn("_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).cast("long")).withColumn("_block", F.expr(f"_block div {limit}")), "sized")
    blocks = sorted(rows.select("_part", "_block").distinct().collect())
    return [rows.where((F.col("_part") == p) & (F.col("_block") == b)).drop("_part", "_block", "_size") for p, b in blocks]


def texts(df: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """Two columns, ``doc_id`` and ``text`` (null: empty), and the named others, whatever else the table holds."""
    return df.select(*others, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def in_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of ``column`` (one row at least) and at most ``rows`` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(max(int(np.searchsorted(ends, before + limit, side="right")), at + 1), at + rows)
            yield batch.slice(at, to - at)
            at = to


def as_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings in one array, and where each begins (one more offset than strings). Nulls are empty."""
    if strings.null_count:
        strings = pc.fill_null(strings, b"" if pa.types.is_binary(strings.type) or pa.types.is_large_binary(strings.type) else "")
    wide = np.int64 if pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type) else np.int32
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, wide)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) | np.uint64(1)


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words (runs of bytes that are ``inside`` one; default: over 32) of concatenated texts: start, end, and a 64-bit hash of each. No word spans two texts."""
    n = len(raw)
    solid = np.zeros(n + 1, bool)
    solid[:n] = raw > 32 if inside is None else inside
    before = np.zeros(n + 1, bool)
    before[1:] = solid[:n]
    before[offsets] = False
    start = np.flatnonzero(solid & ~before)
    if not len(start):
        return start, start, np.zeros(0, np.uint64)
    after = np.zeros(n + 1, bool)
    after[:n] = solid[1:]
    after[offsets[1:] - 1] = False  # an offset of 0 marks the spare last place, which is not solid
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, span_hash(raw, start, end)


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span: over its bytes in order, eight bytes to a word."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    loose = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))
    length = end - start
    h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    todo = np.arange(len(start))
    at, left = start.copy(), length.copy()
    while len(todo):
        word = loose[at]
        short = np.minimum(left, 8).astype(np.uint64)
        word &= np.where(short >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (short * np.uint64(8))) - np.uint64(1))
        h[todo] = mix(h[todo] ^ word) + np.uint64(0x632BE59BD9B4E019)
        keep = left > 8
        todo, at, left = todo[keep], at[keep] + 8, left[keep] - 8
    return mix(h)


def text_digest(text: Column) -> Column:
    """A 128-bit digest of a text (null: empty), which with the id tells rows apart."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def row_tag(doc_id: Column, text: Column) -> Column:
    """What tells rows with one id apart: whether the id is null (a byte), and the text's digest."""
    return F.concat(F.when(doc_id.isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01"))), text_digest(text))


def hash_pair(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the same columns: a 128-bit key."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from rows that arrive sorted by them; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for s, e in zip([0, *new.tolist()], [*new.tolist(), b.num_rows], strict=True):
            key = tuple(int(c[s]) for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)
