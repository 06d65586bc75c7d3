"""Token ids as a table of bit planes.

The file format is a Parquet data set of chunks. A chunk holds whole documents; its ids are cut into blocks of a fixed
size, each block is transposed into bit planes (or byte planes), each plane is compressed with zstandard. The chunk's row
is also its index entry: shard, chunk number, first id within the shard, ids, and the documents with their lengths.
Shards and chunks ascend with doc_id, so reading in (shard, chunk) order gives the ids in doc_id order. Going through
Spark's writer makes files appear only when their task has committed, and works on any file system.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Parts, encode_slice
from .common import in_slices, texts

BLOCK = 16_384
CHUNK_IDS = 131_072
#: Bytes of a worker's cache of parts.
CACHE_BYTES = 128 << 20
#: Parts in a call of the library, which holds more than a thousand bytes for each until it ends.
CALL_PARTS = 16_384
#: A part that stays the same between line ends: a blank at most before, no line end within, no white space at the end.
PLAIN = re.compile(r" ?\S(?:[^\n]*\S)?")
SCHEMA = "shard int, chunk int, first long, n_ids long, planes int, block int, kind string, doc_ids array<long>, lengths array<long>, data array<binary>"


@functools.cache
def tokenizer(path: str):
    """One for each Python worker: the tokenizer of a file of the tokenizers library, and a cache of encoded parts."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    special = [t.id_to_token(i) for i in t.get_added_tokens_decoder()]

    def each(parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(parts, add_special_tokens=False)]

    mark = t.encode("\n", add_special_tokens=False).ids

    def fresh(parts: list[str], simple: bool = False) -> list[bytes]:
        return list(itertools.chain.from_iterable(together(parts[at : at + CALL_PARTS], simple) for at in range(0, len(parts), CALL_PARTS)))

    def together(parts: list[str], simple: bool) -> list[bytes]:
        """One call for many parts: with line ends between them, which the pre-tokenizer always parts from what stands around.

        ``simple``: no part holds white space but a blank before or a line end alone, so a look at the last character is enough."""
        plain = [p for p in parts if p[-1] > " "] if simple else [p for p in parts if PLAIN.fullmatch(p)]
        if len(plain) < 2 or len(mark) != 1:
            return each(parts)
        ids = np.array(t.encode_batch_fast(["\n".join(plain)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(ids == mark[0])
        if len(at) != len(plain) - 1:
            return each(parts)
        raw = ids.tobytes()
        done = {p: raw[a:z] for p, a, z in zip(plain, [0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), len(raw)], strict=True)}
        rest = [p for p in parts if p not in done] if len(plain) < len(parts) else []
        done.update(zip(rest, each(rest), strict=True))
        return list(done.values()) if not rest and len(done) == len(parts) else [done[p] for p in parts]

    def whole(texts: pa.Array, ids: list[bytes]) -> list[bytes]:
        """The library's ids of those texts that hold an added token's string, which it sets apart before all else, encoded whole."""
        if special:
            hold = pc.fill_null(pc.match_substring_regex(texts, "|".join(re.escape(x) for x in special)), False)
            for i in np.flatnonzero(hold.to_numpy(zero_copy_only=False)).tolist():
                ids[i] = each([texts[i].as_py()])[0]
        return ids

    return fresh, Parts(CACHE_BYTES), whole


def to_planes(ids: np.ndarray, kind: str, block: int, compress) -> tuple[int, list[bytes]]:
    """The planes of each block in turn, lowest first, as many as the largest id needs."""
    need = max(1, int(ids.max(initial=0)).bit_length())
    n = need if kind == "bit" else (need + 7) // 8
    out = []
    for at in range(0, len(ids), block):
        part = ids[at : at + block].astype("<u4")
        if kind == "bit":
            out += [compress(np.packbits((part >> np.uint32(k) & np.uint32(1)).astype(np.uint8), bitorder="little").tobytes()) for k in range(n)]
        else:
            out += [compress(row.tobytes()) for row in np.ascontiguousarray(part.view(np.uint8).reshape(-1, 4).T[:n])]
    return n, out


def from_planes(data: list[bytes], planes: int, kind: str, block: int, n_ids: int, decompress) -> np.ndarray:
    ids = np.zeros(n_ids, "<u4")
    for i, plane in enumerate(data):
        at, k = i // planes * block, i % planes
        size = min(block, n_ids - at)
        row = np.frombuffer(decompress(plane), np.uint8)
        row = np.unpackbits(row, count=size, bitorder="little") if kind == "bit" else row
        ids[at : at + size] |= row.astype("<u4") << np.uint32(k if kind == "bit" else 8 * k)
    return ids


def write(df: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, kind: str = "byte", block: int = BLOCK, chunk_ids: int = CHUNK_IDS, level: int = 1, partitions: int | None = None) -> None:
    """Encodes every whole text and writes the chunks below ``path``, in ascending doc_id order.

    A null text has no ids but the end id; a null doc_id sorts first; rows that share a doc_id are all kept, next to each
    other, in the order of a hash of their texts; an empty table writes an empty data set. ``end_id`` (None: none) ends each
    document. One shuffle, of the texts, by ranges of doc_id and that hash; a task holds one chunk. A very long text is encoded
    whole and is a chunk of its own size."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        compress = zstandard.ZstdCompressor(level=level).compress
        fresh, known, whole = tokenizer(tokenizer_file)
        shard, chunk, first = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        docs: list = []
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

        def flush() -> pa.RecordBatch:
            nonlocal chunk, first
            ids = np.frombuffer(b"".join(held), "<u4")
            planes, data = to_planes(ids, kind, block, compress)
            row = {"shard": shard, "chunk": chunk, "first": first, "n_ids": len(ids), "planes": planes, "block": block, "kind": kind, "doc_ids": docs[:], "lengths": [len(x) // 4 for x in held], "data": data}
            chunk, first = chunk + 1, first + len(ids)
            held.clear()
            docs.clear()
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("planes", pa.int32()), ("block", pa.int32()), ("kind", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.list_(pa.binary()))])
        total = 0
        for b in in_slices(batches):
            for doc, ids in zip(b.column("doc_id").to_pylist(), whole(b.column("text"), encode_slice(b.column("text"), known, fresh)), strict=True):
                held.append(ids + end)
                docs.append(doc)
                total += len(held[-1]) // 4
                if total >= chunk_ids:
                    yield flush()
                    total = 0
        if docs:
            yield flush()

    rows = texts(df, id_col, text_col).withColumn("order", F.xxhash64("text")).repartitionByRange(n, "doc_id", "order").sortWithinPartitions("doc_id", "order").drop("order").mapInArrow(run, SCHEMA)
    rows.write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if ``with_ids``, the ids, from the chunks below ``path``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                ids = from_planes(row["data"], row["planes"], row["kind"], row["block"], row["n_ids"], decompress)
                raw, ends = ids.tobytes(), np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                out = [pa.array([row["shard"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + starts, pa.int64()), pa.array(row["lengths"], pa.int64())]
                out.append(pa.array([zlib.crc32(raw[a * 4 : z * 4]) for a, z in zip(starts, ends, strict=True)], pa.int64()))
                out += [pa.array([ids[a:z].astype(np.int32) for a, z in zip(starts, ends, strict=True)], pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(out, names=["shard", "doc_id", "within", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    chunks = spark.read.schema(SCHEMA).parquet(path)
    # One row for each shard: as many as the writing job had tasks.
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    docs = chunks.mapInArrow(run, f"shard int, doc_id long, within long, n_tokens long, ids_crc32 long{', ids array<int>' if with_ids else ''}")
    out = docs.join(F.broadcast(shards.select("shard", before.alias("before"))), "shard")
    return out.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


