"""Ranked lexical search over compressed postings.

The index is a Parquet data set. A shard is a run of whole documents in doc_id order; it has one row for its documents
(ids and lengths) and one row for each of its terms: which documents hold it and how often, as deltas and counts of seven
bits a byte. A query meets a shard document at a time: a heap holds the cursors of its terms by the next document of each,
the least is taken with all that stand within the same short window of documents, and a bounded heap keeps the best,
by score and then doc_id. A task carries that heap on from shard to shard, so only the best of each task are merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, in_blocks, in_slices, texts, words

#: Bytes of text in a shard (one document at least), documents in a window, characters of queries that are broadcast at a time.
SHARD_BYTES, WINDOW, BLOCK_CHARS = 4 << 20, 512, 2_000_000
#: What a term is made of, and the characters that are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = "shard long, term string, held long, occurrences long, nulls int, postings binary"
#: The term of a shard's row of documents; no term is empty.
DOCUMENTS = ""


def packed(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers as bytes of seven bits, lowest first, the last of each below 128; and where each bound falls in them."""
    left = values.astype(np.uint64)
    length = np.ones(len(left), np.int64)
    for k in range(1, 10):
        more = left >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        length += more
    ends = np.cumsum(length)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - length
    todo = np.arange(len(left))
    while len(todo):
        low = (left[todo] & np.uint64(127)).astype(np.uint8)
        left[todo] >>= np.uint64(7)
        go_on = left[todo] > 0
        out[at[todo]] = low | (go_on.astype(np.uint8) << 7)
        at[todo] += 1
        todo = todo[go_on]
    return out, np.r_[0, ends][bounds]


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(raw < 128)
    if len(end) == len(raw):
        return raw.astype(np.uint64)
    start = np.r_[0, end[:-1] + 1]
    out = np.zeros(len(end), np.uint64)
    for k in range(int((end - start).max()) + 1):
        at = start + k
        on = at <= end
        out[on] |= (raw[at[on]] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of concatenated texts (lower-cased in place): the number of each place's term, its document, and where each numbered term stands first."""
    raw += ((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5
    solid = (raw >= 128) | (raw >= 48) & (raw <= 57) | (raw >= 97) & (raw <= 122)
    start, end, key = words(raw, offsets, solid)
    of, distinct = pd.factorize(key)
    first = np.zeros(len(distinct), np.int64)
    first[of[::-1]] = np.arange(len(of) - 1, -1, -1)
    one, size = first[of], end - start
    same = (size[one] == size).all()
    if same and len(of):  # two terms may have one hash: each place is held against its term's first, byte by byte
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = (raw[np.repeat(start[one], size) + step] == raw[np.repeat(start, size) + step]).all()
    if not same:
        data = raw.tobytes()
        of, _ = pd.factorize(np.array([data[a:z] for a, z in zip(start.tolist(), end.tolist(), strict=True)], object))
        first = np.zeros(of.max() + 1, np.int64)
        first[of[::-1]] = np.arange(len(of) - 1, -1, -1)
    doc = np.searchsorted(offsets, start, side="right") - 1
    return of, doc, start[first], end[first]


def shard_rows(shard: int, ids: pa.Array, strings: pa.Array) -> pa.RecordBatch | None:
    """The index rows of one shard, documents in doc_id order (null last); documents without a term are left out."""
    order = pc.array_sort_indices(ids, null_placement="at_end")
    ids, strings = ids.take(order), strings.take(order)
    raw, offsets = as_bytes(strings)
    raw = raw.copy()
    of, doc, start, end = terms(raw, offsets)
    if not len(of):
        return None
    length = np.bincount(doc, minlength=len(ids))
    held = np.flatnonzero(length)
    number = np.cumsum(length > 0) - 1
    ids, length = ids.take(pa.array(held)), length[held]
    known = len(ids) - ids.null_count
    values = ids.slice(0, known).to_numpy(zero_copy_only=False).astype(np.int64)
    deltas = np.diff(values.view(np.uint64), prepend=np.uint64(0))  # wraps for ids below 0, and back when read
    about, _ = packed(np.r_[deltas, length.astype(np.uint64)], np.zeros(0, np.int64))
    n = len(held)
    cell = of.astype(np.int64) * n + number[doc]
    cell.sort()
    new = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    tf = np.diff(np.r_[new, len(cell)])
    term, at = cell[new] // n, cell[new] % n
    df = np.bincount(term, minlength=len(start))
    below = np.cumsum(df) - df
    gap = at.copy()
    gap[1:] -= np.where(term[1:] == term[:-1], at[:-1], 0)
    place = np.arange(len(term)) - below[term]
    both = np.zeros(2 * len(term), np.uint64)
    both[2 * below[term] + place] = gap
    both[2 * below[term] + df[term] + place] = tf
    data, bounds = packed(both, np.r_[2 * below, 2 * len(term)])
    size = end - start
    text = raw[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    names = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32).tobytes()), pa.py_buffer(text.tobytes()))
    blobs = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    columns = [
        pa.array(np.full(len(start) + 1, shard, np.int64)), pa.concat_arrays([pa.array([DOCUMENTS]), names]), pa.array(np.r_[n, df]),
        pa.array(np.r_[length.sum(), np.bincount(of, minlength=len(start))]), pa.array(np.r_[n - known, np.zeros(len(start))].astype(np.int32)), pa.concat_arrays([pa.array([about.tobytes()], pa.binary()), blobs]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "held", "occurrences", "nulls", "postings"])


def build(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the index of every row's whole text below ``path``. No shuffle: a shard is made of rows that are read together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for b in gathered(batches, shard_bytes):
            rows = shard_rows(shard, b["doc_id"].combine_chunks(), b["text"].combine_chunks())
            shard += 1
            if rows is not None:
                yield from (rows.slice(a, 20_000) for a in range(0, rows.num_rows, 20_000))

    texts(df, id_col, text_col).mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(path)


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Tables of about ``limit`` bytes of text each, one row at least; batches are cut and joined as needed."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in in_slices(batches, limit=limit // 4, rows=1 << 30):
        n = int(pc.sum(pc.binary_length(b.column("text"))).as_py() or 0)
        if held and size + n > limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield pa.Table.from_batches(held)


class Best:
    """The k best of what was added, by score and then by the lesser doc_id (a null id is beyond all)."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    @property
    def least(self) -> int:
        """A score below this one cannot come in."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, score: int, doc: int | None) -> None:
        entry = (score, doc is not None, -(doc or 0))
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    def rows(self) -> list[tuple[int, int | None]]:
        return [(score, -doc if known else None) for score, known, doc in self.heap]


class Shard:
    """One shard's documents and the postings that the queries ask for."""

    def __init__(self, held: int, nulls: int, postings: bytes, total: int, occurrences: int):
        values = unpacked(postings)
        known = held - nulls
        self.ids: list = [*np.cumsum(values[:known]).view(np.int64).tolist(), *[None] * nulls]
        length = values[known:].astype(np.int64)
        self.m = 75 + 25 * length * total // occurrences
        self.terms: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}

    def add(self, term: str, held: int, postings: bytes, weight: int) -> None:
        """Which documents hold a term, and what it adds to the score of each."""
        if not weight:
            return
        values = unpacked(postings).astype(np.int64)
        at, tf = np.cumsum(values[:held]), values[held:]
        score = weight * (1_000_000_000 * tf // (1000 * tf + 12 * self.m[at]))
        self.terms[term] = (at, score, int(score.max()))

    def search(self, query: list[tuple[str, int]], best: Best, window: int) -> None:
        """Documents in order: the cursors that stand within the next window are taken off the heap together."""
        cursors = [(*self.terms[t], n) for t, n in query if t in self.terms]
        heads = [(int(at[0]), i, 0) for i, (at, *_) in enumerate(cursors)]
        heapq.heapify(heads)
        while heads:
            low = heads[0][0]
            here, bound = [], 0
            while heads and heads[0][0] < low + window:
                _, i, start = heads[0]
                at, score, most, n = cursors[i]
                end = int(np.searchsorted(at, low + window))
                here.append((at[start:end], score[start:end], n))
                bound += most * n
                if end < len(at):
                    heapq.heapreplace(heads, (int(at[end]), i, end))
                else:
                    heapq.heappop(heads)
            if bound < best.least:
                continue  # not even all of these terms at their highest would come in
            total = np.zeros(window, np.int64)
            for at, score, n in here:
                total[at - low] += n * score
            found = np.flatnonzero(total >= best.least)
            for k in found[np.argsort(-total[found], kind="stable")].tolist():
                if total[k] < best.least:
                    break
                best.add(int(total[k]), self.ids[low + k])


def query_terms(queries: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item, term, n): how often each item has each of its terms."""
    low = F.translate(F.col(item_text).cast("string"), UPPER, LOWER)
    each = queries.select(F.col(item_id).alias("item"), F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term"))
    return each.groupBy("item", "term").agg(F.count("*").cast("int").alias("n"))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of the index below ``path`` for each query, those with a score above 0.

    Equal scores by ascending doc_id, a null one last; rows that share an id, or are equal, are documents of their own. A
    null or empty text, or one without a term, is neither found nor finds anything; a very long text is one document, a very
    long query one query. Queries that share an id are one query. Empty tables give no rows; other columns are ignored, whatever their names.
    Terms and weights of the queries are broadcast, ``block_chars`` characters of queries and one query at a time; each block
    is one pass over the postings of its terms."""
    index = spark.read.schema(INDEX).parquet(path)
    total, occurrences = index.where(F.col("term") == DOCUMENTS).agg(F.sum("held"), F.sum("occurrences")).first()
    given = queries.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("words")).where(F.col("words").rlike(TERM))
    out = None
    for block in in_blocks(given, F.length("words"), block_chars, "item") if total else []:
        found = one_block(spark, index, block, total, occurrences, k, window)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def one_block(spark: SparkSession, index: DataFrame, block: DataFrame, total: int, occurrences: int, k: int, window: int) -> DataFrame:
    """The best documents of each task for each query of a block; the block's terms go through the driver, as many as its characters allow."""
    asked = query_terms(block, "item", "words").collect()
    names = spark.createDataFrame([(t,) for t in sorted({r["term"] for r in asked})], "term string")
    held = index.join(F.broadcast(names), "term").groupBy("term").agg(F.sum("held").alias("held")).collect()
    weights = {r["term"]: math.floor(1000 * math.log((2 * total + 2) / (2 * r["held"] + 1))) for r in held}
    query: dict[int | None, list[tuple[str, int]]] = {}
    for r in asked:
        if weights.get(r["term"]):
            query.setdefault(r["item"], []).append((r["term"], r["n"]))
    shared = spark.sparkContext.broadcast((weights, query))
    wanted = spark.createDataFrame([(t,) for t in [DOCUMENTS, *sorted(t for t, w in weights.items() if w)]], "term string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, query = shared.value
        best = {item: Best(k) for item in query}
        shard = None

        def finish() -> None:
            if shard is not None and shard.terms:
                for item, asked in query.items():
                    shard.search(asked, best[item], window)

        for b in batches:
            for term, held, nulls, postings in zip(b.column("term").to_pylist(), b.column("held").to_pylist(), b.column("nulls").to_pylist(), b.column("postings").to_pylist(), strict=True):
                if term == DOCUMENTS:
                    finish()
                    shard = Shard(held, nulls, postings, total, occurrences)
                else:
                    shard.add(term, held, postings, weights[term])
        finish()
        rows = [(item, doc, score) for item, b in best.items() for score, doc in b.rows()]
        for at in range(0, len(rows), 10_000):
            item, doc, score = zip(*rows[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = index.join(F.broadcast(wanted), "term", "left_semi").select("shard", "term", "held", "nulls", "postings")
    return postings.repartition(parts, "shard").sortWithinPartitions("shard", "term").mapInArrow(run, "item long, doc_id long, score long")


SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
docs AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, t FROM texts WHERE len(t) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
asked AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
postings AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term),
scores AS (SELECT item_id, doc_id, r, CAST(sum(a.n * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * p.n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked a JOIN postings p USING (term) JOIN weights USING (term), totals GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
