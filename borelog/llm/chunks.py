"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 32 bytes places the cuts, so an insertion shifts no cut beyond its neighbours; chunks are
compared by 128-bit digests. The first occurrence of a chunk (lowest document, then place) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, hot_keys, in_slices, meet, mix, row_tag, texts
from .suffixes import KEYS, shrunk

#: One 32-bit number for each byte value, from a rule.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
WINDOW = 32


def gear(raw: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gear numbers of the last 32 bytes, each shifted by its distance: h = (h << 1) + gear[byte], for all places at once."""
    h = GEAR[raw]
    step = 1
    while step < WINDOW:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, 2 * step
    return h


def cuts(raw: np.ndarray, offsets: np.ndarray, bits: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every chunk of concatenated texts: ``least`` to ``most`` bytes (a text's last one may be shorter)."""
    marks = (np.flatnonzero(gear(raw) >> np.uint32(32 - bits) == 0) + 1).tolist()
    marks.append(len(raw) + most + 1)
    start, end, at = [], [], 0
    for pos, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while pos < stop:
            while marks[at] < pos + least:
                at += 1
            to = min(marks[at], pos + most, stop)
            start.append(pos)
            end.append(to)
            pos = to
    return np.array(start, np.int64), np.array(end, np.int64)


def chunks(rows: DataFrame, bits: int, least: int, most: int) -> DataFrame:
    """g1, g2 (digest), doc, tag, packed (start << 16 | bytes) of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in in_slices(batches):
            raw, offsets = as_bytes(b.column("text"))
            start, end = cuts(raw, offsets, bits, least, most)
            if not len(start):
                continue
            data = raw.tobytes()
            digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[a:z]) for a, z in zip(start.tolist(), end.tolist(), strict=True)]), "<i8").reshape(-1, 2)
            row = np.searchsorted(offsets, start, side="right") - 1
            packed = (start - offsets[row]) << 16 | (end - start)
            cols = [digest[:, 0].copy(), digest[:, 1].copy(), b.column("doc").to_numpy()[row], b.column("tag").take(pa.array(row)), packed]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["g1", "g2", "doc", "tag", "packed"])

    return rows.select("doc", "tag", "text").mapInArrow(run, "g1 long, g2 long, doc long, tag binary, packed long")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 5, least: int = 32, most: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_chunks_repeated, spans (start, end of each maximal removed run) and kept (the other bytes) for every row.

    A chunk is repeated if its digest occurs twice in the table; every chunk but its first occurrence goes, however short.
    A null text is empty; a chunk may repeat within a text; of rows equal in id and text one is first and all of the others
    goes; of documents with one id the least digest is first; a null id stays null and counts as -1 in the
    order; an empty table gives no rows. A very long text is chunked whole, in a task's memory of some ten times its bytes. ``least`` is 32 at least, the hash's window, so
    that no cut depends on the text before."""
    if not WINDOW <= least <= most < 1 << 16:
        raise ValueError("sizes must be 32 <= least <= most < 65536")
    rows = texts(df, id_col, text_col).select(F.coalesce("doc_id", F.lit(-1)).alias("doc"), row_tag(F.col("doc_id"), F.col("text")).alias("tag"), "doc_id", "text")
    spark = df.sparkSession
    found = chunks(rows, bits, least, most)
    twice = found.groupBy("g1", "g2").agg(F.count("*").alias("n"), F.min(F.struct("doc", "packed", "tag")).alias("one")).where("n > 1")
    twice = cut(spark, twice, "chunks")
    hits = meet(found, twice.select("g1", "g2", "one"), ["g1", "g2"], hot_keys(twice, ["g1", "g2"]), ["doc", "tag", "packed"]).select(*KEYS, "packed", (F.struct("doc", "packed", "tag") != F.col("one")).alias("later"))
    hits = cut(spark, hits.groupBy(*KEYS).agg(F.collect_set(F.struct("packed", "later")).alias("hits")), "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in in_slices(batches, "blob", 1 << 20):
            out: list[list] = [[], [], [], []]
            for blob, found in zip(b.column("blob").to_pylist(), b.column("hits").to_pylist(), strict=True):
                data = expand(blob)
                for column, value in zip(out, (len(data), len(found or []), *removed(data, found or [])), strict=True):
                    column.append(value)
            cols = [b.column("doc_id"), b.column("rows"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], span), pa.array(out[3], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "rows", "n_bytes", "n_chunks_repeated", "spans", "kept"])

    # Equal rows are one on the way, gathered before the shuffle; each comes back as a row of its own.
    one = shrunk(rows).groupBy(*KEYS).agg(F.first("doc_id").alias("doc_id"), F.first("blob").alias("blob"), F.count("*").alias("rows"))
    joined = one.join(hits, KEYS, "left").select("doc_id", "rows", "blob", "hits")
    each = joined.mapInArrow(run, "doc_id long, rows long, n_bytes long, n_chunks_repeated long, spans array<struct<start:long,end:long>>, kept binary")
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    whole = F.filter(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))), lambda s: s["end"] > 0)
    spans, kept = F.when(F.col("copy") == 1, F.col("spans")).otherwise(whole), F.when(F.col("copy") == 1, F.col("kept")).otherwise(F.lit(b""))
    return each.select("doc_id", "n_bytes", "n_chunks_repeated", spans.alias("spans"), kept.alias("kept"))


def removed(data: bytes, hits: list[dict]) -> tuple[list[dict], bytes]:
    """The merged spans that go from one text, and what stays of it."""
    spans: list[dict] = []
    for start, end in sorted((x["packed"] >> 16, (x["packed"] >> 16) + (x["packed"] & 0xFFFF)) for x in hits if x["later"]):
        if spans and spans[-1]["end"] == start:
            spans[-1]["end"] = end
        else:
            spans.append({"start": start, "end": end})
    ends = [0, *[s["end"] for s in spans]]
    return spans, b"".join(data[a:z] for a, z in zip(ends, [*[s["start"] for s in spans], len(data)], strict=True))
