"""Removal of repeated byte strings through sorted suffixes.

A string of ``length`` bytes that occurs twice has the same anchor in both places (see anchors), so only suffixes that
begin at anchors are sorted, with the bytes before the anchor beside them. The stages:

1. Each text's anchors, with a digest of the bytes that its windows cover (a segment); anchors whose leading bytes occur
   once are dropped by a semi-join against the counts.
2. Equal segments are counted; all their windows repeat. Only leading bytes that go on in different ways are compared.
3. One copy of each such segment is range-partitioned by its suffix (Spark samples the splitters). A bucket goes through
   its suffixes in runs of whole groups of leading bytes, GROUP segments at most, and sorts each run by multikey
   quicksort. Two windows are equal if they are in one class by the bytes from the anchor on and in one class by the
   bytes before it.
4. A group of more than GROUP segments is cut, within a bucket and by the splitters. Its windows whose suffix part equals
   that of a run's first or last suffix may have a partner in another run; one of each class is compared by digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors, pieces
from .common import as_bytes, cut, hot_keys, in_slices, meet, row_tag, texts

KEYS = ["doc", "tag"]
#: Segments that a bucket sorts at a time, which bounds its memory; groups with more are cut and compared across the cuts.
GROUP = 20_000


def multikey_order(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of zero-padded byte strings (a shorter one first) and how many bytes each shares with the one before it.

    Multikey quicksort, a word of eight bytes at a time: only rows that tie so far are ordered by their next word."""
    n, width = rows.shape
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable") if width else np.arange(n)
    if n < 2:
        return order, np.zeros(n, np.int64)
    differs = np.ones(n, bool)
    differs[1:] = words[order[1:], 0] != words[order[:-1], 0] if width else False
    for k in [*range(1, words.shape[1]), None]:
        tied = ~differs
        tied[:-1] |= ~differs[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(differs)[at]
        key = lengths if k is None else words[:, k]
        order[at] = order[at][np.lexsort((key[order[at]], group))]
        same = group[1:] == group[:-1]
        apart = key[order[at[1:]]] != key[order[at[:-1]]]
        differs[at[1:]] |= same & apart
    shared = np.zeros(n, np.int64)
    for at in range(1, n, 1 << 14):
        a, b = order[at - 1 : min(n, at + (1 << 14)) - 1], order[at : at + (1 << 14)]
        apart = rows[a] != rows[b]
        first = np.where(apart.any(1), apart.argmax(1), width)
        shared[at : at + (1 << 14)] = np.minimum(first, np.minimum(lengths[a], lengths[b]))
    return order, shared


def padded(raw: np.ndarray, start: np.ndarray, lengths: np.ndarray, step: int, width: int) -> np.ndarray:
    """The strings from ``start`` forwards (step 1) or backwards (step -1), zero-padded to whole words."""
    out = np.zeros((len(start), max(8, -(-width // 8) * 8)), np.uint8)
    place = np.arange(out.shape[1])
    for at in range(0, len(start), 1 << 14):
        rows = slice(at, at + (1 << 14))
        inside = place < lengths[rows, None]
        out[rows][inside] = raw[(start[rows, None] + step * place)[inside]]
    return out


def in_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole groups of equal ``h``, in the order they arrive, with at most ``most`` rows; a larger group comes in several."""
    held: list[pa.RecordBatch] = []
    size = 0

    def some(count: int) -> pa.Table:
        nonlocal held, size
        every = pa.Table.from_batches(held)
        rest = every.slice(count)
        held, size = rest.to_batches(), len(rest)
        return every.slice(0, count)

    for b in batches:
        for at in range(0, b.num_rows, most):
            held.append(b.slice(at, most))
            size += held[-1].num_rows
            while size > most:
                h = np.concatenate([x.column("h").to_numpy() for x in held])
                new = np.flatnonzero(h[1 : most + 1] != h[:most]) + 1
                yield some(int(new[-1]) if len(new) else most)
    if size:
        yield some(size)


def resolve(batches: Iterator[pa.RecordBatch], length: int, most: int) -> Iterator[pa.RecordBatch]:
    for run in in_runs(batches, most):
        yield from resolve_run(run, length)


def resolve_run(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """One run's windows: stretches (h, d, low, high) of distances from window start to anchor whose windows repeat in the
    run, and a row (w1, w2) for each class that another run may hold, with (h, d, low) if it still needs an answer."""
    import xxhash

    n = table.num_rows
    seg = table.column("seg").combine_chunks()
    raw, offsets = as_bytes(seg)
    most = table.column("most").to_numpy().astype(np.int64)
    least = most - (np.diff(offsets) - length)
    anchor = offsets[:-1] + most
    after, before = np.minimum(offsets[1:] - anchor, length), most
    order_r, shared_r = multikey_order(padded(raw, anchor, after, 1, length), after)
    order_l, shared_l = multikey_order(padded(raw, anchor - 1, before, -1, length), before)
    edge = np.zeros(n, np.int64)  # bytes shared with the run's first or last suffix
    first, last = np.minimum.accumulate(np.r_[length, shared_r[1:]]), np.r_[np.minimum.accumulate(shared_r[:0:-1])[::-1], length]
    edge[order_r] = np.maximum(first, last)
    edge[~table.column("large").to_numpy(zero_copy_only=False)] = -1  # the whole group is here
    whole = table.column("n").to_numpy() > 1
    h, d = table.column("h").to_numpy(), table.column("d").to_numpy()
    kept: list[tuple[np.ndarray, int]] = []
    opened: list[tuple] = []
    data = raw.tobytes()
    class_r, class_l = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a in range(int(least.min()), int(most.max()) + 1):
        rows = np.flatnonzero((least <= a) & (a <= most))
        if not len(rows):
            continue
        class_r[order_r], class_l[order_l] = np.cumsum(shared_r < length - a), np.cumsum(shared_l < a)
        _, at, inverse, count = np.unique(class_r[rows] * (n + 1) + class_l[rows], return_index=True, return_inverse=True, return_counts=True)
        repeated = (count > 1)[inverse]
        if len(found := rows[repeated & ~whole[rows]]):
            kept.append((found, a))
        pick = rows[at]
        loose = edge[pick] >= length - a
        for i, alone in zip(pick[loose].tolist(), (count[loose] == 1) & ~whole[pick[loose]], strict=True):
            s = int(anchor[i]) - a
            w = xxhash.xxh3_128_digest(data[s : s + length])
            opened.append((int.from_bytes(w[:8], "little", signed=True), int.from_bytes(w[8:], "little", signed=True), *((int(h[i]), int(d[i]), a) if alone else (None, None, None))))
    names = ["w1", "w2", "h", "d", "low", "high"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    if kept:
        row, a = np.concatenate([r for r, _ in kept]), np.concatenate([np.full(len(r), a) for r, a in kept])
        at = np.lexsort((a, row))
        row, a = row[at], a[at]
        new = np.r_[True, (row[1:] != row[:-1]) | (a[1:] != a[:-1] + 1)]
        start = np.flatnonzero(new)
        end = np.r_[start[1:], len(row)] - 1
        none = pa.nulls(len(start), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(h[row[start]]), pa.array(d[row[start]]), pa.array(a[start], pa.int32()), pa.array(a[end], pa.int32())], names=names)
    for at in range(0, len(opened), 50_000):
        cols = list(zip(*opened[at : at + 50_000], strict=True))
        yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, types, strict=False)], pa.array(cols[4], pa.int32())], names=names)


def anchored(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """h (leading bytes), d (segment), doc, tag, and packed: place << 16 | most << 8 | least distance of a window's start before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in in_slices(batches):
            doc, tag = b.column("doc").to_numpy(), b.column("tag")
            everything, bounds = as_bytes(b.column("text"))
            for raw, offsets, shift in pieces(everything, bounds, length):
                h, place, first, last = anchors(raw, offsets, length, gram)
                if not len(h):
                    continue
                data, most, least = raw.tobytes(), place - first, place - last
                d = [xxhash.xxh3_64_intdigest(data[a : z + length], m) for a, z, m in zip(first.tolist(), last.tolist(), most.tolist(), strict=True)]
                row = np.searchsorted(offsets, place, side="right") - 1
                inside = place + shift - bounds[row]
                packed = inside << 16 | most << 8 | least
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.array(d, np.uint64).view(np.int64)), pa.array(doc[row]), tag.take(pa.array(row)), pa.array(packed)], names=["h", "d", "doc", "tag", "packed"])

    return rows.select("doc", "tag", "text").mapInArrow(run, f"h long, d long, doc long, tag {rows.schema['tag'].dataType.simpleString()}, packed long")


def shrunk(rows: DataFrame) -> DataFrame:
    """doc, tag, doc_id (and rest, where there is one) and the text compressed with zstandard, to shuffle less."""
    others = [c for c in ("doc", "tag", "doc_id", "rest") if c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        for b in in_slices(batches):
            raw, offsets = as_bytes(b.column("text"))
            data = raw.tobytes()
            blobs = [compress(data[a:z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], pa.array(blobs, pa.binary())], names=[*others, "blob"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select(*others, "text").mapInArrow(run, f"{schema}, blob binary")


def segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for b in in_slices(batches, "blob", 1 << 19):
        out: list[list] = [[], [], [], [], [], []]
        for blob, wanted in zip(b.column("blob").to_pylist(), b.column("wanted").to_pylist(), strict=True):
            data = expand(blob)
            for w in wanted:
                place, most, least = w["packed"] >> 16, w["packed"] >> 8 & 255, w["packed"] & 255
                for column, value in zip(out, (w["h"], w["d"], w["n"], w["large"], most, data[place - most : place - least + length]), strict=True):
                    column.append(value)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.binary())], names=["h", "d", "n", "large", "most", "seg"])


def repeated_spans(rows: DataFrame, blobs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc, tag and the spans (start, end) of windows that repeat, not merged yet."""
    spark = rows.sparkSession
    found = anchored(rows, length, gram)
    common = cut(spark, found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "common")
    members = cut(spark, meet(found, common.select("h"), ["h"], hot_keys(common, ["h"]), ["doc", "tag", "packed"], "left_semi"), "members")
    kinds = cut(spark, members.groupBy("h", "d").agg(F.count("*").alias("n"), F.min(F.struct("doc", "tag", "packed")).alias("one")), "kinds")
    mixed = cut(spark, kinds.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "mixed")
    wanted = meet(kinds, mixed.select("h", (F.col("n") > GROUP).alias("large")), ["h"], hot_keys(mixed, ["h"]), ["d"])
    wanted = wanted.groupBy(F.col("one.doc").alias("doc"), F.col("one.tag").alias("tag"))
    wanted = cut(spark, wanted.agg(F.collect_list(F.struct("h", "d", "n", "large", F.col("one.packed").alias("packed"))).alias("wanted")), "wanted")
    # A text's wanted rows are bounded by its own length. Of rows equal in id and text one is read.
    segs = blobs.join(wanted, KEYS).select(*KEYS, "blob", "wanted").dropDuplicates(KEYS).select("blob", "wanted").mapInArrow(lambda it: segments(it, length), "h long, d long, n long, large boolean, most int, seg binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lead, most = F.expr(f"substring(seg, most + 1, if(large, {length}, {gram}))"), GROUP
    order = [lead, F.when(F.col("large"), F.col("d"))]
    buckets = segs.repartitionByRange(n, *order).sortWithinPartitions(*order)
    answers = cut(spark, buckets.mapInArrow(lambda it: resolve(it, length, most), "w1 long, w2 long, h long, d long, low int, high int"), "answers")
    opened = answers.where("w1 is not null")
    twice = opened.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    across = opened.where("h is not null").join(twice, ["w1", "w2"], "left_semi").select("h", "d", "low", "high")
    single = answers.where("w1 is null").select("h", "d", "low", "high").union(across)
    copies = kinds.where("n > 1").select("h", "d", F.expr("int(one.packed & 255)").alias("low"), F.expr("int(shiftright(one.packed, 8) & 255)").alias("high"))
    runs = single.union(copies).groupBy("h", "d").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    hits = meet(members, runs, ["h", "d"], hot_keys(kinds.select("h", "d", "n"), ["h", "d"]), ["doc", "tag", "packed"])
    hits = hits.select(*KEYS, F.expr("shiftright(packed, 16)").alias("place"), F.explode("runs").alias("run"))
    return hits.select(*KEYS, (F.col("place") - F.col("run.high")).alias("start"), (F.col("place") - F.col("run.low") + length).alias("end"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 32, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of each maximal removed run) and kept (the other bytes) for every row, with the columns ``keep``.

    A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else in the table, the same text
    included; strings are judged on the input and never span two texts. A null text is empty, a text shorter than
    ``length`` is kept whole, an empty table gives no rows; rows that repeat a whole text all lose it, one result each;
    a null id stays null. ``gram`` must be a multiple of 8 and ``length`` at most ``gram`` + 223."""
    if gram % 8 or not gram <= length <= gram + 223:
        raise ValueError("gram must be a multiple of 8, and length from gram to gram + 223")
    rest = [F.struct(*[F.col(c) for c in keep]).alias("rest")] if keep else []
    rows = texts(df.select(F.col(id_col), F.col(text_col), *rest), id_col, text_col, *["rest"] * bool(keep))
    rows = rows.select(F.coalesce("doc_id", F.lit(-1)).alias("doc"), row_tag(F.col("doc_id"), F.col("text")).alias("tag"), "doc_id", "text", *["rest"] * bool(keep))
    spark = df.sparkSession
    blobs = shrunk(rows)
    spans = repeated_spans(rows, blobs, length, gram).groupBy(*KEYS).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = cut(spark, spans, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in in_slices(batches, "blob", 1 << 20):
            size, kept, merged = [], [], []
            for blob, found in zip(b.column("blob").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data = expand(blob)
                runs: list[dict] = []
                for s, e in sorted((x["start"], x["end"]) for x in found or []):
                    if runs and s <= runs[-1]["end"]:
                        runs[-1]["end"] = max(e, runs[-1]["end"])
                    else:
                        runs.append({"start": s, "end": e})
                size.append(len(data))
                merged.append(runs)
                kept.append(b"".join(data[a:z] for a, z in zip([0, *[r["end"] for r in runs]], [*[r["start"] for r in runs], len(data)], strict=True)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], pa.array(size, pa.int64()), pa.array(merged, span), pa.array(kept, pa.binary())], names=[*own, "n_bytes", "spans", "kept"])

    own = ["doc_id", *["rest"] * bool(keep)]
    joined = blobs.join(spans, KEYS, "left").select(*own, "blob", "spans")
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in own)
    out = joined.mapInArrow(run, f"{schema}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.select("doc_id", "n_bytes", "spans", "kept", *[F.col(f"rest.`{c}`") for c in keep or []])
