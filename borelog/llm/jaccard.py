"""Near-duplicate documents: a Jaccard join of word n-gram sets with Bayesian pruning of candidates.

1. Every text becomes a set of hashed shingles of five words, a digest of the set, and its first shingles in the order of
   their hashes. Texts with equal sets are one class from here on.
2. Sets at the threshold share some of their first shingles for certain (``first_shingles``): a class of which fewer are met
   in other classes has no link, and of those met all but the most frequent ones are its buckets. Every pair at the
   threshold has a common bucket. A bucket's hub is its least class.
3. Classes are laid in order of the hub that most classes have of those they have, and cut into blocks. The classes of a
   hub that a block cannot hold are a zone of larger blocks, never more than make two cells a task, so the rows moved grow
   with the zone and not with its square. A class goes to each pair of blocks (a cell), its own and one of its zone, or one
   that holds a class of a common hub; a pair of classes meets there once. Their 128 MinHash values are compared 32 at a
   time; a pair whose posterior probability of reaching the threshold has fallen below the tolerance is dropped as soon as
   a bound on the sets (``apart``) proves it right, and all others are verified on the whole sets, so chance leaves no link
   out. A cell returns one row for each class (links, and the least class that links within the cell lead to), never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, hot_keys, in_groups, in_slices, meet, mix, odd_numbers, row_tag, texts, words
from .graph import components
from .suffixes import shrunk

HASHES, STEP = 128, 32
#: Part of a set's shingles that it and a linked one have in common, for certain, among their first ones (the threshold, if that is less).
FIRST = 0.1
#: Bytes of a hash by which first shingles meet; it only makes candidates.
MARK = 5
#: Stands for a null id, which comes last.
LAST = (1 << 63) - 1
BLOCK = 128
#: Classes, and shingles of all of them, in a block of a zone, as long as that makes no more cells than two a task.
ZONE_BLOCK, ZONE_SHINGLES = 1024, 1 << 20


def shingle_sets(strings: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every text's word n-grams in one array, and where each text's begin. Case is ignored; a text of fewer words has one, of all its words."""
    raw, offsets = as_bytes(pc.utf8_lower(strings))
    start, _, h = words(raw, offsets)
    doc = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(start, offsets)
    count = np.diff(first)
    factor = odd_numbers(n, 7)
    out, of = [], []
    if len(h) >= n:
        gram = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            gram += h[k : len(h) - n + 1 + k] * factor[k]
        whole = doc[: len(gram)] == doc[n - 1 :]
        out.append(mix(gram[whole]))
        of.append(doc[: len(gram)][whole])
    for i in np.flatnonzero((count > 0) & (count < n)).tolist():
        own = h[first[i] : first[i + 1]]
        out.append(mix((own * factor[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own))))
        of.append(np.array([i]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(strings) + 1, np.int64)
    gram, doc = np.concatenate(out), np.concatenate(of)
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    new = np.r_[True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])]
    gram, doc = gram[new], doc[new]
    return gram, np.searchsorted(doc, np.arange(len(strings) + 1))


def min_hashes(gram: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A row of MinHash values for each set that isn't empty (the others: the largest number)."""
    a, b = odd_numbers(HASHES, 11), odd_numbers(HASHES, 13)
    full = np.flatnonzero(np.diff(start))
    out = np.full((len(start) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    if len(full):
        at = start[:-1][full]
        for k in range(HASHES):
            v = gram * a[k] + b[k]
            v ^= v >> np.uint64(29)
            v *= b[k]
            out[full, k] = np.minimum.reduceat(v, at) >> np.uint64(32)
    return out


def share(part: float, size: np.ndarray) -> np.ndarray:
    return np.ceil(part * size - 1e-9).astype(np.int64)


def first_shingles(size: np.ndarray, threshold: float, part: float = FIRST) -> tuple[np.ndarray, np.ndarray]:
    """How many first shingles of a set count, and how many of them a set at the threshold has among its own, for certain.

    A set of ``size`` shingles shares ``threshold`` of them at least, so lacks no more than the rest. Its m-th shared one is
    thus among its first m and the rest. With m a part of the size, m is less for the smaller of two sets, which has
    ``threshold`` of the larger's size at least."""
    part = min(part, threshold)
    need = share(threshold, size)
    return size - need + share(part, size), share(part, need)


def sketches(rows: DataFrame, n: int, threshold: float) -> DataFrame:
    """The digest of each text's set, and the leading bytes of its first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in in_slices(batches, limit=1 << 20):
            gram, start = shingle_sets(b.column("text"), n)
            data = gram.tobytes()
            digest = [xxhash.xxh3_128_digest(data[8 * s : 8 * e]) for s, e in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
            size = np.diff(start)
            lead = np.ascontiguousarray(gram.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - MARK :]).tobytes()
            first = [lead[MARK * s : MARK * (s + q)] for s, q in zip(start[:-1].tolist(), first_shingles(size, threshold)[0].tolist(), strict=True)]
            cols = [b.column("doc"), b.column("tag"), pa.array(size), pa.array(digest, pa.binary()), pa.array(first, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "tag", "size", "digest", "first"])

    return rows.select("doc", "tag", "text").mapInArrow(run, "doc long, tag binary, size long, digest binary, first binary")


def buckets(classes: DataFrame, threshold: float, part: float = FIRST) -> DataFrame:
    """(bucket, node), from (node, size, first): first shingles, such that every two classes at the threshold have one in common.

    Rows may repeat where hashes agree in their leading bytes; that makes more candidates, never fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "first", 1 << 20):
            raw, offsets = as_bytes(b.column("first"))
            mark = np.zeros((len(raw) // MARK, 8), np.uint8)
            mark[:, :MARK] = raw.reshape(-1, MARK)
            size, times = b.column("size").to_numpy(), np.diff(offsets) // MARK
            cols = [mark.view("<i8").ravel(), np.repeat(b.column("node").to_numpy(), times), np.repeat(first_shingles(size, threshold, part)[1], times)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", "node", "need"])

    by_bucket, by_node = Window.partitionBy("bucket"), Window.partitionBy("node")
    found = classes.select("node", "size", "first").mapInArrow(run, "bucket long, node long, need long")
    met = cut(classes.sparkSession, found.withColumn("n", F.count("*").over(by_bucket)).where("n > 1").drop("n"), "met")
    met = met.withColumn("of", F.count("*").over(by_node)).where("of >= need").drop("of")
    met = met.withColumn("n", F.count("*").over(by_bucket)).where("n > 1").withColumn("of", F.count("*").over(by_node))
    # rarest first: at least ``need`` are shared with a class at the threshold, so one is when the last need - 1 are left out
    met = met.withColumn("place", F.row_number().over(by_node.orderBy("n", "bucket"))).where("place <= of - need + 1")
    return cut(classes.sparkSession, met.select("bucket", "node").distinct(), "buckets")


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of values compared, the fewest matches at which the posterior probability (uniform prior) of a similarity of ``threshold`` or more is ``tolerance`` or more."""
    need = {}
    for n in range(STEP, HASHES + 1, STEP):
        below = 0.0
        for m in range(n + 1):
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                need[n] = m
                break
    return need


def apart(size: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Those of the pairs that cannot reach the threshold, for certain: every shingle turns over one bit, so each bit in which two sets differ is a shingle that one of them lacks."""
    both = size[left] + size[right]
    most = both - 2 * (threshold * both - 1e-9) / (1 + threshold) + 1e-6
    level = np.clip(np.ceil(np.log2(both)), 6, 16).astype(np.int64)
    out = np.zeros(len(left), bool)
    for k in np.unique(level).tolist():
        of = np.flatnonzero(level == k)
        used = np.unique(np.r_[left[of], right[of]])
        bit = np.concatenate([sets[i] for i in used.tolist()]) & np.uint64((1 << k) - 1)
        bits = np.zeros((len(used), 1 << (k - 6)), np.uint64)
        np.bitwise_xor.at(bits, (np.repeat(np.arange(len(used)), size[used]), bit >> np.uint64(6)), np.uint64(1) << (bit & np.uint64(63)))
        a, b = np.searchsorted(used, left[of]), np.searchsorted(used, right[of])
        step = (1 << 18) >> (k - 6)
        for at in range(0, len(of), step):
            part = slice(at, at + step)
            out[of[part]] = np.bitwise_count(bits[a[part]] ^ bits[b[part]]).sum(1, dtype=np.int64) > most[of[part]]
    return out


def linked(sketch: np.ndarray, size: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, need: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (left[i], right[i]) that reach the threshold."""
    ok = np.minimum(size[left], size[right]) >= threshold * np.maximum(size[left], size[right]) - 1e-9
    left, right = left[ok], right[ok]
    same = np.zeros(len(left), np.int32)
    unlikely = []
    for at in range(0, HASHES, STEP):
        if not len(left):
            break
        for k in range(0, len(left), 1 << 16):
            part = slice(k, k + (1 << 16))
            same[part] += (sketch[left[part], at : at + STEP] == sketch[right[part], at : at + STEP]).sum(1)
        ok = same >= need[at + STEP]
        unlikely.append((left[~ok], right[~ok]))
        left, right, same = left[ok], right[ok], same[ok]
    for a, b in unlikely:
        ok = ~apart(size, sets, a, b, threshold)
        left, right = np.r_[left, a[ok]], np.r_[right, b[ok]]
    if not len(left):
        return left, right
    used = np.unique(np.r_[left, right])
    code, column, times = np.unique(np.concatenate([sets[i] for i in used.tolist()]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used.tolist()])
    rank = np.cumsum(times > 1) - 1  # a shingle that one set alone has is in no intersection
    keep = times[column] > 1
    row, column = row[keep], rank[column[keep]]
    both = np.zeros((len(used), len(used)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        s, e = np.searchsorted(column, [at, at + 4096])
        dense = np.zeros((len(used), 4096), np.float32)
        dense[row[s:e], column[s:e] - at] = 1
        both += dense @ dense.T
    a, b = np.searchsorted(used, left), np.searchsorted(used, right)
    shared = both[a, b].astype(np.int64)
    ok = shared >= threshold * (size[left] + size[right] - shared) - 1e-9
    return left[ok], right[ok]


def join(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Joins the classes of each pair; ``label`` holds the least row that a row is joined to, before and after."""
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def verify(batches: Iterator[pa.RecordBatch], threshold: float, need: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """(node, links, least) for each class of each cell that has a link there: documents linked to, and the least class that links within the cell lead to."""
    out: list[list[np.ndarray]] = [[], [], []]

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["node", "links", "least"])
        for x in out:
            x.clear()
        return batch

    for group in in_groups(batches, ["i", "j"]):
        node, copies, block = (group.column(k).to_numpy() for k in ("node", "copies", "block"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        sketch = np.concatenate([as_bytes(c)[0].view(np.uint32) for c in group.column("sketch").chunks]).reshape(len(node), HASHES)
        sets = []
        for raw, offsets in map(as_bytes, group.column("grams").chunks):
            sets += [raw[s:e].view(np.uint64) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        size = np.array([len(x) for x in sets], np.int64)
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links, label = np.zeros(len(node), np.int64), np.arange(len(node))
        for s in range(0, len(a), BLOCK):
            for t in range(s if i == j else 0, len(b), BLOCK):
                p, q = a[s : s + BLOCK], b[t : t + BLOCK]
                left, right = np.nonzero(np.tri(len(p), len(q), -1, bool).T if i == j and s == t else np.ones((len(p), len(q)), bool))
                left, right = linked(sketch, size, sets, p[left], q[right], threshold, need)
                np.add.at(links, left, copies[right])
                np.add.at(links, right, copies[left])
                join(label, left, right)
        some = links > 0
        for column, value in zip(out, (node[some], links[some], node[label][some]), strict=True):
            column.append(value)
        if sum(map(len, out[0])) > 10_000:
            yield flush()
    if out[0]:
        yield flush()


def cells(own: DataFrame, size: DataFrame) -> DataFrame:
    """(node, block, other): the pairs of blocks that each class goes to, from the hubs that it has (node, hub) and its number of shingles (node, size)."""
    spark = own.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = ceil((2 * n) ** 0.5)  # blocks of a zone
    crowd = cut(spark, own.groupBy("hub").agg(F.count("*").alias("n")), "crowds")
    first = meet(own, crowd, ["hub"], hot_keys(crowd, ["hub"]), ["node"]).groupBy("node").agg(F.max(F.struct("n", -F.col("hub"))).alias("top"))
    first = cut(spark, first.select("node", (-F.col("top.col2")).alias("first")).join(size, "node"), "firsts")
    groups = first.groupBy("first").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    zones = groups.where(F.col("n") > BLOCK).select("first", F.ceil(F.greatest(F.col("n") / ZONE_BLOCK, F.col("size") / ZONE_SHINGLES)).alias("parts"))
    zones = cut(spark, zones.select("first", F.least("parts", F.lit(most)).cast("int").alias("parts"), (-1 - F.monotonically_increasing_id() * most).alias("zone")), "zones")
    cold = first.join(zones, "first", "left_anti").repartitionByRange(n, "first", "node").sortWithinPartitions("first", "node")
    cold = cold.select("node", F.expr(f"monotonically_increasing_id() div {BLOCK}").alias("block"))
    hot = meet(first, zones, ["first"], hot_keys(groups, ["first"]), ["node"]).select("node", (F.col("zone") - F.pmod(F.xxhash64("node"), "parts")).alias("block"), "zone", "parts")
    laid = cut(spark, cold.select("node", "block", F.col("block").alias("zone"), F.lit(1).alias("parts")).union(hot), "blocks")
    spots = own.join(laid.select("node", "zone", "parts"), "node").select("hub", F.col("zone").alias("away"), "parts").distinct()
    several = cut(spark, spots.join(spots.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1").select("hub"), "hub"), "spots")
    at = own.join(several.select("hub").distinct(), "hub", "left_semi").join(laid.drop("parts"), "node")
    far = meet(at, several, ["hub"], hot_keys(crowd.join(several, "hub", "left_semi"), ["hub"]), ["node"]).where("zone <> away").select("node", "block", "away", "parts").distinct()
    both = laid.withColumnRenamed("zone", "away").select(*far.columns).union(far)
    return both.select("node", "block", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.col("away") - k)).alias("other"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, threshold: float = 0.8, tolerance: float = 1e-9, with_row: bool = False) -> DataFrame:
    """doc_id, class_id (the least doc_id of all that links lead to) and n_links (documents at ``threshold`` or more) for every row.

    Equal texts are linked. A text without a word (null, empty) has no shingle and no link, and is its own class. Rows that
    repeat count each; a null id keeps its place and is never a class id unless a class has no other. An empty table
    gives no rows. A very long text is one set, in a task's memory of some twenty times its bytes. ``with_row`` adds the
    row's key, doc (null ids last) and tag (null or not, digest of the text), and its class's label (null for a text
    without a word): ids may be shared or missing, labels are not."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts(df, id_col, text_col).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), row_tag(F.col("doc_id"), F.col("text")).alias("tag"), "doc_id", "text")
    every = cut(spark, sketches(rows, words_each, threshold), "sketches")
    classes = every.where("size > 0").groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "tag", "size")).alias("one"))
    classes = cut(spark, classes.select(F.monotonically_increasing_id().alias("node"), "digest", "copies", "one.*"), "classes")
    firsts = every.where("size > 0").select("doc", "tag", "size", "first").join(classes.select("doc", "tag", "node"), ["doc", "tag"]).dropDuplicates(["doc", "tag"])
    found = buckets(firsts, threshold)
    hubs = cut(spark, found.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1"), "hubs")
    own = cut(spark, meet(found, hubs.select("bucket", "hub"), ["bucket"], hot_keys(hubs, ["bucket"]), ["node"]).select("node", "hub").distinct(), "own")
    meets = cells(own, classes.select("node", "size")).groupBy("node").agg(F.collect_list(F.struct("block", "other")).alias("meets"))
    held = classes.join(meets, "node").select("node", "copies", "doc", "tag", "meets")

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for b in in_slices(batches, "blob", 1 << 19):
            gram, start = shingle_sets(pa.array([expand(x) for x in b.column("blob").to_pylist()], pa.binary()).cast(pa.string()), words_each)
            data = gram.tobytes()
            grams = [data[8 * s : 8 * e] for s, e in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
            sketch = [v.tobytes() for v in min_hashes(gram, start)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], pa.array(sketch, pa.binary()), pa.array(grams, pa.binary())], names=[*kept, "sketch", "grams"])

    kept = ["node", "copies", "meets"]
    sets = shrunk(rows).join(held, ["doc", "tag"]).dropDuplicates(["doc", "tag"]).select("blob", *kept).mapInArrow(expanded, "node long, copies long, meets array<struct<block:long,other:long>>, sketch binary, grams binary")
    met = sets.select("node", "copies", "sketch", "grams", F.inline("meets")).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "block", "sketch", "grams")
    need = least_matches(threshold, tolerance)
    met = met.repartition(n, "i", "j").sortWithinPartitions("i", "j", "node")
    links = cut(spark, met.mapInArrow(lambda it: verify(it, threshold, need), "node long, links long, least long"), "links")
    totals = cut(spark, links.groupBy("node").agg(F.sum("links").alias("links"), F.collect_set("least").alias("ends")), "totals")
    # a class leads to the least of its ends, and so do its other ends, which are the same for most classes of a block
    joined = components(spark, totals.select(F.explode(F.array_append("ends", F.col("node"))).alias("a"), F.array_min("ends").alias("b")).where("b < a").distinct())
    groups = classes.select("node", "digest", "doc", "copies").join(joined, "node", "left").join(totals.select("node", "links"), "node", "left")
    groups = groups.select("digest", F.coalesce("label", "node").alias("label"), "doc", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    groups = cut(spark, groups, "groups")
    least = cut(spark, groups.groupBy("label").agg(F.min("doc").alias("class_id"), F.count("*").alias("n")), "least")
    named = meet(groups.drop("doc", "copies"), least.select("label", "class_id"), ["label"], hot_keys(least, ["label"]), ["digest"])
    full = meet(every.where("size > 0"), named, ["digest"], hot_keys(groups.select("digest", F.col("copies").alias("n")), ["digest"]), ["doc", "tag"])
    bare = every.where("size = 0").select("doc", "tag", F.lit(None).cast("long").alias("label"), F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    whole = full.select(*bare.columns).union(bare)
    ids = [F.when(F.col(c) < LAST, F.col(c)).alias(name) for c, name in (("doc", "doc_id"), ("class_id", "class_id"))]
    return whole.select(*ids, "n_links", *["doc", "tag", "label"] * with_row)
