"""Benchmark decontamination by the q-gram lemma.

A text that holds an item of m characters with at most k edits shares m + 1 - q (k + 1) character q-grams with it whose
places differ by nearly the same amount (the diagonal). Shared q-grams are counted in diagonal bands that overlap by half;
bands with enough of them are verified by a banded alignment of the whole item. An item too short for q takes the longest
grams that leave the lemma one: m // (k + 1) characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_blocks, in_slices, mix, odd_numbers, texts

FILTER_BITS = 22
PIECE = 1 << 20
#: Pairs of a text's and an item's gram counted at a time, and diagonals aligned at a time.
PAIRS, DIAGONALS = 1 << 20, 1 << 16


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points, every kind of white space as a blank."""
    low = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where((low <= 32) | (low == 0xA0), np.uint32(32), low)


def grams(points: np.ndarray, q: int) -> np.ndarray:
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = points.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for k, c in enumerate(odd_numbers(q, 3)):
        h += wide[k : k + n] * c
    return mix(h)


def budgets(length: np.ndarray, rate: float) -> np.ndarray:
    """The edits that an item of so many characters may have."""
    return (length * rate + 1e-9).astype(np.int64)


def by_gram(ids: list[int], items: list[str], q: int, rate: float) -> list[Items]:
    """One block of the benchmark, its items parted by the grams that they take."""
    points = [code_points(x) for x in items]
    length = np.array([len(p) for p in points], np.int64)
    own = np.minimum(q, length // (budgets(length, rate) + 1))
    return [Items([ids[i] for i in at], [points[i] for i in at], k, rate) for k in np.unique(own).tolist() for at in [np.flatnonzero(own == k).tolist()]]


class Items:
    """Items of one gram length: q-gram postings, edit budgets and bands."""

    def __init__(self, ids: list[int], points: list[np.ndarray], q: int, rate: float):
        self.ids, self.q = np.array(ids, np.int64), q
        self.points = points
        self.length = np.array([len(p) for p in self.points], np.int64)
        self.budget = budgets(self.length, rate)
        self.least = self.length + 1 - q * (self.budget + 1)
        self.half = 2 * self.budget + 1
        every = [grams(p, q) for p in self.points]
        gram = np.concatenate(every) if every else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(points)), [len(g) for g in every])
        place = np.concatenate([np.arange(len(g)) for g in every]) if every else np.zeros(0, np.int64)
        # An item's equal grams in a row are one run.
        new = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (item[1:] != item[:-1])]) if len(gram) else np.zeros(0, np.int64)
        gram, item, place, run = gram[new], item[new], place[new], np.diff(np.r_[new, len(gram)])
        order = np.argsort(gram, kind="stable")
        self.item, self.place, self.run = item[order], place[order], run[order]
        self.gram, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.gram >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of the best place of each item that ``points`` holds within its budget."""
        h = grams(points, self.q)
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(maybe):
            return []
        at = np.searchsorted(self.gram, h[maybe])
        at[at == len(self.gram)] = 0
        good = self.gram[at] == h[maybe]
        maybe, at = maybe[good], at[good]
        if not len(maybe):
            return []
        # So are the text's: a run of either kind is counted as a whole.
        new = np.flatnonzero(np.r_[True, (maybe[1:] != maybe[:-1] + 1) | (at[1:] != at[:-1])])
        length, maybe, at = np.diff(np.r_[new, len(maybe)]), maybe[new], at[new]
        cell, held = self.cells(maybe, length, at)
        next_to = np.r_[cell[1:] == cell[:-1] + 1, False]
        count = held + np.where(next_to, np.r_[held[1:], 0], 0)  # a band is two neighbouring cells, the first not empty
        key = cell[count >= self.least[cell >> 40]]
        best: dict[int, tuple[int, int, int, int]] = {}
        for i, low, high in self.stretches(key):
            if i in best and best[i][1] == 0:
                continue
            hit = banded(self.points[i], points, low, high, int(self.budget[i]))
            if hit and (i not in best or hit < best[i][1:]):
                best[i] = (i, *hit)
        return list(best.values())

    def cells(self, start: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells (item << 40 | half of a band) in which runs of the text, with the grams ``at``, meet an item's, and how many of its q-grams at most.

        Each place of an item counts once in a cell, wherever in the cell its gram occurs. Pairs are counted and summed up a bounded number at a time."""
        n = self.count[at]
        upto = np.cumsum(n)
        keys, counts = [], []
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, side="right")))
            k = n[begin:end]
            post = np.repeat(self.first[at[begin:end]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            i, z = np.repeat(start[begin:end], k), np.repeat(start[begin:end] + length[begin:end] - 1, k)
            for a in range(0, len(post), PAIRS):  # one run of the text may meet many runs
                self.count_in(post[a : a + PAIRS], i[a : a + PAIRS], z[a : a + PAIRS], keys, counts)
            begin = end
        key = np.concatenate(keys)
        key, where = np.unique(key, return_inverse=True)
        run = key >> 32
        count = np.minimum(np.bincount(where, np.concatenate(counts), minlength=len(key)).astype(np.int64), self.run[run])
        cell, where = np.unique(self.item[run] << 40 | key & 0xFFFFFFFF, return_inverse=True)
        return cell, np.bincount(where, count, minlength=len(cell)).astype(np.int64)

    def count_in(self, post: np.ndarray, i: np.ndarray, z: np.ndarray, keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
        """Adds the cells (run << 32 | half of a band) of pairs of a text's run, from place ``i`` to ``z``, and an item's run ``post``, and the places of the item that count in each."""
        item, p, m = self.item[post], self.place[post], self.run[post]
        size, half = self.length[item], self.half[item]
        first, last = (i - p - m + 1 + size) // half, (z - p + size) // half
        n = last - first + 1
        one = np.repeat(np.arange(len(post)), n)
        band = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        low = np.maximum(p[one], i[one] + size[one] - (band + 1) * half[one] + 1)
        high = np.minimum(p[one] + m[one] - 1, z[one] + size[one] - band * half[one])
        key, where = np.unique(post[one] << 32 | band, return_inverse=True)
        keys.append(key)
        counts.append(np.bincount(where, np.maximum(high - low + 1, 0), minlength=len(key)))

    def stretches(self, key: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, low, high): the diagonals of bands that follow each other, put together up to a bounded number."""
        out: list[tuple[int, int, int]] = []
        for k in key.tolist():
            i, b = k >> 40, k & (1 << 40) - 1
            half = int(self.half[i])
            low = b * half - int(self.length[i])
            high = low + 2 * half - 1
            if out and out[-1][0] == i and low <= out[-1][2] + 1 and high - out[-1][1] < DIAGONALS:
                out[-1] = (i, out[-1][1], high)
            else:
                out.append((i, low, high))
        return out


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the whole item's best alignment within the text whose diagonals lie near ``low`` to ``high``; None beyond the budget.

    Row i of the table holds, for each diagonal, the edits of the item's first i characters ending there. A start is free."""
    low, high = low - budget, high + budget
    width, m = high - low + 1, len(item)
    far = m + 1 + 2 * budget
    window = np.full(m + width, 0xFFFFFFFF, np.uint32)  # the characters from text[low] on; those outside match nothing
    a, z = max(0, low), min(len(text), low + m + width)
    if a >= z:
        return None
    window[a - low : z - low] = text[a:z]
    beyond = np.full(m + width, far, np.int32)  # no alignment goes before the text or past it
    beyond[a - low : min(m + width, len(text) + 1 - low)] = 0
    step = np.arange(width, dtype=np.int32)
    cost = beyond[:width].copy()
    start = step.copy()
    skip, moved = np.full(width, far, np.int32), np.zeros(width, np.int32)
    for i in range(m):
        match = cost + (window[i : i + width] != item[i])
        skip[:-1] = cost[1:] + 1  # the item's character is not in the text
        moved[:-1] = start[1:]
        begin = np.where(match <= skip, start, moved)
        slid = np.minimum(match, skip) + beyond[i + 1 : i + 1 + width] - step
        least = np.minimum.accumulate(slid)  # a text character that is not in the item: from the diagonal before, at a cost of 1
        source = np.maximum.accumulate(np.where(slid == least, step, 0))
        cost, start = least + step, begin[source]
        if i & 7 == 7 and cost.min() > budget:
            return None
    diagonals = np.arange(low, high + 1)
    start = start + low
    k = int(np.argmin(cost))
    return (int(cost[k]), int(start[k]), int(diagonals[k] + len(item))) if cost[k] <= budget else None


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = 8, rate: float = 0.1, block_chars: int = 2_000_000, with_tag: bool = False) -> DataFrame:
    """(doc_id, item_id, edits, start, end): the items that a row's whole text holds with at most ``rate`` x length edits, each at its best place (in characters).

    Case and kinds of white space are ignored. Items are looked for at any length; null ones, and those without a character
    that isn't white space, are held by nothing. Null and empty texts hold nothing; repeated rows and items each give their rows;
    of equally good places the first counts; an empty table on either side gives none. A very long text is read in overlapping
    pieces; one character over and over, in texts and items, is counted by runs. The benchmark is broadcast in blocks of ``block_chars`` characters and the items of one id;
    each block is held against all rows, and where there are several each one's result is written before the next. ``with_tag`` adds the
    digest of the row's text, since ids may be shared or missing."""
    if q < 1 or not 0 <= rate < 1:
        raise ValueError("q must be 1 or more, and rate from 0 to below 1")
    spark = df.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where(F.col("text").rlike("[^\\x00-\\x20\\xA0]"))
    blocks = in_blocks(items, F.length("text"), block_chars, "item_id")
    rows = texts(df, id_col, text_col)
    schema = "doc_id long, item_id long, edits int, start long, end long" + ", tag binary" * with_tag
    out = None
    for part in blocks:
        held = part.orderBy("item_id").collect()
        shared = spark.sparkContext.broadcast(([r["item_id"] for r in held], [r["text"] for r in held]))
        overlap = int(max(len(r["text"]) for r in held) * (1 + rate)) + 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, overlap=overlap) -> Iterator[pa.RecordBatch]:
            known = by_gram(*shared.value, q, rate)
            for b in in_slices(batches):
                found: list[tuple] = []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    points = code_points(text)
                    hits: dict[tuple[int, int], tuple] = {}
                    for at in range(0, max(1, len(points)), PIECE):
                        for k, items in enumerate(known):
                            for i, edits, start, end in items.find(points[at : at + PIECE + overlap]):
                                hits[k, i] = min(hits.get((k, i), (edits, start + at, end + at)), (edits, start + at, end + at))
                    tag = [hashlib.md5(text.encode()).digest()] * with_tag if hits else []
                    found += [(doc, int(known[k].ids[i]), *x, *tag) for (k, i), x in hits.items()]
                if found:
                    cols = list(zip(*found, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * with_tag]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "edits", "start", "end", *["tag"] * with_tag])

        found = rows.mapInArrow(run, schema)
        found = cut(spark, found, "found") if len(blocks) > 1 else found
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)
