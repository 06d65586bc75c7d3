"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece of text has one valid last token: the last token of the prefix's own encoding. It is stored
for each prefix, so an append extends the table, a cut shortens it, and an edit redoes only the pieces near it. A token
may follow another if no merge across their border comes before the merges that formed the two; that test needs the
right edge of the first and the left edge of the second token only.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, in_slices, span_hash, texts

FOREVER = 1 << 60
#: A border that no pre-tokenizer pattern of this family crosses: a single blank between two characters that are not white space.
BLANKS = re.compile(r"\s\s")
BETWEEN = re.compile(r"(?<=\S)(?= \S)")
#: Bytes that a worker's cache of parts may take, the longest part that it keeps, and what an entry takes besides its bytes.
CACHE_BYTES, LONGEST_KEPT, ENTRY_BYTES = 64 << 20, 64, 200
#: Pairs of tokens whose border test is remembered.
BORDERS = 300_000


class Parts:
    """Encoded parts, at most ``limit`` bytes of them whatever the texts are: long parts are never kept and a full cache starts anew."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.known: dict[str, bytes] = {}
        self.get, self.limit, self.held = self.known.get, limit, 0

    def add(self, part: str, ids: bytes) -> None:
        if len(part) > LONGEST_KEPT:
            return
        if self.held > self.limit:
            self.known.clear()
            self.held = 0
        self.known[part] = ids
        self.held += ENTRY_BYTES + len(part) + len(ids)


class Vocabulary:
    """Token bytes and ranks, with the edges that the border test needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.fits: dict[int, bool] = {}
        self._edges: dict[int, tuple] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with Path(path).open("rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    @functools.cached_property
    def suffixes(self):
        """An automaton over bytes that names every token ending at each place."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for data, token in self.ranks.items():
            found.add_word(data.decode("latin-1"), (len(data), token))
        found.make_automaton()
        return found

    def rank(self, first: bytes, second: bytes) -> int | None:
        """The rank at which two neighbours merge; None: never."""
        return self.ranks.get(first + second)

    def merged(self, piece: bytes) -> list[bytes]:
        """Plain merging by rank, lowest and leftmost first. Only used on the bytes of single tokens, to find how each is formed."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            ranks = [self.rank(*pair) for pair in itertools.pairwise(parts)]
            rank, i = min((FOREVER if r is None else r, i) for i, r in enumerate(ranks))
            if rank == FOREVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edges(self, token: int) -> tuple[list, list] | None:
        """The tokens on the left and on the right edge while ``token`` forms, each with the rank at which it is merged away; None: merging never yields the token."""
        if token not in self._edges:
            data = self.bytes_of[token]
            left, right = [(data, FOREVER)], [(data, FOREVER)]
            parts = self.merged(data)
            gone = self.rank(*parts) if len(parts) == 2 else None
            if len(parts) > 2 or len(parts) == 2 and gone is None:
                self._edges[token] = None
                return None
            if len(parts) == 2:
                for side, part, pick in ((left, parts[0], 0), (right, parts[1], 1)):
                    side.append((part, gone))
                    inner = self.edges(self.ranks[part])
                    side += [(b, r) for b, r in (inner[pick] if inner else [])[1:]]
            self._edges[token] = (left, right)
        return self._edges[token]

    def may_follow(self, first: int, second: int) -> bool:
        key = first << 32 | second
        known = self.fits.get(key)
        if known is None:
            a, b = self.edges(first), self.edges(second)
            known = a is not None and b is not None
            if known:
                for x, x_gone in a[1]:
                    for y, y_gone in b[0]:
                        rank = self.rank(x, y)
                        if rank is not None and rank < x_gone and rank <= y_gone:
                            known = False
                            break
                    if not known:
                        break
            if len(self.fits) > BORDERS:
                self.fits.clear()
            self.fits[key] = known
        return known


class PrefixTable:
    """The encoding of one growing piece: ``last[i]`` is the last token of the encoding of its first i bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        """Exact: no stored entry changes. Of the tokens that end at a place just one may follow what stands before it."""
        v, start = self.vocabulary, len(self.data)
        self.data += more
        last, fits, back = self.last, v.fits.get, max(0, start - v.longest)
        last.extend([-1] * len(more))
        for end, (size, token) in v.suffixes.iter(self.data[back:].decode("latin-1")):
            end += back + 1
            if end <= start or last[end] >= 0:
                continue
            if end > size:
                before = last[end - size]
                ok = fits(before << 32 | token)
                if ok is None:
                    ok = v.may_follow(before, token)
            else:
                ok = v.edges(token) is not None
            if ok:
                last[end] = token
        if -1 in last[start + 1 :]:
            raise ValueError("a byte is missing from the vocabulary")
        return self

    def cut(self, length: int) -> PrefixTable:
        self.data = self.data[:length]
        del self.last[length + 1 :]
        return self

    def tokens(self) -> list[int]:
        out, end, size = [], len(self.data), self.vocabulary.bytes_of
        while end:
            out.append(self.last[end])
            end -= len(size[self.last[end]])
        return out[::-1]


class Encoder:
    """Texts to ids: the pattern's matches separately, each by its prefix table; a match that is a token by itself is that token."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.known = Parts()

    def match(self, text: str) -> bytes:
        data = text.encode("utf-8", "replace")
        token = self.vocabulary.ranks.get(data)
        ids = [token] if token is not None else PrefixTable(self.vocabulary, data).tokens()
        return struct.pack(f"<{len(ids)}I", *ids)

    def part(self, text: str) -> bytes:
        return b"".join([self.match(m) for m in self.find(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return encode_parts(text, self.known, self.fresh)

    def fresh(self, parts: list[str], simple: bool = False) -> list[bytes]:
        return [self.part(x) for x in parts]

    def reencode(self, text: str, ids: list[int], start: int, end: int, new: str) -> tuple[str, list[int]]:
        """The text with ``text[start:end]`` replaced by ``new``, and its ids; only the part between the safe borders around the edit is encoded again."""
        left = max((m.start() for m in BETWEEN.finditer(text, 0, max(start - 1, 0))), default=0)
        right = next((m.start() for m in BETWEEN.finditer(text, end + 1)), len(text))
        head, tail = len(text[:left].encode()), len(text[right:].encode())
        size, i, j = self.vocabulary.bytes_of, 0, len(ids)
        while head:
            head, i = head - len(size[ids[i]]), i + 1
        while tail:
            tail, j = tail - len(size[ids[j - 1]]), j - 1
        middle = text[left:start] + new + text[end:right]
        changed = text[:left] + middle + text[right:]
        return changed, [*ids[:i], *np.frombuffer(self.encode(middle), "<u4").tolist(), *ids[j:]]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_parts(text: str, known: Parts, fresh) -> bytes:
    """The ids of a text from those of its parts between safe borders. ``fresh`` encodes a list of new parts."""
    if BLANKS.search(text):
        parts = BETWEEN.split(text)
    else:
        lines = text.split("\n")
        head, *rest = lines[0].split(" ")
        parts = [head, *[" " + x for x in rest]]
        for line in lines[1:]:
            head, *rest = line.split(" ")
            parts += ["\n", head]
            parts += [" " + x for x in rest]
    ids = {x: known.get(x) for x in parts}
    new = [x for x, found in ids.items() if found is None]
    if new:
        for x, made in zip(new, fresh(new), strict=True):
            ids[x] = made
            known.add(x, made)
    return b"".join(map(ids.__getitem__, parts))


def encode_slice(strings: pa.Array, known: Parts, fresh) -> list[bytes]:
    """The ids of each text. Texts are cut at safe borders for all at once, each distinct part is encoded once and its ids
    are put in all its places; a text with two white-space characters in a row, or a rare one, goes the careful way."""
    raw, offsets = as_bytes(strings)
    n = len(raw)
    out = [b""] * len(strings)
    if not n:
        return out
    blank = (raw == 32) | (raw == 10)
    rare = (raw < 32) & (raw != 10) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3)
    rare[1:] |= (raw[:-1] == 0xC2) & ((raw[1:] == 0x85) | (raw[1:] == 0xA0)) | blank[1:] & blank[:-1]
    careful = np.zeros(len(strings), bool)
    careful[np.searchsorted(offsets, np.flatnonzero(rare), side="right") - 1] = True
    border = np.zeros(n + 1, bool)
    border[:n] = blank
    border[1:] |= raw == 10
    letter = (raw | 32) - 97 < 26  # a mark after a letter of ASCII begins a match of its own
    border[1:n] |= letter[:-1] & ((raw[1:] == 44) | (raw[1:] == 46))
    border[offsets] = True
    start = np.flatnonzero(border[:n])
    end = np.r_[start[1:], n]
    size = end - start
    of, distinct = pd.factorize(span_hash(raw, start, end))
    first = np.zeros(len(distinct), np.int64)
    first[of[::-1]] = np.arange(len(of) - 1, -1, -1)
    one = first[of]  # each part's first occurrence, held against it byte by byte: two parts may have one hash
    if (size[one] != size).any() or (raw[np.repeat(start[one] - start, size) + np.arange(n)] != raw).any():
        careful[:] = True
    data = raw.tobytes()
    parts = [data[a:z].decode() for a, z in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    ids = list(map(known.get, parts))
    at = [i for i, x in enumerate(ids) if x is None]
    new = [parts[i] for i in at]
    for i, p, x in zip(at, new, fresh(new, not careful.any()), strict=True):
        ids[i] = x
        known.add(p, x)
    length = np.array([len(x) // 4 for x in ids], np.int64)
    place = np.cumsum(length) - length
    count = length[of]
    ends = np.cumsum(count)
    every = np.frombuffer(b"".join(ids), "<u4")[np.repeat(place[of] - (ends - count), count) + np.arange(ends[-1])]
    bounds = np.r_[0, ends][np.searchsorted(start, offsets)] * 4
    raw_ids = every.tobytes()
    for i, (a, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        out[i] = encode_parts(strings[i].as_py(), known, fresh) if careful[i] else raw_ids[a:z]
    return out


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(Vocabulary.load(path), pattern)


def encode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (if ``with_ids``), ids_sha256 and decoded_sha256 of every row's whole text.

    A null text counts as empty (no ids, the digest of no bytes); repeated doc_ids and rows stay, one result each; other
    columns are ignored; an empty table gives no rows. A very long text is encoded whole, in a task's memory of some tens of
    times its bytes, broken by blanks or not; what stays in the worker between texts is bounded in bytes. Each row is handled where it was read: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, pattern)
        for b in in_slices(batches):
            ids = encode_slice(b.column("text"), e.known, e.fresh)
            out = [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64())]
            out += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))] if with_ids else []
            out += [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(e.decode(x)).hexdigest() for x in ids])]
            names = ["doc_id", "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"doc_id long, n_tokens long, {'ids array<int>, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string"
    return texts(df, id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded bytes of arrays of ids; a null array gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(vocabulary, ".").vocabulary.bytes_of
        for b in batches:
            data = [None if x is None else b"".join(map(table.__getitem__, x)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary")
