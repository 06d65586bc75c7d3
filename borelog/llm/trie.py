"""Byte-level BPE over a trie of words, for files of the tokenizers library.

The words of a slice of texts (matches of the pre-tokenizer) are inserted into a trie. A depth-first walk carries the last
token of every byte prefix, so a prefix that many words share is encoded once: going down an edge extends the states, going
back up drops them. Words with a state of their own end in it; their ids are read back along the last tokens. Merges are
ranked by pair, as the library's model has them.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import Parts, PrefixTable, Vocabulary, encode_parts, encode_slice
from .common import as_bytes, in_slices, texts

#: Fixed value: the word pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def byte_of() -> dict[str, int]:
    """The character that stands for each byte in such vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def raw(token: str) -> bytes:
    """The bytes of a token's text; one with any other character stands for its own UTF-8 bytes, as when the library decodes."""
    known = byte_of()
    return bytes(known[c] for c in token) if all(c in known for c in token) else token.encode()


class Merges(Vocabulary):
    """Tokens, and the rank of each pair that merges."""

    def __init__(self, tokens: dict[bytes, int], pairs: dict[tuple[bytes, bytes], int], added: dict[str, int]):
        super().__init__(tokens)
        self.pairs, self.added = pairs, added
        self.bytes_of.update({i: raw(text) for text, i in added.items()})

    @classmethod
    def load(cls, path: str) -> Merges:
        """Reads a file of the library; what this encoder does not do (normalizers, unknown tokens, dropout …) is an error."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        if any(a[k] for a in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that take in what stands around them")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls({raw(t): i for t, i in model["vocab"].items()}, {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}, added)

    def rank(self, first: bytes, second: bytes) -> int | None:
        return self.pairs.get((first, second))


class Trie:
    """Words below edges labelled with bytes; an edge holds as many bytes as no other word parts from."""

    def __init__(self, words: Iterable[bytes] = ()):
        self.root: list = [b"", {}, False]  # the label above, the nodes below by first byte, whether a word ends here
        for word in words:
            self.insert(word)

    def insert(self, word: bytes) -> None:
        node, at = self.root, 0
        while at < len(word):
            below = node[1].get(word[at])
            if below is None:
                node[1][word[at]] = [word[at:], {}, True]
                return
            label = below[0]
            if not word.startswith(label, at):
                same = 1
                while at + same < len(word) and same < len(label) and label[same] == word[at + same]:
                    same += 1
                middle = [label[:same], {label[same]: below}, False]
                below[0] = label[same:]
                node[1][word[at]] = below = middle
                label = label[:same]
            node, at = below, at + len(label)
        node[2] = True

    def encodings(self, vocabulary: Vocabulary) -> Iterator[tuple[bytes, list[int]]]:
        """Every word and its ids, by one depth-first walk."""
        states = PrefixTable(vocabulary)
        todo = [(self.root, 0)]
        while todo:
            (label, below, word), depth = todo.pop()
            states.cut(depth).append(label)
            if word:
                yield states.data, states.tokens()
            depth += len(label)
            todo += [(node, depth) for node in below.values()]


class Spelling:
    """A string of bytes for each id, laid end to end."""

    def __init__(self, spelled: dict[int, bytes]):
        strings = [spelled.get(i, b"") for i in range(max(spelled, default=-1) + 1)]
        self.strings = pa.array(strings, pa.large_binary())

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[memoryview]:
        """The strings of the ids between one end and the next, joined."""
        data, at = as_bytes(self.strings.take(pa.array(ids)))
        data, at = data.data, at[ends].tolist()
        return (data[a:z] for a, z in itertools.pairwise(at))


class Encoder:
    def __init__(self, merges: Merges):
        import regex

        self.merges, self.known, self.find = merges, Parts(), regex.compile(PATTERN).findall
        self.special = re.compile("|".join(re.escape(t) for t in sorted(merges.added, key=len, reverse=True))) if merges.added else None
        self.decimals, self.decoded = Spelling({i: b"%d," % i for i in merges.bytes_of}), Spelling(merges.bytes_of)

    def fresh(self, parts: list[str], simple: bool = False) -> list[bytes]:
        """The ids of each part (little-endian unsigned 32-bit), from one trie of all their words."""
        words = [[w.encode("utf-8", "replace") for w in self.find(p)] for p in parts]
        trie = Trie({w for ws in words for w in ws})
        ids = {word: np.array(found, "<u4").tobytes() for word, found in trie.encodings(self.merges)}
        return [b"".join(map(ids.__getitem__, ws)) for ws in words]

    def encode(self, text: str) -> bytes:
        """One text, its added tokens set apart before all else."""
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += [encode_parts(text[at : m.start()], self.known, self.fresh), np.array([self.merges.added[m.group()]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, encode_parts(text[at:], self.known, self.fresh)])

    def encode_all(self, strings: pa.Array) -> list[bytes]:
        ids = encode_slice(strings, self.known, self.fresh)
        if self.special:
            held = pc.fill_null(pc.match_substring_regex(strings, "|".join(re.escape(t) for t in self.merges.added)), False)
            for i in np.flatnonzero(held.to_numpy(zero_copy_only=False)).tolist():
                ids[i] = self.encode(strings[i].as_py())
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the decoded text; ids without a token are passed over, broken characters become U+FFFD."""
        data = b"".join([self.merges.bytes_of.get(i, b"") for i in ids])
        return data.decode("utf-8", "replace").encode()


@functools.cache
def encoder(path: str, changed: float) -> Encoder:
    """One for each Python worker and state of the file."""
    return Encoder(Merges.load(path))


def loaded(path: str) -> Encoder:
    return encoder(path, os.path.getmtime(path))


def encode(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (if ``with_ids``), ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 of every row's whole text.

    A null text counts as empty (no ids, the digest of no bytes); repeated doc_ids and rows stay, one result each; a null
    doc_id stays null; other columns are ignored, whatever their names; an empty table gives no rows. The string of an added
    token is that token. A very long text is encoded whole, in a task's memory of some tens of times its bytes; the trie
    holds the new words of one slice of texts, and what stays in the worker between slices is bounded in bytes. Each row is
    handled where it was read: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = loaded(tokenizer_file)
        digest = hashlib.sha256
        for b in in_slices(batches):
            ids = e.encode_all(b.column("text"))
            ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
            every = np.frombuffer(b"".join(ids), "<u4")
            out = [b.column("doc_id"), pa.array(np.diff(ends))]
            out += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(every.astype(np.int32)))] if with_ids else []
            # a decimal ends in a comma, the last one of a text's goes
            out.append(pa.array([digest(x[:-1]).hexdigest() for x in e.decimals.texts(every, ends)]))
            out.append(pa.array([digest(str(x, "utf-8", "replace").encode()).hexdigest() for x in e.decoded.texts(every, ends)]))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"])

    schema = f"doc_id long, n_tokens long, {'ids array<int>, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string"
    return texts(df, id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of arrays of ids, special tokens included; a null array gives null, an id without a token nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = loaded(tokenizer_file)
        for b in batches:
            data = [None if x is None else e.decode(x).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.string())], names=["doc_id", "text"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
