"""The trie encoder against the public library, word by word and over the table."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from borelog.llm import bpe, queries, trie

from .helpers import ODD, documents, frame
from .test_tokens import texts

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def hf():
    return Tokenizer.from_file(FILE)


def test_a_trie_holds_each_word_once_below_shared_prefixes():
    rng = random.Random(1)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 12))).encode() for _ in range(400)} | {b"a", b"ab", b"abc"}
    tree = trie.Trie(sorted(words, key=lambda w: rng.random()))
    found, edges, todo = set(), 0, [(tree.root, b"")]
    while todo:
        (label, below, word), above = todo.pop()
        at = above + label
        edges += 1
        assert all(node[0][0] == first for first, node in below.items())
        assert word or len(below) != 1 or not above
        if word:
            found.add(at)
        todo += [(node, at) for node in below.values()]
    assert found == words and edges <= 2 * len(words)


def test_words_against_the_library(hf):
    merges = trie.Merges.load(FILE)
    rng = random.Random(2)
    words = {"".join(rng.choice("abcdetionñó") for _ in range(rng.randint(1, 24))) for _ in range(4000)}
    found = dict(trie.Trie(w.encode() for w in words).encodings(merges))
    assert len(found) == len(words)
    for w in words:
        assert found[w.encode()] == hf.encode(w, add_special_tokens=False).ids


def test_shared_prefixes_are_walked_once():
    """The states of a prefix that many words share are made once: the walk appends as many bytes as the trie has."""
    merges, appended = trie.Merges.load(FILE), []

    class Counted(bpe.PrefixTable):
        def append(self, more):
            appended.append(len(more))
            return super().append(more)

    plain, trie.PrefixTable = trie.PrefixTable, Counted
    try:
        words = [b"prefix" * 20 + str(i).encode() for i in range(100)]
        assert len(dict(trie.Trie(words).encodings(merges))) == 100
    finally:
        trie.PrefixTable = plain
    assert sum(appended) < 120 + 3 * 100


def test_slices_and_single_texts_against_the_library(hf):
    e = trie.Encoder(trie.Merges.load(FILE))
    e.known = bpe.Parts(50_000)
    xs = texts(6000, 17) + ["<|endoftext|>", "a <|endoftext|> b", "\n <|endoftext|>\n\n<|endoftext|>x", "a<|endof text|>", "<|endof", "it's we'll 'é '' 12³ ½ á ​　x"]
    for x, ids, whole in zip(xs, e.encode_all(pa.array(xs)), hf.encode_batch(xs, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.ids, repr(x)
        assert e.encode(x) == ids
        assert e.decode(whole.ids).decode() == hf.decode(whole.ids, skip_special_tokens=False)
    rng = random.Random(3)
    for _ in range(500):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 6))]
        assert e.decode(ids).decode() == hf.decode(ids, skip_special_tokens=False)


def test_ids_are_spelled_all_at_once():
    """Texts without ids, ids without a string, and strings that hold any bytes; ids in between have none."""
    s = trie.Spelling({0: b"a", 2: b"\xff,", 5: b"", 7: "é".encode()})
    lists = [[], [0, 2, 2, 7], [5], [3, 0], [], [7] * 5000, []]
    ends = np.cumsum([0, *map(len, lists)])
    found = [bytes(x) for x in s.texts(np.array([i for x in lists for i in x], "<u4"), ends)]
    assert found == [b"", b"a\xff,\xff," + "é".encode(), b"", b"a", b"", "é".encode() * 5000, b""]
    assert [bytes(x) for x in s.texts(np.zeros(0, "<u4"), np.zeros(3, np.int64))] == [b"", b""]


def test_op12_over_the_table(spark, sf_dir, hf):
    found = {r["doc_id"]: r for r in queries.op12_trie_bpe(spark, sf_dir).collect()}
    docs = documents(spark, sf_dir)
    assert len(found) == len(docs)
    for doc, text in docs:
        ids = hf.encode(text or "", add_special_tokens=False).ids
        wanted = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(hf.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (found[doc]["n_tokens"], found[doc]["ids_sha256"], found[doc]["decoded_sha256"]) == wanted


def test_odd_rows_long_texts_and_round_trips(spark, hf):
    long = " ".join(f"w{i % 997}x{i}" for i in range(120_000))
    docs = [*ODD, (1, "twice"), (1, "twice"), (2, long), (3, "\n" * 20_000), (4, "漢字" * 5_000), (5, "x <|endoftext|>y")]
    out = trie.encode(frame(spark, docs).withColumnRenamed("n", "ids"), FILE)
    rows = out.collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows if r["doc_id"] in (9001, 9002)] == [(0, nothing, nothing)] * 2
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in rows) == sorted((str(d), hf.encode(t or "", add_special_tokens=False).ids) for d, t in docs)
    back = trie.decode(out, FILE).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(d), t or "") for d, t in docs)
    assert trie.encode(frame(spark, ODD).limit(0), FILE).collect() == []


def test_files_of_other_kinds_are_refused(tmp_path):
    with pytest.raises(ValueError, match="plain byte-level"):
        trie.Merges.load(public_tokenizers.path("word_bpe_49k.json"))
