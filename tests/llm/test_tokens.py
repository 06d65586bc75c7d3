"""Both encoders against the public libraries, and round trips."""

import hashlib
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from borelog.llm import bpe, queries, tokens

from .helpers import ODD, documents, frame

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = "abc \n\t  'sé漢😀1239.,!?$$ aaa the \x1c\x85\xa0 <|endoftext|>"


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice([ALPHABET, "ab c\n", "ab "])) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["\n", " a", "a ", "", "a\n", "aaaaaaaaaaaaaaaa"]


@pytest.fixture(scope="module")
def tik():
    v = bpe.Vocabulary.load(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


@pytest.fixture(scope="module")
def hf():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_prefix_tables_against_tiktoken(tik):
    e = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    xs = texts(4000)
    for x, ids in zip(xs, bpe.encode_slice(pa.array(xs), bpe.Parts(50_000), e.fresh), strict=True):
        assert ids == e.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(x)
        assert e.decode(ids) == x.encode()


def test_append_and_cut_are_exact():
    v = bpe.encoder(RANKS, public_tokenizers.PATTERN).vocabulary
    rng = random.Random(2)
    for _ in range(200):
        data = "".join(rng.choice("abcdetion") for _ in range(30)).encode()
        at = rng.randint(0, 30)
        t = bpe.PrefixTable(v, data[:at])
        assert t.append(data[at:]).last == bpe.PrefixTable(v, data).last
        assert t.cut(at).tokens() == bpe.PrefixTable(v, data[:at]).tokens()


def test_edits_near_by(tik):
    e = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(4)
    for x in texts(600, 5):
        a, z = sorted((rng.randint(0, len(x)), rng.randint(0, len(x))))
        changed, ids = e.reencode(x, tik.encode_ordinary(x), a, z, "ab c")
        assert changed == x[:a] + "ab c" + x[z:] and ids == tik.encode_ordinary(changed)


def test_op8_over_the_table(spark, sf_dir, tik):
    found = {r["doc_id"]: r for r in queries.op8_prefix_bpe(spark, sf_dir).collect()}
    docs = documents(spark, sf_dir)
    assert len(found) == len(docs)
    for doc, text in docs:
        ids = np.array(tik.encode_ordinary(text), "<u4").tobytes()
        assert (found[doc]["n_tokens"], found[doc]["ids_sha256"], found[doc]["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_encode_and_decode_with_odd_rows(spark):
    docs = [*ODD, (1, "twice"), (1, "twice")]
    out = bpe.encode(frame(spark, docs), RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(out, RANKS).collect()
    assert sorted((str(r["doc_id"]), bytes(r["data"])) for r in back) == sorted((str(d), (t or "").encode()) for d, t in docs)
    assert bpe.encode(frame(spark, ODD).limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_slices_against_the_library(hf):
    xs = texts(6000, 7)
    fresh, _, whole = tokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    xs += ["<|endoftext|>", "a <|endoftext|> b", "\n <|endoftext|>\n\n<|endoftext|>x", "a<|endof text|>", "<|endof", "text|>"]
    found = whole(pa.array(xs), bpe.encode_slice(pa.array(xs), bpe.Parts(50_000), fresh))
    assert 50256 in np.frombuffer(found[-5], "<u4")
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [e.ids for e in hf.encode_batch(xs, add_special_tokens=False)]


def test_many_new_parts_take_little_memory():
    """A worker's peak over 200,000 new parts, in a process of its own; all in one call of the library took 353 MB."""
    code = """if True:
        import resource, sys
        import public_tokenizers
        from borelog.llm import tokens
        fresh, _, _ = tokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
        parts = [f" {i:x}" for i in range(10**6, 10**6 + 200_000)]
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        found = fresh(parts, True)
        grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
        assert all(found[k : k + 1] == fresh(parts[k : k + 1]) for k in (0, 16_383, 16_384, 199_999))
        print(len(found), grown // 1024)
    """
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split()
    assert int(out[0]) == 200_000 and int(out[1]) < 110


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    import zstandard

    c, d = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
    for n in (0, 1, 7, 8, 1000, 1025):
        ids = np.random.default_rng(n).integers(0, 50257, n).astype("<u4")
        planes, data = tokens.to_planes(ids, kind, 512, c)
        assert (tokens.from_planes(data, planes, kind, 512, n, d) == ids).all()


def test_op2_over_the_table(spark, sf_dir, hf):
    found = {r["doc_id"]: r for r in queries.op2_bit_planes(spark, sf_dir).collect()}
    start = 0
    for doc, text in sorted(documents(spark, sf_dir)):
        ids = [*hf.encode(text, add_special_tokens=False).ids, 0]
        assert (found[doc]["start"], found[doc]["n_tokens"], found[doc]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_with_small_chunks_and_odd_rows(spark, tmp_path, hf):
    docs = [(i, t) for i, t in enumerate(texts(300, 9))] + ODD + [(5, "again")]
    for kind in ("bit", "byte"):
        path = str(tmp_path / kind)
        tokens.write(frame(spark, docs), path, public_tokenizers.path("byte_bpe_50k.json"), kind=kind, block=64, chunk_ids=200, partitions=3)
        rows = tokens.read(spark, path, with_ids=True).orderBy("start").collect()
        assert len(rows) == len(docs)
        assert [r["doc_id"] for r in rows] == sorted((d for d, _ in docs), key=lambda d: -1 if d is None else d)
        wanted = sorted((str(d), [*hf.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in docs)
        assert sorted((str(r["doc_id"]), list(r["ids"])) for r in rows) == wanted
        at = 0
        for r in rows:
            assert r["start"] == at
            at += r["n_tokens"]


def test_very_long_texts(spark, tmp_path, tik, hf):
    words = [w for t in texts(400, 13) for w in t.split(" ")]
    rng = random.Random(14)
    docs = [(1, " ".join(rng.choice(words) for _ in range(400_000))), (2, "x" * 300_000), (3, "\n" * 50_000), (4, "short")]
    found = {r["doc_id"]: r["ids_sha256"] for r in bpe.encode(frame(spark, docs), RANKS, public_tokenizers.PATTERN).collect()}
    assert found == {d: hashlib.sha256(np.array(tik.encode_ordinary(t), "<u4").tobytes()).hexdigest() for d, t in docs if d != 2} | {2: found[2]}
    tokens.write(frame(spark, docs), str(tmp_path / "long"), public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r["doc_id"]: r["ids_crc32"] for r in tokens.read(spark, str(tmp_path / "long")).collect()}
    assert rows == {d: zlib.crc32(np.array([*hf.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for d, t in docs}


def test_empty_table(spark, tmp_path):
    tokens.write(frame(spark, ODD).limit(0), str(tmp_path / "e"), public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.read(spark, str(tmp_path / "e")).collect() == []


def test_unbroken_texts_leave_a_bounded_cache(tik):
    """More text without a blank than the cache may hold, each part another one; exact, and nothing of it stays."""
    import base64
    import time

    e = bpe.Encoder(bpe.Vocabulary.load(RANKS), public_tokenizers.PATTERN)
    e.known = bpe.Parts(100_000)
    rng = random.Random(21)
    began, size = time.process_time(), 0
    for _ in range(8):
        xs = [base64.b64encode(rng.randbytes(30_000)).decode().replace("/", "x") for _ in range(2)] + [f"{rng.random()}" for _ in range(600)]
        size += sum(map(len, xs))
        for x, ids in zip(xs, bpe.encode_slice(pa.array(xs), e.known, e.fresh), strict=True):
            if len(x) < 100:
                assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(x)
            assert e.decode(ids) == x.encode()
        kept = sum(len(a) + len(b) + bpe.ENTRY_BYTES for a, b in e.known.known.items())
        assert kept == e.known.held <= 100_000 + bpe.ENTRY_BYTES + 5 * bpe.LONGEST_KEPT
        assert max(map(len, e.known.known)) <= bpe.LONGEST_KEPT
    print(f"{(time.process_time() - began) / size * 1e6:.1f} s a MB of text without blanks")
