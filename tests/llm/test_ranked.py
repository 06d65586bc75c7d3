"""Ranked search against a plain scan in Python integers, and against SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from borelog.llm import common, queries, ranked

from .helpers import ODD, duck_rows, frame

TERM = re.compile(ranked.TERM)


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    held = [(d, Counter(t), len(t)) for d, t in ((d, terms(x)) for d, x in docs) if t]
    n, total = len(held), sum(length for *_, length in held)
    df = Counter(t for _, c, _ in held for t in c)
    query = {}
    for item, text in items:
        query.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, asked in query.items():
        scores = []
        for doc, c, length in held:
            m = 100 - 25 + 25 * length * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r, None if null else doc, -score) for r, (score, null, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


def test_numbers_of_any_length_round_trip():
    rng = np.random.default_rng(1)
    values = np.concatenate([np.array([0, 1, 127, 128, 16_383, 16_384, 2**63, 2**64 - 1], np.uint64), rng.integers(0, 300, 500).astype(np.uint64), rng.integers(0, 2**62, 500).astype(np.uint64)])
    data, bounds = ranked.packed(values, np.array([0, 3, len(values)]))
    assert (ranked.unpacked(data.tobytes()) == values).all()
    assert (ranked.unpacked(data[bounds[0] : bounds[1]].tobytes()) == values[:3]).all() and bounds[2] == len(data)


def made(seed, n):
    rng = random.Random(seed)
    words = ["Ab", "aB", "x", "né", "漢字", "7", "q9", *[f"w{int(rng.paretovariate(0.7))}" for _ in range(60)]]
    docs = [(rng.choice([i, i, i, i // 3, -i, None]), rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(n)]
    return docs + [(1, "same text here"), (1, "same text here"), (2, "same text here")], [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)]


@pytest.mark.parametrize(("seed", "shard_bytes", "window", "chars", "k"), [(1, 200, 4, 60, 3), (2, 4 << 20, 512, 2_000_000, 20), (3, 1, 1, 1, 5), (4, 900, 2, 10_000, 50)])
def test_shards_windows_and_blocks_of_any_size(spark, tmp_path, seed, shard_bytes, window, chars, k):
    docs, items = made(seed, 150)
    docs += ODD
    items += [(100, None), (101, ""), (102, "-- !"), (103, "nowhere"), (3, "x x twice"), (104, "same same text")]
    path = str(tmp_path / "index")
    ranked.build(frame(spark, docs).repartition(3), path, shard_bytes=shard_bytes)
    asked = frame(spark, items).withColumnsRenamed({"doc_id": "item_id"}).withColumns({"term": F.lit(0), "words": F.lit("x"), "item": F.lit(1)})
    found = rows(ranked.search(spark, path, asked, k=k, window=window, block_chars=chars))
    assert found == plain(docs, items, k)


def test_terms_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(common, "span_hash", lambda raw, start, end: np.ones(len(start), np.uint64))
    raw, offsets = common.as_bytes(pa.array(["a b a", "b cc"]))
    of, doc, start, end = ranked.terms(raw.copy(), offsets)
    assert of.tolist() == [0, 1, 0, 1, 2] and doc.tolist() == [0, 0, 0, 1, 1]


def test_very_long_texts_and_empty_tables(spark, tmp_path):
    docs = [(1, "x" * 300_000), (2, " ".join(f"t{i % 4999}" for i in range(200_000))), (3, "t1 t2"), (4, "")]
    items = [(0, "t1 t2 T3"), (1, "x" * 300_000), (2, " ".join(f"t{i}" for i in range(9000)))]
    ranked.build(frame(spark, docs), str(tmp_path / "long"))
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows(ranked.search(spark, str(tmp_path / "long"), asked)) == plain(docs, items)
    assert ranked.search(spark, str(tmp_path / "long"), asked.limit(0)).collect() == []
    ranked.build(frame(spark, docs).limit(0), str(tmp_path / "none"))
    assert ranked.search(spark, str(tmp_path / "none"), asked).collect() == []


def test_op13_against_sql_and_the_plain_scan(spark, sf_dir):
    found = rows(queries.op13_ranked(spark, sf_dir))
    assert found == duck_rows(ranked.SQL, sf_dir, ["documents", "benchmark"], ["item_id", "rank", "doc_id", "score"])
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert found == plain(docs, items)


def test_blocks_are_bounded_and_whole(spark):
    df = spark.createDataFrame([(i // 2 if i % 7 else None, "x" * (i % 13)) for i in range(200)], "k long, t string").where("t <> ''")
    blocks = common.in_blocks(df, F.length("t"), 60, "k")
    got = [[tuple(r) for r in b.collect()] for b in blocks]
    assert sorted(map(repr, sum(got, []))) == sorted(map(repr, map(tuple, df.collect())))
    seen = [k for b in got for k in {k for k, _ in b}]
    assert len(seen) == len(set(seen))
    biggest = max(sum(len(t) for k2, t in sum(got, []) if k2 == k) for k in set(seen))
    assert max(sum(len(t) for _, t in b) for b in got) <= 60 + biggest
