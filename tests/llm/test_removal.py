"""Suffix and chunk removal against brute force."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from borelog.llm import chunks, common, queries, suffixes

from .helpers import ODD, documents, frame


def brute(docs, length=200):
    data = [(x or "").encode() for _, x in docs]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (doc, _), b in zip(docs, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def mixed(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 90))) for _ in range(8)]
    docs = []
    for i in range(60):
        text = ""
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            at = rng.randint(0, len(p) // 2)
            text += rng.choice([p, p[at:], p[:at], " ".join(rng.choice(words) for _ in range(40)), "x" * rng.randint(0, 300)])
        docs.append((i, text))
    return docs + ODD + [(3, docs[3][1]), (None, passages[0]), (None, passages[0]), (102, "ab" * 400), (103, "z" * 200), (104, "q" * 201)]


@pytest.mark.parametrize("group", [100_000, 3])
def test_suffixes_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(common, "LEAST_HOT", 1000 if group > 3 else 2)
    docs = mixed(5)
    found = queries.removed(suffixes.remove_repeats(frame(spark, docs)))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs)


def test_suffixes_over_the_table(spark, sf_dir):
    found = queries.op9_suffix_array(spark, sf_dir)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(documents(spark, sf_dir))


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    from borelog.llm import anchors

    monkeypatch.setattr(anchors, "PIECE", 1000)
    docs = mixed(6)
    docs.append((500, " ".join(t for _, t in docs if t)))
    rows = frame(spark, docs)
    spans = suffixes.anchored(rows.select(F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.hash("text").alias("tag"), F.coalesce("text", F.lit("")).alias("text")), 200, 32)
    assert spans.count() > 0
    assert sorted((tuple(r) for r in queries.removed(suffixes.remove_repeats(rows)).collect()), key=str) == brute(docs)


def test_empty_table(spark):
    none = frame(spark, ODD).limit(0)
    assert suffixes.remove_repeats(none).collect() == [] and chunks.dedup(none).collect() == []


def test_multikey_order():
    import numpy as np

    rng = random.Random(2)
    rows = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))).encode() for _ in range(300)]
    lengths = np.array([len(r) for r in rows])
    matrix = np.zeros((len(rows), 40), np.uint8)
    for i, r in enumerate(rows):
        matrix[i, : len(r)] = list(r)
    order, shared = suffixes.multikey_order(matrix, lengths)
    ordered = [rows[i] for i in order]
    assert ordered == sorted(rows)
    for a, b, n in zip(ordered, ordered[1:], shared[1:], strict=False):
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_gear_hash_is_the_rolling_one():
    import numpy as np

    raw = np.frombuffer(random.Random(1).randbytes(500), np.uint8)
    h, out = 0, []
    for b in raw.tolist():
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    assert chunks.gear(raw).tolist() == out


def test_chunks_keep_the_first_and_resist_insertions(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400))
    other = " ".join("".join(rng.choice("klmnopqrst") for _ in range(6)) for _ in range(400))
    docs = [(1, text), (2, "inserted " + text), (3, other), (4, other[:700] + " and then " + text[200:900]), (4, other[:700] + " and then " + text[200:900]), *ODD]
    found = chunks.dedup(frame(spark, docs)).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(docs)
    assert by[1]["spans"] == [] and by[3]["spans"] == []
    assert len(by[2]["kept"]) < 0.1 * len(text)
    assert len(by[4]["kept"]) < 700
    for r in found:
        if r["doc_id"] is not None:
            data = (dict(docs)[r["doc_id"]] or "").encode()
            for s in reversed(r["spans"]):
                data = data[: s["start"]] + data[s["end"] :]
            assert data == bytes(r["kept"])


def test_chunks_find_copies_in_the_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    seen = collections.Counter(t for _, t in docs)
    found = {r["doc_id"]: r for r in queries.op1_gear_chunks(spark, sf_dir).collect()}
    first = {}
    for doc, t in docs:
        if seen[t] > 1 and len(t.encode()) >= 100 and doc != first.setdefault(t, doc):
            assert found[doc]["n_removed"] == len(t.encode())


def find_collision(spark):
    """Two texts with one 32-bit hash: the first repeats a common passage, the second has other words there."""
    rng = random.Random(12)
    passage, other = ("".join(rng.choice(x) for _ in range(400)) for x in ("abcdefghij ", "klmnopqrst "))
    ends = spark.range(300_000).select(F.concat(F.when(F.col("id") % 2 == 0, passage).otherwise(other), F.lpad(F.col("id").cast("string"), 12, "0")).alias("text"))
    twice = ends.groupBy(F.hash("text").alias("h")).agg(F.sort_array(F.collect_list("text")).alias("t"))
    found = twice.where("size(t) > 1").orderBy("h").collect()
    pair = next(r["t"] for r in found if len({x[:9] for x in r["t"]}) == 2)
    return passage, next(x for x in pair if x.startswith(passage)), next(x for x in pair if x.startswith(other))


@pytest.mark.parametrize("id_", [None, 7])
def test_texts_with_one_short_hash_stay_apart(spark, id_):
    passage, a, b = find_collision(spark)
    docs = [(id_, a), (id_, b), (3, passage + " alone"), *[(9, passage[:250])] * 3]
    chunked = {bytes(r["kept"]) for r in chunks.dedup(frame(spark, docs[:3])).collect()}
    assert b.encode() in chunked
    found = queries.removed(suffixes.remove_repeats(frame(spark, docs)))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs)


def brute_chunks(docs):
    """Chunks cut byte by byte by the definition of the rolling hash; of equal ones the first in the order of documents stays, and of rows equal in id and text one."""
    rows, seen, once = [], {}, set()
    for doc, text in docs:
        data, pos, own = (text or "").encode(), 0, []
        while pos < len(data):
            end = min(pos + 256, len(data))
            for at in range(pos + 32, end):
                h = 0
                for b in data[max(0, at - 32) : at]:
                    h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
                if h >> 27 == 0:
                    end = at
                    break
            own.append((pos, end))
            pos = end
        rows.append((-1 if doc is None else doc, doc is not None, hashlib.md5(data).digest(), doc, data, own))
    for d, some, digest, _, data, own in rows:
        for a, z in own:
            one = (d, a << 16 | z - a, (some, digest))
            seen[data[a:z]] = min(seen.get(data[a:z], (one, 0))[0], one), seen.get(data[a:z], (0, 0))[1] + 1
    out = []
    for d, some, digest, doc, data, own in rows:
        kept = b"" if (doc, data) in once else b"".join(data[a:z] for a, z in own if seen[data[a:z]][0] == (d, a << 16 | z - a, (some, digest)))
        once.add((doc, data))
        out.append((doc, len(data), len(data) - len(kept), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("least_hot", [1000, 2])
def test_chunks_against_brute_force(spark, monkeypatch, least_hot):
    monkeypatch.setattr(common, "LEAST_HOT", least_hot)
    docs = [*mixed(15), (-1, mixed(15)[4][1]), (None, mixed(15)[4][1]), *[(700 + i, mixed(15)[5][1]) for i in range(20)]]
    found = queries.removed(chunks.dedup(frame(spark, docs))).drop("n_spans").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_chunks(docs)


def test_chunks_of_very_long_texts(spark):
    rng = random.Random(16)
    long = "".join(rng.choice("abcdefghij ") for _ in range(3_000_000))
    found = {r["doc_id"]: r for r in chunks.dedup(frame(spark, [(1, long), (2, "new " + long), (3, "z" * 2_000_000)])).collect()}
    assert not found[1]["spans"] and len(found[2]["kept"]) < 600 and len(found[3]["kept"]) <= 512


def test_chunks_find_short_copies(spark):
    rng = random.Random(14)
    line = "".join(rng.choice("abcdefghij ") for _ in range(90))
    docs = [(1, "That it."), (2, "That it."), (3, line), (4, line), (None, line), (5, "Other. " * 3)]
    found = {r["doc_id"]: bytes(r["kept"]).decode() for r in chunks.dedup(frame(spark, docs)).collect()}
    assert found == {None: line, 1: "That it.", 2: "", 3: "", 4: "", 5: "Other. " * 3}


def test_chunks_find_all_copies_in_the_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    seen = collections.Counter(t for _, t in docs)
    found = {r["doc_id"]: r for r in queries.op1_gear_chunks(spark, sf_dir).collect()}
    first = {}
    for doc, t in sorted(docs):
        if t and seen[t] > 1 and doc != first.setdefault(t, doc):
            assert found[doc]["n_removed"] == len(t.encode())


def test_chunks_of_repeated_rows_stay_once(spark):
    """Rows equal in id and text, with and without an id: one keeps its text, the others lose all of it."""
    text = "seventy bytes of a text that stands in three rows without any id at all"
    docs = [(None, text)] * 3 + [(7, "other " + text[::-1])] * 2 + [(8, ""), (8, ""), (9, "alone in the table")]
    found = collections.Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), tuple(map(tuple, r["spans"]))) for r in chunks.dedup(frame(spark, docs)).collect())
    n = len(text)
    assert found == {
        (None, n, text.encode(), ()): 1, (None, n, b"", ((0, n),)): 2, (7, n + 6, docs[3][1].encode(), ()): 1, (7, n + 6, b"", ((0, n + 6),)): 1,
        (8, 0, b"", ()): 2, (9, 18, b"alone in the table", ()): 1,
    }
