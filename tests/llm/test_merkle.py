"""The manifest against a plain construction of the same trees, and against SQL."""

import hashlib
import random
import zlib

import pytest

from borelog.llm import merkle, queries

from .helpers import duck_rows

COLUMNS = "doc_id leaf subroot root proof_sha256 folded_root verified".split()


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows):
    """One recursion over runs of three: every leaf gets its digest, the roots and its siblings."""

    def grow(nodes):
        """The root over (digest, members) nodes; each member's path grows on the way."""
        while len(nodes) > 1:
            above = []
            for i in range(0, len(nodes), 3):
                run = nodes[i : i + 3]
                for k, (_, members) in enumerate(run):
                    for m in members:
                        m["path"].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :])))
                above.append((h("".join(d for d, _ in run)), [m for _, ms in run for m in ms]))
            nodes = above
        return nodes[0]

    groups = {}
    for r in rows:
        crc = None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode())
        now = r["text"].replace("\n", "") if r["text"] is not None and crc is not None and crc % 2 == 0 else r["text"]
        groups.setdefault(r["source"], []).append({"doc_id": r["doc_id"], "leaf": leaf_of(r, r["text"]), "now": leaf_of(r, now), "path": []})
    tops = []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        members = sorted(groups[source], key=lambda m: (m["doc_id"] is not None, m["doc_id"] or 0, m["leaf"]))
        top = grow([(m["leaf"], [m]) for m in members])
        for m in members:
            m["subroot"] = top[0]
        tops.append((top[0], members))
    if not tops:
        return []
    root, members = grow(tops)
    out = []
    for m in members:
        found = m["now"]
        for left, right in m["path"]:
            found = h(left + found + right)
        out.append((m["doc_id"], m["leaf"], m["subroot"], root, h("".join(a + b for a, b in m["path"])), found, found == root))
    return out


def made(n, groups, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "one", "a\nb", "\n", "é\n漢 " * 3])
        rows.append({"doc_id": rng.choice([i, i, i, i // 2, None]), "source": rng.choice(groups), "lang": rng.choice([None, "", "en"]), "n_chars": rng.choice([None, 0, -1, 12]), "text": text})
    return rows


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([tuple(r[k] for k in ("doc_id", "source", "lang", "n_chars", "text")) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    return df.withColumns({k: F.lit("x") for k in ("tree", "key", "node", "now", "row", "pos", "n", "block", "root", "leaf", "part", "at")})


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("n", "height", "top"), [(1, 1, 1), (2, 7, 100), (40, 1, 1), (120, 2, 3), (120, 1, 40), (300, 3, 10_000)])
def test_blocks_of_any_height_and_a_driver_of_any_size(spark, n, height, top):
    names = [None, "", "a", "b", "é", "Z"] if top < 100 else [None, "web"]
    rows = made(n, names, n + height)
    df = frame(spark, rows)
    assert found(merkle.manifest(df, merkle.tampered(), height=height, top=top)) == sorted(plain(rows), key=repr)


def test_more_trees_than_the_driver_takes(spark):
    rows = made(90, [f"s{i}" for i in range(25)], 5)
    assert found(merkle.manifest(frame(spark, rows), merkle.tampered(), height=1, top=2)) == sorted(plain(rows), key=repr)


def test_repeated_rows_a_single_leaf_and_an_empty_table(spark):
    one = {"doc_id": 7, "source": None, "lang": None, "n_chars": None, "text": "x\ny"}
    for rows in ([one], [one] * 11, [{**one, "doc_id": None}] * 5):
        assert found(merkle.manifest(frame(spark, rows), merkle.tampered(), height=1)) == sorted(plain(rows), key=repr)
    single = merkle.manifest(frame(spark, [one])).first()
    assert single["leaf"] == single["subroot"] == single["root"] and single["proof_sha256"] == h("") and single["verified"]
    assert merkle.manifest(frame(spark, [one]).limit(0)).collect() == []


def test_untouched_rows_fold_to_the_root_and_others_do_not(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert merkle.manifest(docs).where("not verified").count() == 0
    lost = {r["doc_id"] for r in docs.collect() if r["text"] and "\n" in r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0}
    assert {r["doc_id"] for r in queries.op11_merkle(spark, sf_dir).where("not verified").collect()} == lost != set()


def test_op11_against_sql_and_the_plain_construction(spark, sf_dir):
    rows = found(queries.op11_merkle(spark, sf_dir))
    assert rows == sorted(plain([r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]), key=repr)
    assert rows == duck_rows(merkle.SQL, sf_dir, ["documents"], COLUMNS)
