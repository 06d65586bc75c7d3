"""URL rules and quality rules against DuckDB and plain Python, language ID against held-out rows, and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from borelog.llm import language, quality, queries, urls

from .helpers import ODD, duck_rows, frame


def test_url_rules_against_sql(spark, sf_dir):
    df = queries.op3_range_join(spark, sf_dir)
    cols = sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == duck_rows(urls.SQL, sf_dir, ["pages"], cols)


def test_url_rules_against_brute_force(spark):
    rng = random.Random(1)
    labels = ["a", "b", "c", "com", "net"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: rng.choice(["", "/", "/x", "/x/", "/x/y", "/z"])
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(60))}.values())
    pages = [(i, f"http://{host().upper()}{path()}{rng.choice(['', '?q=1', '#t'])}") for i in range(400)] + [(900, None), (901, ""), (902, "no scheme"), (903, "http://"), (904, "http:///x"), (5, "http://a.com/x")]
    found = {}
    for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(1)), spark.createDataFrame(rules, "host string, path string, verdict string")).collect():
        found.setdefault(r["page_id"], []).append((r["host"], r["path"], r["rule"], r["verdict"]))
    for i, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        h, p = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = sorted((-len(a + b), a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b))
        assert (h, p, *((fits[0][1], fits[0][2]) if fits else (None, "allow"))) in found[i]


def test_url_rules_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [tuple(r) for r in urls.filter_urls(one, none).collect()] == [(1, "a.b", "/c", None, "allow")]
    assert urls.filter_urls(one.limit(0), none).collect() == []


def test_quality_against_sql(spark, sf_dir):
    df = queries.op5_line_frequency(spark, sf_dir)
    cols = sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == duck_rows(quality.SQL, sf_dir, ["documents"], cols)


def repeated(words):
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_repeated_words(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["a " * 30, "", " \t\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", quality.repeated_words(quality.word_list(F.col("text"))).alias("n")).collect()
    assert {r["i"]: r["n"] for r in rows} == {i: repeated(t.split()) for i, t in enumerate(texts)}


def test_common_lines_go_and_depleted_documents_too(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    docs = [(i, f"Site   Menu\n{own(i)}") for i in range(30)] + [(100, "\n".join(["site menu"] * 60)), (101, own(101)), *ODD, (3, f"Site   Menu\n{own(3)}")]
    found = quality.judge(frame(spark, docs), host_col="host", max_docs=20).collect()
    assert len(found) == len(docs)
    by = {r["doc_id"]: r for r in found}
    assert by[5]["kept"] and by[5]["n_removed"] == 11 and by[5]["text"] == own(5)
    assert by[3]["n_removed"] == 11
    assert not by[100]["kept"] and by[101]["kept"] and by[101]["n_removed"] == 0
    assert by[9001]["base_failed"] and by[9002]["n_words"] == 0
    assert quality.judge(frame(spark, docs).limit(0), host_col="host").collect() == []


def test_quality_of_a_hot_line_and_a_very_long_text(spark, monkeypatch):
    from borelog.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 5)
    words = " ".join(f"w{k}" for k in range(30))
    docs = [(i, f"Menu\n{words} {i}\nmenu") for i in range(60)] + [(900, "\n".join(f"line {k} of a long text" for k in range(40_000)) + "\nMenu")]
    by = {r["doc_id"]: r for r in quality.judge(frame(spark, docs), host_col="host").collect()}
    assert len(by) == 61 and all(by[i]["n_removed"] == 8 and by[i]["kept"] for i in range(60))
    assert by[900]["n_removed"] == 4 and by[900]["n_words"] == 240_001 and by[900]["text"].endswith("39999 of a long text")


def test_language_ties_null_ids_and_copies(spark):
    import numpy as np

    docs = [(i, "the and of " * 9, "en") for i in range(400)] + [(1000 + i, f"der und die {i}", "de") for i in range(30)] + [(None, "le et la", "fr"), (None, "le et la", "fr")]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert language.fit(rows, per_lang=20)["families"] == ["germanic", "romance"]
    assert rows.where("doc_id is null").select(language.held_out().alias("h")).distinct().collect()[0]["h"] is True
    best, share = language.vote(np.zeros((2, 4), np.float32), [(0, 1, np.zeros(5, np.float32))], 2)
    assert best.tolist() == [0, 0] and share.tolist() == [0.5, 0.5]
    long = spark.createDataFrame([(1, "der und die nicht " * 200_000), (2, "x")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(long, language.fit(rows)).collect()}[1] == "de"


def test_language_on_held_out_rows(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op10_language(spark, sf_dir).collect() if r["held_out"]]
    assert len(rows) > 20 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows_and_no_labels(spark, sf_dir):
    model = language.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    docs = [*ODD, (1, "12 34 !?"), (2, "the thing of the nation and that"), (2, "the thing of the nation and that")]
    found = language.predict(frame(spark, docs), model, keep=["text", "host"])
    assert found.columns == ["doc_id", "text", "host", "lang_pred", "score"]
    rows = [(r["doc_id"], r["lang_pred"]) for r in found.collect()]
    assert len(rows) == len(docs) and {d for d, p in rows if p == "und"} == {9001, 9002, 9004, None, 1} and rows.count((2, "en")) == 2
    empty = language.fit(frame(spark, docs).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.predict(frame(spark, docs), empty).collect()} == {"und"}
    assert language.predict(frame(spark, docs).limit(0), model).collect() == []
    clash = frame(spark, docs).withColumns({"score": F.lit("s"), "lang_pred": F.lit("l"), "_text": F.lit("t"), "k0": F.lit("k")})
    kept = language.predict(clash, model, keep=["score", "_text", "lang_pred", "text", "k0"])
    assert kept.columns == ["doc_id", "score_in", "_text", "lang_pred_in", "text", "k0", "lang_pred", "score"]
    plain = {(r["doc_id"], r["text"], r["lang_pred"], r["score"]) for r in language.predict(frame(spark, docs), model, keep=["text"]).collect()}
    assert {(r["doc_id"], r["text"], r["lang_pred"], r["score"]) for r in kept.collect()} == plain
    assert {(r["score_in"], r["_text"], r["lang_pred_in"], r["k0"]) for r in kept.collect()} == {("s", "t", "l", "k")}


def test_pipeline_stages(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    from . import test_matching, test_removal

    for name, stage in pipeline.STAGES:
        before = sorted(kept.items())
        out = stage(spark, docs, sf_dir)
        if name == "encoding":
            assert {r["doc_id"] for r in out.collect()} == set(kept)
            break
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "near duplicates":
            wanted = {d for d, c, _ in test_matching.brute(before) if d == c}
            assert set(now) == wanted
        elif name == "repeated strings":
            wanted = {d: n - g for d, n, g, _, _ in test_removal.brute(before)}
            assert set(now) == set(kept) and all(0 <= wanted[d] - len(t.encode()) <= 6 * 10 for d, t in now.items())
        elif name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert not [d for d, t in now.items() if any(x in t for x in items)]
            assert set(now) <= set(kept)
        kept = now



def test_pipeline_of_an_empty_table_and_of_null_texts(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, doc string, tag int"
    spark.createDataFrame([(0, "an item that nothing holds")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "the house of the lord", "en", "s", 1, "x", 1), (2, None, "en", "s", 0, "x", 1), (3, "", None, None, None, "x", 1), (4, "das haus und der hof " * 5, "de", "s", 1, "x", 1), (None, None, None, None, None, None, None)]
    for rows in (spark.createDataFrame([], schema), spark.createDataFrame(docs, schema)):
        now = rows
        for name, stage in pipeline.STAGES:
            out = stage(spark, now, str(tmp_path)).collect()
            if name != "encoding":
                now = spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long")
        assert {r["doc_id"] for r in out} <= {1, 4}
    # A null text passes every stage but the first by itself.
    one = spark.createDataFrame([docs[1][:5]], "doc_id long, text string, lang string, source string, n_chars long")
    assert [len(stage(spark, one, str(tmp_path)).collect()) for _, stage in pipeline.STAGES] == [0, 1, 1, 1, 1]


def test_pipeline_runs(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert pipeline.run(spark, sf_dir).count() > 100


def test_pipeline_stages_on_odd_ids(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    new = lambda n=60: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c, d, item = new(), new(), new(), new(), new(20)
    docs = [(1, a), (1, a), (1, b), (None, a + " end"), (None, c), (None, c), (2, d), (None, d + " more"), (1, d + " end"), (None, ""), (None, "")]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in pipeline.one_of_each(spark, rows, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (None, c), (1, d + " end"), (None, ""), (None, "")], key=str)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, a), (1, b + " " + item), (None, c), (None, d + " " + item), (3, item), (3, item)]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], rows.schema)
    kept = [(r["doc_id"], r["text"]) for r in pipeline.decontaminated(spark, rows, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (None, c)], key=str)
