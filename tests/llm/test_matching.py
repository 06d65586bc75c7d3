"""Near duplicates, contamination and licenses against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from borelog.llm import common, contamination, graph, jaccard, licenses, queries

from .helpers import ODD, documents, frame


def shingles(text):
    w = (text or "").lower().split()
    return set(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    links, root = [0] * len(docs), list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), 1 << 62), doc)
    return sorted([(docs[i][0], least.get(find(i)), links[i]) for i in range(len(docs))], key=str)


@pytest.mark.parametrize("block", [128, 16])
def test_near_duplicates_against_all_pairs(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(common, "LEAST_HOT", 1000 if block > 100 else 3)
    docs = documents(spark, sf_dir)
    rng = random.Random(3)
    base, others = docs[5][1].split(), docs[9][1].split()
    for k in range(300):
        w = base[:]
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(others)
        docs.append((1000 + k, " ".join(w)))
    docs += [*ODD, (2003, "A  b"), (None, docs[5][1]), (3, docs[3][1]), (3, docs[3][1]), *[(4000 + k, docs[7][1]) for k in range(120)]]
    found = jaccard.near_duplicates(frame(spark, docs))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs)


def chains(rng, n=40):
    """Texts in threes: the third is linked to both others, which are not linked to each other."""
    docs = []
    for t in range(n):
        w = [str(rng.randrange(10**6)) for _ in range(100)]
        docs += [(10 * t, " ".join(["a"] * 9 + w[9:])), (10 * t + 1, " ".join(w[:-9] + ["b"] * 9)), (10 * t + 2, " ".join(w))]
    return docs


@pytest.mark.parametrize("block", [128, 2])
def test_two_classes_that_a_third_links_are_one(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = chains(random.Random(5))
    found = jaccard.near_duplicates(frame(spark, docs)).collect()
    assert sorted(map(tuple, found)) == sorted((d, d - d % 10, 2 if d % 10 == 2 else 1) for d, _ in docs)
    assert sorted(map(tuple, found), key=str) == brute(docs)


#: Texts of four and five shingles, four in common, whose MinHash values agree in no band of four (bands were the buckets once).
UNLUCKY = [
    ("6431 4389 9410 1711 2204 7050 4412 9291", "26378"),
    ("9248 5115 2161 8919 9363 4618 8340 5635", "22646"),
    ("5244 5184 2645 4912 3603 7942 63 9326", "45440"),
    ("8928 9815 1873 382 4036 1978 8397 6322", "75367"),
]


def test_no_link_is_left_to_chance(spark, sf_dir):
    docs = [(10 * k + i, t) for k, (x, more) in enumerate(UNLUCKY) for i, t in enumerate([x, f"{x} {more}"])]
    found = jaccard.near_duplicates(frame(spark, docs)).collect()
    assert sorted(map(tuple, found)) == sorted((d, d - d % 10, 1) for d, _ in docs)
    corpus = frame(spark, docs).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, corpus, sf_dir).collect()) == [0, 10, 20, 30]


def test_unlikely_pairs_are_dropped_on_proof_only():
    rng = np.random.default_rng(6)
    for size in (1, 5, 10, 40, 500, 5000, 90_000):
        base = rng.integers(0, 2**64 - 1, size, np.uint64)
        sets = [np.unique(np.r_[base[: size - cut], rng.integers(0, 2**64 - 1, more, np.uint64)]) for cut in (0, size // 20, size // 5, size // 2) for more in (0, size // 9, size // 4)]
        sets = [x for x in sets if len(x)]
        pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
        left, right = np.array(pairs).T
        reach = [len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9 for i, j in pairs]
        sketch = rng.integers(0, 2**32 - 1, (len(sets), jaccard.HASHES), np.uint32)  # says that no pair is alike
        found = jaccard.linked(sketch, np.array(list(map(len, sets))), sets, left, right, 0.8, jaccard.least_matches(0.8, 1e-9))
        assert sorted(zip(*(x.tolist() for x in found), strict=True)) == sorted(p for p, ok in zip(pairs, reach, strict=True) if ok)
    few, other = (rng.integers(0, 2**64 - 1, 1000, np.uint64) for _ in range(2))
    assert jaccard.apart(np.array([1000, 1000]), [few, other], np.array([0]), np.array([1]), 0.8).all()


@pytest.mark.parametrize("first", [0.02, 0.1, 0.5])
def test_every_pair_at_the_threshold_has_a_common_bucket(spark, first):
    rng = random.Random(12)
    common = [rng.randrange(2**40) for _ in range(40)]
    sets = []
    for _ in range(60):
        base = {rng.randrange(2**40) for _ in range(rng.choice([1, 3, 9, 10, 60]))} | set(rng.sample(common, rng.choice([0, 1, 20])))
        sets.append(base)
        for _ in range(4):
            cut = rng.randint(0, max(1, len(base) // 8))
            sets.append(set(rng.sample(sorted(base), max(1, len(base) - cut))) | {rng.randrange(2**40) for _ in range(rng.randint(0, len(base) // 8 + 1))})
    rows = [(k, len(x), b"".join(v.to_bytes(5, "little") for v in sorted(x)[: jaccard.first_shingles(np.array([len(x)]), 0.8, first)[0][0]])) for k, x in enumerate(sets)]
    held = {}
    for bucket, node in jaccard.buckets(spark.createDataFrame(rows, "node long, size long, first binary"), 0.8, first).collect():
        held.setdefault(node, set()).add(bucket)
    wanted = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    assert len(wanted) > 50 and all(held.get(i, set()) & held.get(j, set()) for i, j in wanted)


def test_the_pipeline_keeps_one_of_a_chain(spark, sf_dir):
    docs = frame(spark, chains(random.Random(5))).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, sf_dir).collect()) == [10 * t for t in range(40)]


def test_cells_grow_with_a_group_and_every_pair_meets_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "ZONE_BLOCK", 16)
    monkeypatch.setattr(common, "LEAST_HOT", 50)
    rng = random.Random(8)
    hubs = {x: {0} for x in range(400)}  # one group, some of which have others too
    for x in range(0, 400, 7):
        hubs[x].add(rng.choice([1, 2, 3]))
    for x in range(400, 700):  # a second group, small ones, and some that go with the first
        hubs[x] = {400} if x < 500 else {rng.randrange(500, 560), rng.choice([1, 2, 400, 570, 571])}
    own = spark.createDataFrame([(x, h) for x, hs in hubs.items() for h in sorted(hs)], "node long, hub long")
    size = spark.createDataFrame([(x, 10) for x in hubs], "node long, size long")
    held = {}
    for node, block, other in jaccard.cells(own, size).collect():
        cell = held.setdefault((min(block, other), max(block, other)), [])
        assert (node, block) not in cell
        cell.append((node, block))
    together = {}
    for (i, j), nodes in held.items():
        left, right = ([x for x, b in nodes if b == k] for k in (i, j))
        for x, y in {(min(x, y), max(x, y)) for x in left for y in right if x != y}:
            together[x, y] = together.get((x, y), 0) + 1
    assert max(together.values()) == 1
    assert all((x, y) in together for x in hubs for y in hubs if x < y and hubs[x] & hubs[y])
    alone = own.where("hub = 0")
    assert jaccard.cells(alone, size).count() <= 3 * 400  # four partitions: three blocks at most, however many classes


def test_near_duplicates_of_nothing(spark):
    assert jaccard.near_duplicates(frame(spark, ODD).limit(0)).collect() == []
    assert sorted((r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(frame(spark, ODD[:2])).collect()) == [(9001, 0), (9002, 0)]


def test_pruning_never_drops_a_likely_pair():
    need = jaccard.least_matches(0.8, 1e-9)
    assert sorted(need) == [32, 64, 96, 128] and all(need[n] < 0.8 * n for n in need)


def test_very_long_texts_are_near_duplicates(spark):
    rng = random.Random(21)
    long = [str(rng.randrange(50_000)) for _ in range(300_000)]
    near = [w if i % 1000 else "changed" for i, w in enumerate(long)]
    docs = [(5, " ".join(long)), (6, " ".join(near)), (7, " ".join(long[:100_000])), (8, "x" * 1_000_000)]
    assert sorted(tuple(r) for r in jaccard.near_duplicates(frame(spark, docs)).collect()) == [(5, 5, 1), (6, 5, 1), (7, 7, 0), (8, 8, 0)]


def test_hot_keys_are_dealt_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 5)
    many = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(900)] + [(None, -1), (99, -2)], "k long, v long")
    one = spark.createDataFrame([(k, f"a{k}") for k in range(7)] + [(0, "again"), (50, "none")], "k long, w string")
    hot = common.hot_keys(many.where("k is not null").groupBy("k").agg(common.F.count("*").alias("n")), ["k"])
    assert {r["k"]: r["_parts"] for r in hot.collect()}[0] > 1
    for how in ("inner", "left", "left_semi", "left_anti"):
        found = common.meet(many, one, ["k"], hot, ["v"], how)
        wanted = many.join(one, ["k"], how)
        assert found.columns == wanted.columns and sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    found = {r["node"]: r["label"] for r in graph.components(spark, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def distance(item, text):
    """Edits of the whole item against its best place in the text."""
    row = [0] * (len(text) + 1)
    for c in item:
        new = [row[0] + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edit_budget_against_full_tables():
    rng = random.Random(4)
    for t in range(150):
        letters = "abcd efgh" if t % 2 else "ab "
        item = "".join(rng.choice(letters) for _ in range(rng.randint(1, 90)))
        changed = list(item)
        for _ in range(rng.randint(0, 1 + len(item) // 6)):
            at, kind = rng.randrange(len(changed) + 1), rng.random()
            if at == len(changed):
                continue
            if kind < 0.4:
                changed[at] = rng.choice(letters)
            elif kind < 0.7:
                changed.insert(at, rng.choice(letters))
            else:
                del changed[at]
        around = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(2)]
        text = around[0] + "".join(changed) + around[1]
        known = contamination.by_gram([7], [item], 8, 0.1)[0]
        found = known.find(contamination.code_points(text))
        wanted = distance(item, text)
        assert known.budget[0] == len(item) // 10
        assert (found[0][1] if found else None) == (wanted if wanted <= known.budget[0] else None)


def test_contamination_over_the_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = {(r["doc_id"], r["item_id"]) for r in queries.op4_qgram_lemma(spark, sf_dir).collect()}
    quoted = {(d, i) for d, t in docs for i, x in items if x in t}
    assert quoted and quoted <= found


def test_contamination_in_blocks_and_with_odd_rows(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = [(r["item_id"], r["text"]) for r in items.orderBy("item_id").limit(4).collect()]
    docs = [*ODD, (1, texts[0][1].upper()), (2, texts[1][1].replace(" ", "\n")), (2, texts[1][1].replace(" ", "\n")), (3, texts[2][1][:-3] + "xyz"), (4, "nothing of it " * 10)]
    df = frame(spark, docs)
    found = contamination.contaminated(df, items)
    wanted = [(1, texts[0][0], 0), (2, texts[1][0], 0), (2, texts[1][0], 0), (3, texts[2][0], 3)]
    assert sorted(tuple(r)[:3] for r in found.collect()) == wanted
    assert sorted(tuple(r)[:3] for r in contamination.contaminated(df, items, block_chars=2000).collect()) == wanted
    assert contamination.contaminated(df.limit(0), items).collect() == [] and contamination.contaminated(df, items.limit(0)).collect() == []


def test_short_items_and_very_long_texts(spark):
    rng = random.Random(31)
    items = spark.createDataFrame([(1, "é"), (2, "Qz"), (3, "seven b"), (4, "a short item of 30 characters!"), (5, " \n\xa0"), (6, None), (7, "")], "item_id long, text string")
    far = "".join(rng.choice("lmnop ") for _ in range(2_500_000))
    docs = [(1, far + "A Short itXm of 30 chars!" + far[:99]), (2, far[: (1 << 20) - 3] + "seven B" + far[:50]), (3, "oqZo"), (4, "caf\u00c9"), (5, "seven  b"), *ODD[:2]]
    found = contamination.contaminated(frame(spark, docs), items).collect()
    assert sorted(tuple(r)[:3] for r in found) == [(2, 3, 0), (3, 2, 0), (4, 1, 0)]
    docs[0] = (1, far + "A Short itXm of 30 characters" + far[:99])
    found = {tuple(r)[:3]: tuple(r)[3:] for r in contamination.contaminated(frame(spark, docs), items).collect()}
    assert (1, 4, 2) in found and abs(found[1, 4, 2][0] - len(far)) <= 2


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"]
    words = mit.split()
    altered = " ".join(w for i, w in enumerate(words) if i % 25)  # a word in 25 is missing
    docs = [(1, "Before. Released under the MIT License. After."), (2, "x " * 50 + mit + " y"), (3, altered), (4, "The license of the road."), *ODD, (5, "ALL RIGHTS  RESERVED"), (5, "ALL RIGHTS  RESERVED")]
    found = sorted((r["doc_id"], r["template"], round(r["coverage"], 2)) for r in licenses.scan(frame(spark, docs)).collect())
    assert found == [(1, "mit-notice", 1.0), (2, "mit", 1.0), (3, "mit", round(1 - len(words[::25]) / len(words), 2)), (5, "all-rights-reserved", 1.0), (5, "all-rights-reserved", 1.0)]
    span = licenses.scan(frame(spark, docs[:1])).first()
    assert docs[0][1][span["start"] : span["end"]] == "Released under the MIT License"
    assert licenses.scan(frame(spark, docs).limit(0)).collect() == [] and licenses.scan(frame(spark, docs), {}).collect() == []


def test_licenses_over_the_table(spark, sf_dir):
    found = {(r["doc_id"], r["template"]) for r in queries.op7_licenses(spark, sf_dir).collect()}
    notices = {k: licenses.TEMPLATES[k] for k in ("mit-notice", "apache-2.0-notice", "gpl-3.0-notice", "cc-by-nc-4.0-notice", "all-rights-reserved")}
    wanted = {(d, k) for d, t in documents(spark, sf_dir) for k, x in notices.items() if x in t}
    assert wanted and wanted <= found


def test_licenses_with_spread_edits_against_unfiltered_alignment(spark):
    rng = random.Random(8)
    docs, sure = [], set()
    for name, template in licenses.TEMPLATES.items():
        words = "".join(c if c.isalnum() else " " for c in template).split()
        for step in (5, 6, 7):
            before = [rng.choice(words + ["other"]) for _ in range(rng.randint(0, 30))]
            text = [f"changed{i}" if i % step == step - 2 else w for i, w in enumerate(words)]
            docs.append((len(docs), " ".join([*before, *text, *before[:9]])))
            if sum(i % step != step - 2 for i in range(len(words))) >= 0.8 * len(words):
                sure.add((docs[-1][0], name))
        docs.append((len(docs), " ".join(words[: len(words) // 3] + ["stray"] * (len(words) // 9) + words[len(words) // 3 :])))
    docs.append((len(docs), "all rights reserved " * 3 + "the " * 400))
    found = {(r["doc_id"], r["template"], r["n_matched"]) for r in licenses.scan(frame(spark, docs)).collect()}
    assert len(sure) > 12 and sure <= {x[:2] for x in found}
    index = licenses.Index(licenses.TEMPLATES, 0.8)
    small = {d for d, text in docs if len(text.split()) < 50}
    wanted, best = {}, {}
    for doc, name, n in found:
        best[doc, name] = max(n, best.get((doc, name), 0))
    for doc, text in docs:
        code = index.codes(licenses.word_hashes(licenses.pa.array([text]))[4])
        for t, own in enumerate(index.words):
            if len(own) < 20 and doc in small:
                n = max(licenses.align(own, code, c, index.band(t))[0] for c in range(-len(own), len(code) + 1))
                if n >= 0.8 * len(own):
                    wanted[doc, index.names[t]] = n
    assert len(wanted) > 12 and wanted == {k: n for k, n in best.items() if k[0] in small and len(index.words[index.names.index(k[1])]) < 20}
    assert licenses.scan(frame(spark, docs[-1:])).where("template = 'all-rights-reserved'").count() == 3


def test_winnowing_by_its_definition():
    rng = random.Random(8)
    for _ in range(60):
        h = np.array([rng.randrange(6) for _ in range(rng.randint(0, 60))], np.uint64)
        cuts = sorted(rng.randint(0, len(h)) for _ in range(3))
        first, k, w = np.array([0, *cuts, len(h)]), rng.randint(1, 3), rng.randint(1, 4)
        grams = licenses.winnowed(h, np.array([0, len(h)]), k, 1)[0]
        wanted = set()
        for a, z in zip(first[:-1], first[1:], strict=True):
            for i in range(a, z - k - w + 2):
                window = grams[i : i + w].tolist()
                wanted.add(i + max(j for j in range(w) if window[j] == min(window)))
        found, place = licenses.winnowed(h, first, k, w)
        assert place.tolist() == sorted(wanted) and found.tolist() == grams[sorted(wanted)].tolist()


def test_fingerprints_lose_no_place_that_reaches_the_coverage():
    """Every alignment within the band has a run as long as a window, for any coverage: texts built to break runs as often as they may."""
    rng = random.Random(9)
    for coverage in (0.5, 0.8, 0.95, 1.0):
        templates = {str(m): " ".join(f"t{m}x{i}" for i in range(m)) for m in (1, 3, 5, 12, 40)}
        index = licenses.Index(templates, coverage)
        if coverage == 1.0:
            assert max(index.shapes) > (1, 1) and max(w for _, w in index.shapes) > 1
        for t, name in enumerate(index.names):
            words = templates[name].split(" ")
            for _ in range(6):
                gone = set(rng.sample(range(len(words)), len(words) - index.need[t]))
                room, text = 2 * index.band(t), []
                for i, word in enumerate(words):
                    text += [] if i in gone and rng.random() < 0.5 else ["zz" if i in gone else word]
                    if room and rng.random() < 0.6:
                        text.append("new")
                        room -= 1
                h = licenses.word_hashes(licenses.pa.array([" ".join(text)]))[4]
                code = index.codes(h)
                n = max((licenses.align(index.words[t], code, c, index.band(t))[0] for c in range(-len(words), len(code) + 1)), default=0)
                if n >= index.need[t]:
                    assert index.candidates(h, np.array([0, len(h)]))[0, t]


def test_licenses_of_null_ids_and_equal_places(spark):
    text = licenses.TEMPLATES["all-rights-reserved"]
    docs = [(None, text), (None, text), (1, f"{text} {text}"), (2, None)]
    found = sorted(((r["doc_id"], r["start"]) for r in licenses.scan(frame(spark, docs)).collect()), key=str)
    assert found == [(1, 0), (1, 21), (None, 0), (None, 0)]


def test_one_character_over_and_over():
    """Rules of dashes in items and texts are counted by runs: little memory, and the places of brute force."""
    import resource
    import time

    items = ["-" * 200, "=" * 120, "-=" * 60, "see " + "-" * 40 + " below"]
    points = [contamination.code_points(x) for x in items]
    known = contamination.Items([1, 2, 3, 4], points, 8, 0.1)
    for text in ("-" * 700, "x" + "-" * 150 + "y" + "-" * 60, "=-" * 100 + "==-" * 9, "see " + "-" * 37 + " below", "-" * 185, "-" * 170):
        found = {i: e for i, e, *_ in known.find(contamination.code_points(text))}
        assert found == {i: d for i, x in enumerate(items) for d in [distance(x, text)] if d <= len(x) // 10}
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    long = ("-" * 99 + "+") * 10_000
    found = {i: e for i, e, *_ in known.find(contamination.code_points(long))}
    assert found == {0: 2}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000 and time.process_time() - began < 120


def test_contamination_against_full_tables_over_rows(spark):
    """The query's rows equal those of full tables, edits planted: nothing is found that is not there."""
    rng = random.Random(12)
    letters = "abcdefgh ij"
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([6, 30, 80, 120])))) for i in range(12)]
    docs = []
    for d in range(60):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 150)))
        for i in rng.sample(range(12), rng.randint(0, 2)):
            body = list(items[i][1])
            for _ in range(rng.randint(0, 2 + len(body) // 8)):
                at = rng.randrange(len(body))
                body[at : at + rng.choice([0, 1])] = rng.choice(letters) * rng.choice([0, 1])
            at = rng.randint(0, len(text))
            text = text[:at] + "".join(body) + text[at:]
        docs.append((d, text))
    asked = spark.createDataFrame([(i, x) for i, x in items if x.strip()], "item_id long, text string")
    wanted = sorted((d, i, n) for d, t in docs for i, x in items if x.strip() for n in [distance(x, t)] if n <= len(x) // 10)
    for chars in (2_000_000, 150):
        found = contamination.contaminated(frame(spark, docs), asked, block_chars=chars)
        assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in found.collect()) == wanted
