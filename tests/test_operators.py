import random

from pyspark.sql import functions as F

from borelog.operators import extraction, joins, search, sequences


def test_layer_gap_resolves_to_group(spark):
    from borelog.plans.records import layer_at

    tops = spark.createDataFrame([(1, "A", "FORMATION", 100.0, 200.0), (1, "B", "FORMATION", 300.0, 400.0), (1, "G", "GROUP", 50.0, None)], "well_id long, formation string, level string, top double, base double")
    asked = spark.createDataFrame([(1, 150.0), (1, 250.0), (1, 300.0), (1, 20.0), (2, 100.0)], "well_id long, md double")
    assert {(r["well_id"], r["md"]): r["at"] for r in layer_at(asked, tops).collect()} == {(1, 150.0): "A", (1, 250.0): "G", (1, 300.0): "B", (1, 20.0): None, (2, 100.0): None}


def test_nearest_takes_the_shallower_of_two(spark):
    mud = spark.createDataFrame([(1, 100.0, 9.0), (1, 300.0, 10.0)], "well_id long, at double, mw double")
    asked = spark.createDataFrame([(1, 200.0), (1, 460.0), (1, 290.0), (2, 100.0)], "well_id long, md double")
    found = {(r["well_id"], r["md"]): r["mw"] for r in joins.nearest(asked, mud, ["well_id"], "md", "at", ["mw"], 150).collect()}
    assert found == {(1, 200.0): 9.0, (1, 460.0): None, (1, 290.0): 10.0, (2, 100.0): None}


def test_radius_join_against_all_pairs(spark):
    rng = random.Random(1)
    wells = [(i, 58 + rng.random() / 4, 2 + rng.random() / 2) for i in range(150)]
    df = spark.createDataFrame(wells, "well_id long, lat double, lon double")
    found = {(r["well_id"], r["well_id_o"]) for r in joins.within_radius(df, df, 5000.0).collect()}
    import math

    def metres(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))

    assert found == {(a[0], b[0]) for a in wells for b in wells if a[0] != b[0] and metres(a, b) <= 5000}


def test_unmatched(spark):
    a = spark.createDataFrame([(1, 100.0), (1, 500.0)], "k long, md double")
    b = spark.createDataFrame([(1, 130.0), (2, 500.0)], "k long, md double")
    assert [r["md"] for r in joins.unmatched(a, b, ["k"], "md", 30.0).collect()] == [500.0]


def test_greedy_keep_measures_from_kept_rows(spark):
    rows = spark.createDataFrame([(1, 100.0), (1, 125.0), (1, 150.0)], "k long, md double")
    assert sorted(r["md"] for r in sequences.greedy_keep(rows, ["k"], "md", ["md"], 30.0).collect()) == [100.0, 150.0]


def test_short_runs_merge(spark):
    rows = spark.createDataFrame([(1, 0.0, 10.0, "a"), (1, 10.0, 12.0, "b"), (1, 12.0, 30.0, "a"), (1, 30.0, 31.0, "c")], "k long, top double, base double, v string")
    assert [tuple(r) for r in sequences.merge_short_runs(rows, "k", "top", "base", "v", 5.0).orderBy("run").collect()] == [(1, 1, 0.0, 31.0, "a")]


def test_cusum_alarms_once_and_starts_anew(spark):
    rows = spark.createDataFrame([(1, i, 0.0 if i < 10 else 3.0) for i in range(13)], "k long, i long, x double")
    found = [r["alarm"] for r in sequences.cusum(rows, "k", ["i"], "x").orderBy("i").collect()]
    assert found == [None] * 12 + ["possible_influx"]


EVENTS = [
    ("Severe losses started at 2,150 m, lost 40 bbl.", "lost_circulation", 2150.0),
    ("The string got stuck at 1544 m.", "stuck_pipe", 1544.0),
    ("Took a kick at 9850 ft.", "kick", 3002.3),
]


def test_events(spark):
    rows = [(i, 1, i, "p1.%d" % i, t) for i, (t, _, _) in enumerate(EVENTS)] + [(9, 1, 9, "p1.9", "No losses were seen."), (10, 1, 10, "p1.10", "Kick-off point at 800 m."), (11, 1, 11, "p1.11", None)]
    passages = spark.createDataFrame(rows, "passage_id long, document_id long, seq long, locator string, text string")
    found = {r["passage_id"]: r for r in extraction.events(passages).collect()}
    assert set(found) == {0, 1, 2}
    for i, (_, hazard, md) in enumerate(EVENTS):
        assert (found[i]["hazard"], found[i]["md"]) == (hazard, md)
    assert found[0]["severity"] == "high" and found[0]["quantity"] == 40.0 and found[0]["quantity_unit"] == "bbl" and found[0]["confidence"] == 0.7


def test_episode_reads_four_rows_on(spark):
    def outcome(place):
        texts = ["The string got stuck at 1544 m."] + ["Worked on."] * 6
        texts[place] = "The pipe was freed."
        rows = [(i, 1, i, f"p1.{i}", t) for i, t in enumerate(texts)]
        passages = spark.createDataFrame(rows, "passage_id long, document_id long, seq long, locator string, text string")
        return extraction.episodes(passages, extraction.events(passages)).first()["outcome"]

    assert outcome(4) == "resolved"
    assert outcome(5) == "unknown"


def test_episode_ends_with_its_paragraph_and_counts_time(spark):
    rows = [(0, 1, 0, "p1.0", "Losses at 300 m.", "2020-01-01 06:00:00"), (1, 1, 1, "p1.1", "Pumped LCM, 5 hrs lost. Losses were cured.", "2020-01-01 18:00:00")]
    passages = spark.createDataFrame(rows, "passage_id long, document_id long, seq long, locator string, text string, t string").withColumn("t", F.to_timestamp("t"))
    found = extraction.episodes(passages, extraction.events(passages)).where("passage_id = 0").first()
    assert (found["outcome"], found["hours_to_resolve"], found["npt_hours"], found["action_types"]) == ("resolved", 12.0, 5.0, ["lcm_pill"])
    untimed = passages.drop("t").withColumn("locator", F.concat(F.lit("p"), F.col("seq"), F.lit(".0")))
    assert extraction.episodes(untimed, extraction.events(untimed)).where("passage_id = 0").first()["outcome"] == "unknown"


def test_vector_search_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, e array<double>")
    found = search.vector_top(df.where("id % 10 = 0"), df, 5, "id", "e", block=3).collect()
    for q in range(0, 120, 10):
        s = np.round(v @ v[q], 6)
        s[q] = -np.inf
        wanted = sorted(range(120), key=lambda i: (-s[i], i))[:5]
        assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == wanted


def test_quotes_of_any_length_against_brute_force(spark):
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(99, None), (98, "")]
    quotes = [(i, docs[i][1][rng.randint(0, 9) :][: rng.randint(1, 40)]) for i in range(40)] + [(70, "a"), (71, "ab c"), (72, ""), (73, "zz")]
    found = search.verbatim(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "quote_id long, quote string"), "doc_id", "quote_id")
    assert sorted(tuple(r) for r in found.collect()) == sorted((d, q) for d, t in docs for q, x in quotes if t and x and x in t)


def test_depths_and_actions(spark):
    texts = ["Losses at 1500 m (4921 ft), another 40 m to go.", "Casing at 9 5/8 in set 12,000 ft, 30 m above TD 3700 m", "Rate 30 m/hr, 5 m3 lost", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [[(d["at"], d["md"]) for d in r[0] or []] for r in rows.select(extraction.depths(F.col("text"))).collect()]
    assert found == [[(11, 1500.0)], [(24, 3657.6), (49, 3700.0)], [], []]
    said = rows.limit(1).select(extraction.mentions(F.lit("Reamed and pumped LCM, then POOH."))).first()[0]
    assert [(m["action"], m["said"]) for m in said] == [("lcm_pill", "LCM"), ("pooh", "POOH"), ("ream_backream", "Reamed")]


def test_cusum_and_greedy_folds_over_many_batches(spark):
    import random

    rng = random.Random(4)
    rows = [(k, i, rng.gauss(0, 1.5)) for k in range(3) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        df = spark.createDataFrame(rows, "k long, i long, x double")
        found = {(r["k"], r["i"]): (r["up"], r["down"], r["alarm"]) for r in sequences.cusum(df, "k", ["i"], "x").collect()}
        kept = {(r["k"], r["i"]) for r in sequences.greedy_keep(df, ["k"], "x", ["i"], 0.4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(3):
        up = down = 0.0
        held = []
        for _, i, x in rows[400 * k : 400 * k + 400]:
            up, down = max(0.0, up + x - 0.5), max(0.0, down - x - 0.5)
            alarm = "possible_losses" if down > 5 else "possible_influx" if up > 5 else None
            assert found[k, i] == (up, down, alarm)
            up, down = 0.0 if alarm == "possible_influx" else up, 0.0 if alarm == "possible_losses" else down
            assert ((k, i) in kept) == all(abs(x - h) > 0.4 for h in held)
            held += [x] * ((k, i) in kept)


def test_radius_at_the_poles_and_across_the_meridian(spark):
    import math
    import random

    rng = random.Random(2)
    points = [(i, *rng.choice([(rng.uniform(-90, -89), rng.uniform(-180, 180)), (rng.uniform(79, 81), rng.choice([-1, 1]) * rng.uniform(178, 180)), (rng.uniform(-1, 1), rng.choice([-1, 1]) * rng.uniform(179, 180))])) for i in range(300)]
    df = spark.createDataFrame(points, "well_id long, lat double, lon double")
    found = sorted((r["well_id"], r["well_id_o"]) for r in joins.within_radius(df, df, 30_000.0).collect())

    def metres(a, c):
        p, q, d = math.radians(a[1]), math.radians(c[1]), math.radians(a[2] - c[2])
        return 2 * 6371008.8 * math.asin(math.sqrt(math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2))

    assert found == sorted((a[0], c[0]) for a in points for c in points if a[0] != c[0] and metres(a, c) <= 30_000.0)


def test_rock_names_and_ages(spark):
    from borelog.operators import lithology

    rows = spark.createDataFrame([("Carbonates", "Tipam"), (" SHALE ", "Middle Eocene-Tipam and, later, Miocene"), ("gold", None), (None, "")], "c string, t string")
    found = rows.select(lithology.canonical_class(F.col("c")), lithology.nearest_age(F.col("t"), "Tipam"), lithology.depth_before(F.col("t"), "Tipam")).collect()
    assert [tuple(r) for r in found] == [("limestone", None, None), ("shale", "Middle Eocene", None), (None, None, None), (None, None, None)]


def test_suggestions_keep_to_their_length(spark):
    from borelog.operators import lithology

    rows = spark.createDataFrame([("a", 2, "Sands at 1,200 m and 1300 metres."), ("a", 1, "Salt, then sands."), ("a", 3, None), ("b", 1, "nothing")], "basin string, ref int, text string")
    found = [(r["value"], r["ref"]) for r in lithology.suggestions(rows, ["none"], most=1).collect()]
    assert found == [("salt", 1)] or found == [("sandstone", 1)]
    assert {(r["value"], r["ref"], tuple(r["depths"])) for r in lithology.suggestions(rows.where("ref > 1"), []).collect()} == {("sandstone", 2, ("1,200", "1300"))}
