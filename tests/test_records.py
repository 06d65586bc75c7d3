from borelog.operators import linking, lithology, review


def test_incidents_resolve(spark):
    wells = spark.createDataFrame([(1, "42", "G1", "MC", "10"), (2, None, "G1", "MC", "11"), (3, None, "G2", "MC", "11"), (4, None, "G2", "EW", "5")], "well_id long, api string, lease string, code string, block string")
    asked = [(1, "42", None, None, None), (2, None, "G1", "MC", "11"), (3, None, None, "MC", "11"), (4, None, "G1", None, None), (5, None, "G9", "EW", "5"), (6, None, None, None, None)]
    found = {r["incident_id"]: (r["well_id"], r["method"], r["block_name"]) for r in linking.resolve(spark.createDataFrame(asked, "incident_id long, api string, lease string, code string, block string"), wells).collect()}
    assert found == {1: (1, "number", None), 2: (2, "unique", None), 3: (None, "block", "MC 11"), 4: (None, None, None), 5: (4, "unique", None), 6: (None, None, None)}


def test_area_codes_must_agree(spark):
    wells = spark.createDataFrame([("G1", "MC"), ("G2", "EW")], "lease string, code string")
    incidents = spark.createDataFrame([("Mississippi", "G1"), ("Mississippi", "G1"), ("Both", "G1"), ("Both", "G2")], "area string, lease string")
    assert [tuple(r) for r in linking.area_codes(incidents, wells).collect()] == [("Mississippi", "MC")]


def test_find_or_create(spark):
    wells = spark.createDataFrame([(1, "25/10-16 S"), (2, "B")], "well_id long, name string")
    names = spark.createDataFrame([(2, "other"), (None, "25/10-16 S"), (None, "NO 25/10-16 S"), (None, "new one")], "well_id long, name string")
    found, new = linking.find_or_create(names, wells)
    assert sorted((r["name"], r["well_id"]) for r in found.collect()) == sorted([("other", 2), ("25/10-16 S", 1), ("NO 25/10-16 S", 1), ("new one", None)], key=lambda x: x[0])
    assert [r["canonical"] for r in new.collect()] == ["NEW ONE"]


def test_rocks(spark):
    said = {"Fine sandstone": "sandstone", "Shale and sandstone": "mixed", "Nothing": None, None: None, "Vlieland Claystone Formation": "claystone", "Z2 Carbonate Member": "limestone", "Upper Holland Marl Member": "marl",
            "Z2 Basal Anhydrite Member": "salt", "Ommelanden Formation": None, "Basalt": "basement", "granite": "basement", "Dolomite": "limestone", "Chalk": "chalk", "siltstone": "shale", "Tuff": "mixed"}
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    assert {r["t"]: r["c"] for r in rows.select("t", lithology.rock_class(rows["t"]).alias("c")).collect()} == said
    coded = spark.createDataFrame([("HUGIN FM", "sand"), ("SHETLAND GP", "chalk"), ("Shale", None), ("NO FORMAL NAME", "none")], "t string, code string")
    assert [r[0] for r in coded.select(lithology.rock_class(coded["t"], coded["code"])).collect()] == ["sandstone", "chalk", "shale", None]
    names = {"carbonate": "limestone", "Evaporite": "salt", "granite": "basement", " sandstone": "sandstone", "not-a-rock": None, "mudstone": "shale", "chalk": "chalk"}
    asked = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in asked.select(lithology.canonical_class(asked["n"])).collect()] == list(names.values())


def test_votes_after_each_name(spark):
    def voted(names, *texts):
        return {r["name"]: (r["rock"], r["n"]) for r in lithology.votes(spark.createDataFrame([(t,) for t in texts], "text string"), names).collect()}

    assert voted(["Tipam", "Barail"], "The Tipam is a sandstone. Tipam sandstones hold oil; tipam sandstone.", "Below Tipam there is shale.", "Barail coal", "Shale above Barail") == {"Tipam": ("sandstone", 3), "Barail": ("coal", 1)}
    crowded = "Tipam Sandstone lies on Girujan Clay.", "Tipam sandstone and Kopili shales."
    assert voted(["Tipam", "Girujan", "Kopili"], *crowded) == {"Tipam": ("sandstone", 2), "Girujan": ("claystone", 1), "Kopili": ("shale", 1)}
    assert voted(["A (upper)", "B+"], "In A (upper) there is salt, in B+ coal and marl") == {"A (upper)": ("salt", 1), "B+": ("mixed", 1)}
    assert voted(["Tura"], "Tura limestone " * 7) == {"Tura": ("limestone", 7)}
    assert voted(["Tura", "Tura Sandstone"], "Tura Sandstone is a chalk") == {"Tura Sandstone": ("chalk", 1)}


def test_analogs(spark):
    intervals = spark.createDataFrame([(1, "salt", 100.0, 200.0), (1, "salt", 290.0, 310.0), (2, "salt", 190.1, 260.0), (3, "coal", 100.0, 200.0)], "well_id long, rock string, top double, base double")
    asked = spark.createDataFrame([("salt", 150.0, 200.0)], "rock string, lo double, hi double")
    assert [(r["well_id"], r["weight"], r["intervals"]) for r in lithology.analogs(intervals, asked).collect()] == [(1, 0.5, 1)]


def test_page_states(spark):
    log = spark.createDataFrame([("a", 1, "edit"), ("a", 2, "approve"), ("a", 3, "approve"), ("b", 1, "return"), ("b", 2, "edit")], "slug string, at long, action string")
    assert {r["slug"]: (r["status"], r["version"], r["refused"]) for r in review.page_states(log).collect()} == {"a": ("approved", 1, 1), "b": ("draft", 1, 0)}


def test_decisions(spark):
    events = spark.createDataFrame([("r1", "kick", True), ("r2", "kick", True), ("r3", "kick", True), ("r4", "kick", True)], "source_ref string, hazard string, needs_review boolean")
    log = spark.createDataFrame([(1, "reject", "r1", "kick", None), (2, "confirm", "r1", "kick", None), (3, "reject", "r2", "kick", None), (4, "relabel", "r3", "kick", "fishing"), (5, "confirm", "r9", "kick", None)], "at long, decision string, source_ref string, hazard string, new_hazard string")
    found = {r["source_ref"]: (r["hazard"], r["needs_review"], r["method"]) for r in review.reviewed(events, log).collect()}
    assert found == {"r1": ("kick", False, "human"), "r3": ("fishing", False, "human"), "r4": ("kick", True, None)}
    assert [r["source_ref"] for r in review.stale_decisions(events, log).collect()] == ["r9"]


def test_page_checks(spark):
    pages = spark.createDataFrame([("a", "# Head\n\nLosses at 300 m [^s1].\nNo source here.\n[^s1]: report")], "slug string, text string")
    assert [r["line"] for r in review.uncited_lines(pages).collect()] == ["No source here."]
    sentences = spark.createDataFrame([("a", "Lost 1,200 bbl at 300 m [^s1]."), ("a", "Lost 40 bbl.")], "slug string, sentence string")
    sources = spark.createDataFrame([("a", "lost 1200 bbl at 300 m")], "slug string, text string")
    assert [(r["sentence"], r["numbers"]) for r in review.unsupported_numbers(sentences, sources).collect()] == [("Lost 40 bbl.", [40.0])]


def test_quotes_and_new_texts(spark):
    answers = spark.createDataFrame([("Losses  at 300 m", "losses at 300 m", 0.9), ("Losses", "a kick", 0.9), ("Losses", "Losses", 1.5), ("x", "", 0.5)], "text string, evidence_span string, confidence double")
    assert review.quoted(answers).count() == 1
    passages = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "passage_id long, text string")
    have = review.new_texts(passages.where("passage_id = 1"), spark.createDataFrame([], "text_fp string"))
    assert sorted(r["passage_id"] for r in review.new_texts(passages, have).collect()) == [2, 3]


def test_handover(spark):
    rows = [(1, "kick", "A", "notice", 0.2, 100.0, None), (1, "stuck_pipe", "B", "alert", 0.5, 300.0, "jar")]
    text = review.handover(spark.createDataFrame(rows, "well_id long, hazard string, formation string, level string, mean double, top double, fix string")).first()["text"]
    assert text.split("\n") == ["1. stuck pipe in B from 300 m (alert, 50 %); jar", "2. kick in A from 100 m (notice, 20 %)"]


def test_feedback_joins_records_once(spark):
    records = spark.createDataFrame([(1, "A", "kick")], "well_id long, formation string, hazard string")
    feedback = spark.createDataFrame([(1, "A", "kick", "problem"), (2, "A", "kick", "problem"), (3, "A", "kick", "fine")], "well_id long, formation string, hazard string, verdict string")
    assert sorted(r["well_id"] for r in review.with_feedback(records, feedback).collect()) == [1, 2]
