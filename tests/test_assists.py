import datetime as dt

import numpy as np

from borelog.operators import lithology, questions, search
from borelog.sources import files
from borelog.streaming import detector


def test_the_longest_name_is_taken(spark):
    entities = spark.createDataFrame([("well", "1", "25/10-16 S"), ("well", "2", "25/10-16"), ("basin", "3", "East"), ("basin", "4", "Middle East"), ("field", "5", "East"), ("none", "6", " ?! ")], "kind string, id string, name string")
    asked = [(1, "Losses in 25/10-16 s, Middle East?"), (2, "25/10-16 in the EAST"), (3, "Middle-aged"), (4, ""), (5, None), (6, "25/10-16 25/10-16 S")]
    rows = spark.createDataFrame(asked, "q long, text string")
    found = {r["q"]: ([x["id"] for x in r["names"]], r["hazards"], r["intents"]) for r in questions.parse(rows, entities, "q").collect()}
    assert found[1] == (["1", "4"], ["lost_circulation"], []) and found[2] == (["2", "3", "5"], [], [])
    assert found[3] == found[4] == found[5] == ([], [], []) and found[6][0] == ["2", "1"]
    assert [r["names"] for r in questions.named(rows, entities.where("false"), "q").collect()] == [None] * 6


def test_best_of_others_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 4), rng.normal(size=5).round(3).tolist()) for i in range(60)] + [(90, 1, [0.0] * 5), (91, 1, None)]
    table = spark.createDataFrame(rows, "id long, well_id long, v array<double>")
    library = table.where("id % 3 = 0")
    found = {r["id"]: r["best"] for r in search.best_of_others(table, library, block=7).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows[:60]}
    assert found == {i: round(max(float(unit[i] @ unit[j]) for j, w2, _ in rows[:60] if j % 3 == 0 and w2 != w), 6) for i, w, _ in rows[:60]}
    assert search.best_of_others(table, library.where("false")).count() == 0
    some = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("b", 1.0)], "g string, x double")
    shares = sorted(tuple(r) for r in search.share_below(some, some.distinct(), "g", "x").collect())
    assert shares == [("a", 1.0, 0.0), ("a", 3.0, 2 / 3), ("b", 1.0, 0.0)]


def test_anomalies_escalate(spark):
    layers = spark.createDataFrame([(1, "A", 100.0, 200.0, "stuck_pipe", 0.1, "ok", 1), (1, "B", 200.0, None, "stuck_pipe", 0.9, "ok", 2), (1, "A", 100.0, 200.0, "kick", 0.1, "ok", 0)], "well_id long, formation string, top double, base double, hazard string, mean double, status string, n_with int")
    t = dt.datetime(2024, 1, 1)
    samples = spark.createDataFrame([(1, t, 150.0, ["torque"], None), (1, t, 160.0, None, None), (1, t, 900.0, [], "possible_losses")], "well_id long, t timestamp, md_m double, channels array<string>, signal string")
    found = {(r["md_m"], r["formation"], r["level"]) for r in detector.look_ahead(samples, layers).collect()}
    assert found == {(150.0, "A", "escalated"), (150.0, "B", "alert"), (160.0, "A", "notice"), (160.0, "B", "alert"), (900.0, "B", "alert")}


def test_analog_posterior(spark):
    weights = spark.createDataFrame([("salt", 1, 1.0), ("salt", 2, 0.5), ("salt", 3, 0.0)], "rock string, well_id long, weight double")
    base = spark.createDataFrame([("kick", 0.1), ("fishing", 0.2)], "hazard string, base double")
    found = {r["hazard"]: r for r in lithology.analog_posterior(weights, spark.createDataFrame([(2, "kick"), (3, "kick")], "well_id long, hazard string"), base, ["rock"]).collect()}
    kick, fishing = found["kick"], found["fishing"]
    assert (kick["n_wells"], kick["n_with"], kick["status"]) == (2, 1, "insufficient_evidence") and fishing["n_with"] == 0
    assert abs(kick["mean"] - (2 + 0.5) / 21.5) < 1e-12 and abs(kick["n_eff"] - 1.5**2 / 1.25) < 1e-12 and abs(fishing["mean"] - 4 / 21.5) < 1e-12


def test_columns_out_of_nothing(spark):
    none = spark.createDataFrame([], "document_id long, ref long, text string")
    assert [tuple(r) for r in lithology.column(none, ["Tipam"]).collect()] == [("Tipam", 0, 0, None, None, [])]
    rows = spark.createDataFrame([(1, 1, "At 2,100 m Tipam sandstone of Miocene age."), (1, 2, None), (2, 1, "")], none.schema)
    assert [tuple(r) for r in lithology.column(rows, ["Tipam"]).collect()] == [("Tipam", 1, 1, "sandstone", "Miocene", [2100.0])]


def test_surveys(spark, tmp_path):
    (tmp_path / "a.csv").write_text("no,md,inc,azi,tvd,ns,ew\n1,\"1,100.5\",1,2,1100,3,-4\n2,1200,1,2,1199,3,-5\n3,1200,1,2,1199,3,-5\n4,x,1,2,3,4,5\n")
    assert [tuple(r) for r in files.survey_csv(spark, str(tmp_path / "a.csv"), 7).orderBy("md").collect()] == [(7, 1100.5, 1.0, 2.0, 1100.0, 3.0, -4.0), (7, 1200.0, 1.0, 2.0, 1199.0, 3.0, -5.0)]
    (tmp_path / "a.txt").write_text("Survey report\n MD INC\n 100.0 1.0 2.0 99.0 0 3.5 0 -4.5 0 0 0\n 200 1\n\n 300 1 2 299 0 4 0 -5 0 0 0 note\n")
    assert [tuple(r) for r in files.survey_text(spark, str(tmp_path / "a.txt"), 8).orderBy("md").collect()] == [(8, 100.0, 1.0, 2.0, 99.0, 3.5, -4.5), (8, 300.0, 1.0, 2.0, 299.0, 4.0, -5.0)]


def test_the_ranker_holds_out_families(spark, sf_dir):
    from borelog.plans import hazards

    scored = hazards.ranker_cv(spark, sf_dir).join(hazards.cells(spark, sf_dir).select("well_id", "formation", "hazard", "family"), ["well_id", "formation", "hazard"]).toPandas()
    assert len(scored) == hazards.cells(spark, sf_dir).count() == len(scored[["well_id", "formation", "hazard"]].drop_duplicates())
    assert scored.groupby("family")["fold"].nunique().max() == 1 and scored["score"].between(0, 1).all() and set(scored["fold"]) == {0, 1, 2}


def test_drawn_intervals_hold_the_area(spark, sf_dir):
    from borelog.plans import hazards, reviews

    lo, hi, draws = reviews.replay_auc_interval(spark, sf_dir).first()
    point = hazards.auc(hazards.cells(spark, sf_dir).withColumn("one", detector.F.lit(1)).withColumn("s", detector.F.round("mean", 8)), ["one"], "s", "y").first()["auc"]
    assert 0 <= lo < hi <= 1 and 40 <= draws == 200 and lo - 0.02 <= point <= hi + 0.02
