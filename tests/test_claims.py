"""The audit's rules on small tables."""

import datetime as dt


from borelog.operators import claims


def test_casing_claims_against_the_nearest_shoe(spark):
    texts = [
        (1, "a", 'Ran 9 5/8" casing and landed it off with shoe at 300 m.'), (1, "b", "The 13 3/8 inch casing was set at 1200 m and the 20in. conductor was cemented at 90.5 m."),
        (1, "c", 'The 9 5/8" liner was run. Set at 900 m.'), (2, "a", '9 5/8" casing set at 300 m'), (3, "x", None),
    ]
    passages = spark.createDataFrame(texts, "well_id long, ref string, text string")
    said = {(r["ref"], r["od_in"], r["md"]) for r in claims.casing_claims(passages.where("well_id = 1")).collect()}
    assert said == {("a", 9.625, 300.0), ("b", 13.375, 1200.0), ("b", 20.0, 90.5)}
    table = spark.createDataFrame([(1, 9.625, 260.0, "t1"), (1, 9.63, 2000.0, "t2"), (1, 13.375, 1195.0, "t3"), (1, 20.0, None, "t4"), (1, 20.02, 10.0, "t5"), (2, 9.6249, 331.0, "t6")], "well_id long, od_in double, shoe_md double, ref string")
    found = {(r["well_id"], r["ref"], r["table_ref"], r["delta"]) for r in claims.casing_conflicts(passages, table).collect()}
    assert found == {(1, "a", "t1", 40.0), (2, "a", "t6", -31.0)}
    agree = spark.createDataFrame([(1, 9.625, 265.0, "t")], "well_id long, od_in double, shoe_md double, ref string")
    assert claims.casing_conflicts(spark.createDataFrame([(1, "r", 'Ran 9 5/8" casing and landed it off with shoe at 260 m.')], "well_id long, ref string, text string"), agree).count() == 0


def test_top_claims_against_the_table(spark):
    texts = [(1, "a", "The top Rijnland Formation was at 1200 m."), (1, "b", "top of the Viking Group came in at 1500.5 m TVD; top Hugin Fm at 2000 m"), (1, "c", "Top Hugin Formation at 2100 m"), (1, "d", "the top Viking Group, thick, encountered at 1700 m")]
    tops = spark.createDataFrame([(1, "RIJNLAND FM", 1150.0, "n1"), (1, "VIKING GP", 1500.0, "n2"), (1, "HUGIN FM", 2005.0, "n3"), (2, "RIJNLAND FM", 1.0, "n4")], "well_id long, formation string, top double, ref string")
    found = {(r["ref"], r["formation"], r["delta"], r["severity"], r["table_ref"]) for r in claims.top_conflicts(spark.createDataFrame(texts, "well_id long, ref string, text string"), tops).collect()}
    assert found == {("a", "RIJNLAND FM", 50.0, "low", "n1"), ("d", "VIKING GP", 200.0, "medium", "n2")}


def test_summaries_against_daily_reports(spark):
    documents = spark.createDataFrame([(1, 10, True), (1, 11, False), (1, 12, False), (2, 20, False)], "well_id long, document_id long, summary boolean")
    events = spark.createDataFrame([(1, "lost_circulation", 2500.0, "e1", 10), (1, "stuck_pipe", 3000.0, "e2", 10), (1, "kick", 1800.0, "e3", 12), (1, "stuck_pipe", 3005.0, "e4", 11), (1, "kick", None, "e5", 10), (2, "kick", 1800.0, "e6", 20)], "well_id long, hazard string, md double, ref string, document_id long")
    found = {(r["hazard"], r["severity"], r["ref"], r["checked_ref"], r["dailies"]) for r in claims.report_conflicts(events, documents).collect()}
    assert found == {("lost_circulation", "medium", "e1", 11, 2), ("kick", "low", "e3", 10, 2)}


def test_shoes_that_differ_between_reports(spark):
    rows = spark.createDataFrame([(1, "Surface", 13.375, 350.0, "d1"), (1, "Surface", 13.375, 350.02, "d2"), (1, "Surface", 13.375, 400.0, "d3"), (1, "Liner", 7.0, 900.0, "d1"), (1, "Liner", 7.0, 900.4, "d2"), (2, "Liner", 7.0, 900.0, "d4"), (2, "Liner", 7.0, 901.0, "d5")], "well_id long, casing_type string, od_in double, shoe_md double, ref string")
    found = {(r["well_id"], r["casing_type"], r["low"], r["high"], r["low_ref"], r["high_ref"], r["severity"]) for r in claims.differing_shoes(rows).collect()}
    assert found == {(1, "Surface", 350.0, 400.0, "d1", "d3", "medium"), (2, "Liner", 900.0, 901.0, "d4", "d5", "low")}


def test_depths_and_losses_against_sensors(spark):
    day = dt.date(2024, 1, 2)
    at = lambda h, m=0: dt.datetime(2024, 1, 2, h, m)
    samples = spark.createDataFrame([(1, at(3), 900.0, 100.0), (1, at(5), 1000.0, 100.0), (1, at(5, 30), None, None), (1, at(7), 2000.0, 90.0), (2, at(1), 500.0, 10.0)], "well_id long, t timestamp, md_m double, pit_vol double")
    reports = spark.createDataFrame([(1, 10, day, 1031.0), (1, 11, day, 1010.0), (1, 12, day, None), (2, 20, day, 900.0)], "well_id long, document_id long, day date, md double")
    found = [tuple(r) for r in claims.depth_conflicts(reports, samples).select("document_id", "sensor", "delta").collect()]
    assert found == [(10, 1000.0, 31.0)]
    pit = [(1, at(10) + dt.timedelta(minutes=10 * i), 50.0, v) for i, v in enumerate([100.0, 103.0, 101.0, 100.0, 99.0, 103.0, 102.0, 101.0, 100.0, 99.5, 99.0, 98.5])]
    pit += [(2, at(10) + dt.timedelta(minutes=10 * i), 50.0, v) for i, v in enumerate([100.0, 99.0, 98.0, 97.0, 96.0, 95.0, 94.0, 93.0, 92.0, 91.0, 90.0])] + [(3, at(10), 1.0, 5.0)]
    rows = spark.createDataFrame(pit, "well_id long, t timestamp, md_m double, pit_vol double")
    losses = spark.createDataFrame([(1, "e1", at(10, 30)), (2, "e2", at(10)), (3, "e3", at(10)), (1, "e4", None)], "well_id long, ref string, t timestamp")
    assert [tuple(r) for r in claims.unseen_losses(losses, rows).collect()] == [(1, "e1", 4.5)]
    assert claims.unseen_losses(losses, rows, drop=4.0).count() == 0
    assert claims.unseen_losses(losses.limit(0), rows).count() == 0
