import json

from pyspark.sql import functions as F

from borelog.sources import feeds, files, reports


def test_registry_isolates_failures(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,v\n"x, y",1\n')
    tables, errors = files.load_all(spark, {"csv": str(tmp_path / "a.csv"), "feature_json": str(tmp_path / "none.json")})
    assert [tuple(r) for r in tables["csv"].collect()] == [("x, y", "1")] and set(errors) == {"feature_json"}


def test_positional_rejects_odd_rows(spark, tmp_path):
    (tmp_path / "b.txt").write_text('1,"a, b",x\n2,c\n')
    rows, bad = files.positional(spark, str(tmp_path / "b.txt"), ["i", "n", "z"])
    assert [tuple(r) for r in rows.collect()] == [("1", "a, b", "x")] and bad.count() == 1


def test_features(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"features": [{"properties": {"n": "A"}, "geometry": {"coordinates": [2.5, 58.5]}}, {"attributes": {"n": "B"}, "geometry": {"x": 1.0, "y": 2.0}}]}))
    found = files.feature_json(spark, str(tmp_path / "c.json")).collect()
    assert [(r["properties"]["n"], r["lon"], r["lat"]) for r in found] == [("A", 2.5, 58.5), ("B", 1.0, 2.0)]


def test_wells_link_by_canonical_name(spark):
    wells = spark.createDataFrame([(1, "25/10-16 S")], "well_id long, name string")
    rows = spark.createDataFrame([("NO 25/10-16 S",), ("99/1-1",)], "w string")
    linked, rest = files.link_wells(rows, wells, "w")
    assert [r["well_id"] for r in linked.collect()] == [1] and rest.count() == 1


def test_witsml_round_trip(spark):
    rows = spark.createDataFrame([("W1", "2024-01-01T00:00:00Z", 100.0, 5.5), ("W1", "2024-01-01T00:00:05Z", None, 6.0)], "well string, t string, md_m double, torque double").withColumn("t", F.to_timestamp("t"))
    back = feeds.samples(feeds.witsml(feeds.to_witsml(rows, ["md_m", "torque"]))).orderBy("t").collect()
    assert [(r["md_m"], r["torque"]) for r in back] == [(100.0, 5.5), (None, 6.0)]


def test_witsml_units_and_unknown_curves(spark):
    xml = "<logs><log><nameWell>A</nameWell><logData><mnemonicList>TIME,DEPT,XYZ,ROPA</mnemonicList><unitList>s,ft,m,parsec</unitList><data>2024-01-01T00:00:00,10,1,2</data></logData></log></logs>"
    found = feeds.witsml(spark.createDataFrame([(xml,), ("<!DOCTYPE a><log></log>",)], "xml string")).collect()
    assert {(r["channel"], r["value"], r["unknown"]) for r in found} == {("md_m", 3.048, None), (None, None, "XYZ"), ("rop", None, "rop parsec")}


def test_wits0(spark):
    text = "&&\n0105240101\n0106120000\n0110100\n0116x\n!!\nnoise\n&&\n0105240101\n0106120005\n0113 7.5\n!!"
    found = feeds.wits0(spark.createDataFrame([("A", text)], "well string, text string")).orderBy("t").collect()
    assert [(str(r["t"]), r["channel"], r["value"]) for r in found] == [("2024-01-01 12:00:00", "md_m", 100.0), ("2024-01-01 12:00:05", "rop", 7.5)]


def test_wits0_in_both_unit_sets(spark):
    text = "&&\n0105240101\n0106120000\n01101000.0\n01181.0\n0121100\n01141000\n012610\n01302000\n011650\n0199 7\n!!\n"
    payload = spark.createDataFrame([("A", text), ("B", "no records here"), ("C", None)], "well string, text string")
    got = {s: {r["channel"]: round(r["value"], 6) for r in feeds.wits0(payload, unit_set=s).collect()} for s in ("metric", "imperial")}
    assert got["metric"] == {"md_m": 1000.0, "torque": 0.737562, "spp": 14.5038, "hookload": 224.809, "pit_vol": 62.898, "flow_in": 528.344, "wob": 11.24045}
    assert got["imperial"] == {"md_m": 304.8, "torque": 1.0, "spp": 100.0, "hookload": 1000.0, "pit_vol": 10.0, "flow_in": 2000.0, "wob": 50.0}
    assert {r["well"]: r["why"] for r in payload.select("well", feeds.refusal(payload["text"]).alias("why")).collect()} == {"A": None, "B": "no log or record", "C": "empty"}
    assert feeds.wits0(payload, most=0).count() == 0 and payload.select(feeds.refusal(payload["text"], 0)).first()[0] == "too many rows"


def test_units_by_their_usual_names(spark):
    from borelog.functions import units

    rows = spark.createDataFrame([("1000 kgf", 1.0), (" Kft-lbf", 2.0), ("n.m", 1000.0), ("NM", 1000.0), ("rev/min", 3.0), ("galUS/min", 4.0), ("lbf", 1000.0), ("Metres", 5.0), ("furlong", 6.0), (None, 7.0)], "unit string, value double")
    found = [r["converted"] if r["converted"] is None else round(r["converted"], 9) for r in units.convert(rows).collect()]
    assert found == [2.20462, 2.0, 0.737562, 0.737562, 3.0, 4.0, 1.0, 5.0, None, None]


def test_every_curve_of_a_channel(spark):
    names = [(m, c) for c, ms in feeds.CURVES.items() if c != "time" for m in ms]
    xml = "".join(f"<logs><log><nameWell>{m}</nameWell><logData><mnemonicList>INDEX_TIME,{m}</mnemonicList><unitList>s,{u}</unitList><data>2024-01-01T00:00:00Z,2</data></logData></log></logs>" for m, c in names for u in ["psi"])
    found = {r["well"]: (r["channel"], r["value"]) for r in feeds.witsml(spark.createDataFrame([(xml,)], "xml string")).collect()}
    assert found == {m: (c, 2.0) for m, c in names}


def test_timed_lines(spark):
    rows = [(1, "2020-01-01", i, x) for i, x in enumerate(["Header", "22:00 - 24:00 Drilled", "ahead to 500 m.", "00:00 - 05:30: Tripped."])]
    found = reports.timed_lines(spark.createDataFrame(rows, "document_id long, day string, seq long, line string").withColumn("day", F.to_date("day"))).orderBy("activity").collect()
    assert [(str(r["t_start"]), str(r["t_end"]), r["text"]) for r in found] == [("2020-01-01 22:00:00", "2020-01-02 00:00:00", "Drilled ahead to 500 m."), ("2020-01-02 00:00:00", "2020-01-02 05:30:00", "Tripped.")]


def test_pages_split_by_report(spark):
    rows = spark.createDataFrame([(1, 1, "Report for: A"), (1, 2, "more"), (1, 3, "Report for: B")], "document_id long, page long, text string")
    assert [(r["report"], r["part"]) for r in reports.by_report(rows).orderBy("page").collect()] == [("A", 1), ("A", 1), ("B", 2)]


def test_paragraphs_join(spark):
    text = "This is a first line\nthat goes on here.\n\nshort\n\nAnother paragraph of enough length."
    found = spark.createDataFrame([(text,)], "t string").select(reports.joined_paragraphs(F.col("t")).alias("p")).first()["p"]
    assert found == ["This is a first line that goes on here.", "Another paragraph of enough length."]


def test_ocr_and_mud(spark):
    words = spark.createDataFrame([(1, 1, 1, "a", 90.0), (1, 1, 2, " ", 50.0), (1, 1, 3, "b", -1.0), (1, 1, 4, "c", 70.0)], "document_id long, page long, place long, word string, conf double")
    assert tuple(reports.ocr_mean(words).first())[2:] == ("a c", 80.0)
    pages = spark.createDataFrame([(1, "Mud weight: 1.20 sg, later MW 40 ppg")], "document_id long, text string")
    assert [r["mw_ppg"] for r in reports.mud_checks(pages).collect()] == [10.014]


def test_incident_records(spark):
    lines = ["preamble", "Date: 1999-01-01", "Operator: X", "Remarks: The crane", "fell over.", "Date: 1999-02-01"]
    found = reports.incident_records(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "document_id long, seq long, line string")).orderBy("record").collect()
    assert found[0]["fields"] == {"date": "1999-01-01", "operator": "X", "remarks": "The crane fell over."} and len(found) == 2


def test_wits0_round_trip(spark):
    rows = spark.createDataFrame([("A", "2024-01-01 00:00:00", 100.5, None), ("A", "2024-01-01 00:00:05", 101.0, 7.0)], "well string, t string, md_m double, rop double").withColumn("t", F.to_timestamp("t"))
    back = feeds.wits0(feeds.to_wits0(rows, ["md_m", "rop"])).orderBy("t", "channel").collect()
    assert [(r["channel"], r["value"]) for r in back] == [("md_m", 100.5), ("md_m", 101.0), ("rop", 7.0)]


def test_long_wells_leave_in_chunks(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1000).select(F.when(F.col("id") < 900, "A").otherwise("B").alias("well"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("t"), (100.0 + F.col("id")).alias("md_m"), (F.col("id") * 0.5).alias("spp"))
    for unit_set in ("metric", "imperial"):
        posts = feeds.to_wits0(rows, ["md_m", "spp"], unit_set, rows_each=70)
        sizes = [r["text"].count("&&") for r in posts.collect()]
        assert max(sizes) <= 70 and sum(sizes) == 1000
        back = feeds.samples(feeds.wits0(posts, unit_set=unit_set)).select("well", "t", F.round("md_m", 6).alias("md_m"), F.round("spp", 6).alias("spp"))
        assert sorted(back.collect()) == sorted(rows.collect())
    logs = feeds.to_witsml(rows, ["md_m", "spp"], rows_each=64)
    assert max(r["xml"].count("<data>") for r in logs.collect()) <= 64
    assert sorted(feeds.samples(feeds.witsml(logs)).select("well", "t", "md_m", "spp").collect()) == sorted(rows.collect())
    order = [(r["well"], r["chunk"], r["xml"].split("<data>")[1][:20]) for r in logs.collect()]
    assert sorted(order) == sorted(order, key=lambda x: (x[0], x[2]))
