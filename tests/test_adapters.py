"""Registers' raw rows as wells and their records, over small landed fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from borelog.sources import adapters as a


def raw(spark, rows):
    """Raw rows as dicts; ``lon`` and ``lat`` are the geometry."""
    data = [({k: None if v is None else str(v) for k, v in r.items() if k not in ("lon", "lat")}, r.get("lon"), r.get("lat")) for r in rows]
    return spark.createDataFrame(data, "p map<string,string>, lon double, lat double")


def by_name(df):
    return {r["name"]: r for r in df.where("rejected is null").collect()}


@pytest.fixture(scope="module")
def norway(spark):
    return spark.createDataFrame([(1, "25/10-16 S", 3000.0, 25.0)], "well_id long, name string, td_m double, kb_m double")


@pytest.mark.parametrize("source", sorted(a.REGISTERS))
def test_empty_and_blank_rows(spark, source):
    assert a.headers(raw(spark, []), a.REGISTERS[source]).count() == 0
    found = a.headers(raw(spark, [{}, {"x": None}]), a.REGISTERS[source]).collect()
    assert [r["rejected"] for r in found] == ["no name", "no name"]


def test_norway(spark, norway):
    rows = [
        {"wlbWellboreName": "25/10-16 S", "wlbNpdidWellbore": 7, "wlbNsDecDeg": "59,1", "wlbEwDecDeg": "2.5", "wlbEntryDate": "05.03.2019", "wlbTotalDepth": "3000", "wlbWell": "25/10-16", "wlbField": ""},
        {"wlbWellboreName": "25/10-16  S", "wlbNpdidWellbore": 8},
    ]
    found = a.headers(raw(spark, rows), a.SODIR)
    (name, well), = by_name(found).items()
    assert name == "25/10-16 S" and (well["lat"], well["lon"], well["td_m"]) == (59.1, 2.5, 3000.0)
    assert well["spud"] == datetime.date(2019, 3, 5) and well["parent"] == "25/10-16" and well["field"] is None
    assert found.where("rejected = 'same name'").count() == 1


def test_norwegian_records(spark, norway):
    n = {"wlbName": "NO 25/10-16 S"}
    tops = a.sodir_tops(raw(spark, [n | {"lsuLevel": "FORMATION", "lsuName": "UTSIRA FM ", "lsuNameParent": "NORDLAND GP", "lsuTopDepth": "900", "lsuBottomDepth": "1000"}, n | {"lsuLevel": "MEMBER", "lsuName": "X"}, {"wlbName": "1/1-1", "lsuLevel": "GROUP", "lsuName": "Y"}]), norway)
    assert {tuple(r) for r in tops.collect()} == {(1, "UTSIRA FM", "FORMATION", "NORDLAND GP", 900.0, 1000.0, None), (None, "Y", "GROUP", "Y", None, None, "no well")}
    rows = raw(spark, [n | {"wlbCasingType": "SURF", "wlbCasingDiameter": "13 3/8", "wlbCasingDepth": "1200", "wlbFormationTestType": "FIT", "wlbLotMudDencity": "1.5"}, n | {"wlbCasingDepth": "3500", "wlbFormationTestType": "LOT", "wlbLotMudDencity": "4"}, n | {"wlbFormationTestType": "LOT", "wlbLotMudDencity": "0.00"}])
    casing = a.sodir_casing(rows, norway).orderBy(F.col("od_in").desc_nulls_last(), "shoe").collect()
    assert (casing[0]["od_in"], casing[0]["shoe"]) == (13.375, 1200.0) and all(r["shoe"] is None for r in casing[1:])
    assert sorted((r["kind"], r["emw_ppg"], r["rejected"] or "") for r in a.sodir_tests(rows, norway).collect()) == [("FIT", 12.52, ""), ("LOT", 33.38, "out of range")]
    mud = raw(spark, [n | {"wlbMD": d, "wlbMudWeightAtMD": w} for d, w in (("100", "1.2"), ("100", "5"), ("9000", "1.2"), (None, "1.2"))])
    assert sorted((r["md"], r["mw_ppg"], r["rejected"] or "") for r in a.sodir_mud(mud, norway).collect()) == [(100.0, 10.01, ""), (100.0, 41.73, "mud weight"), (9000.0, 10.01, "depth")]


def test_united_kingdom(spark):
    rows = [
        {"WELLREGNO": "14/29a- 3", "TOPHOLEDTM": "WGS84", "TOPHOLEXDD": "1.5", "TOPHOLEYDD": "58", "TDMDDEPF": "10000", "SPUDDATE": -86400000, "WELLBRSTAT": "No Data Available", "WELLOPSTAT": "P&A"},
        {"WELLREGNO": "21/10-1", "TOPHOLEDTM": "WGS84", "TOPHOLEXDD": "55", "TOPHOLEYDD": "58"},
        {"WELLREGNO": "21/10-2", "TOPHOLEDTM": "ED50", "TOPHOLEXDD": "1", "TOPHOLEYDD": "58"},
    ]
    found = by_name(a.headers(raw(spark, rows), a.NSTA))
    w = found["GB: 14/29a-3"]
    assert (w["lon"], w["td_m"], w["spud"], w["status"]) == (1.5, pytest.approx(3048.0), datetime.date(1969, 12, 31), "P&A")
    assert found["GB: 21/10-1"]["lon"] is None and found["GB: 21/10-2"]["lat"] is None
    wells = spark.createDataFrame([(5, "GB: 14/29a-3", None, None)], "well_id long, name string, td_m double, kb_m double")
    tops = a.nsta_tops(raw(spark, [{"WELLREGNO": "14/29a-3", "R1_NAME": "Piper", "R1_AGE": "Jurassic", "R1_ROCK": "Sandstone", "R3_NAME": "Zechstein"}]), wells)
    assert {tuple(r) for r in tops.collect()} == {(5, "Piper (Jurassic)", "Sandstone", 1, None), (5, "Zechstein", None, 3, None)}


def test_netherlands(spark):
    w = by_name(a.headers(raw(spark, [{"boreholeName": "L09-FF-104A", "nitgNr": "B1", "blockCd": "L09", "onOffshore": "OFF", "longitudeWgs84": "4.1", "latitudeWgs84": "53.2"}]), a.NLOG))["NL: L09-FF-104A"]
    assert (w["field"], w["well_type"], w["parent"], w["external_id"]) == ("Block L09", "offshore", "NL: L09-FF-104", "B1")
    wells = spark.createDataFrame([(1, "NL: A-1", "B1", None, 30.0), (2, "NL: A-2", "B2", None, None)], "well_id long, name string, external_id string, td_m double, kb_m double")
    rows = [{"NITG_NR": "B1", "WELLBORE": "other", "STRAT_UNIT_NM": "Chalk Group", "TOP_AH": "1256,26", "BOTTOM_AH": "1300", "TV_TOP_NAP": "1200"}, {"WELLBORE": "A-2", "STRAT_UNIT_NM": "X Member"}, {"WELLBORE": "A-9", "STRAT_UNIT_NM": "Y"}, {"WELLBORE": "A-2", "STRAT_UNIT_NM": "Not interpreted"}]
    assert {tuple(r) for r in a.nlog_tops(raw(spark, rows), wells).collect()} == {(1, "Chalk Group", "GROUP", 1256.26, 1300.0, 1230.0, None), (2, "X Member", "MEMBER", None, None, None, None), (None, "Y", "FORMATION", None, None, None, "no well")}


def test_rows_of_one_name_are_told_apart(spark):
    rows = [{"FullName": "Maui 1", "PBWellID": i, "TotalMD": "1000", "TotMDunit": u} for i, u in ((1, "ft"), (2, "m"), (2, "m"))]
    found = by_name(a.headers(raw(spark, rows), a.NZPAM))
    assert {n: r["td_m"] for n, r in found.items()} == {"NZ: Maui 1": pytest.approx(304.8), "NZ: Maui 1 (2)": 1000.0}


def test_canada(spark):
    w = by_name(a.headers(raw(spark, [{"Well_Name": "Sable", "Well_Nam_1": "C-67", "Spud_Date": "7-Jun-67", "Total_Dept": "4600", "lon": -60.0, "lat": 44.0}]), a.CNSOPB))["CA: Sable C-67"]
    assert (w["spud"], w["lon"], w["td_m"]) == (datetime.date(1967, 6, 7), -60.0, 4600.0)
    w = by_name(a.headers(raw(spark, [{"Wellname": "Hibernia", "UWI": "300", "TotDpthMD": "3657.6m", "SpudDate": "May 27, 1979"}]), a.CNLOPB))["CA: Hibernia"]
    assert (w["td_m"], w["spud"]) == (3657.6, datetime.date(1979, 5, 27))
    w = by_name(a.headers(raw(spark, [{"LEGACYWELLNAME": "Acme", "WELL_CWI": "SK1", "WELLLICENCEBUSINESSASSOCIATE": "Acme Oil [123]"}]), a.SASK))["CA: Acme"]
    assert w["operator"] == "Acme Oil"


def test_boreholes_need_a_place(spark):
    row = {f"c{i}": "" for i in range(29)} | {"c0": "177", "c8": "1000", "c5": "19900203", "c20": "-90.5", "c21": "28.1", "c28": "DIR"}
    found = a.headers(raw(spark, [row, row | {"c0": "178", "c20": "x"}, row | {"c0": "API"}]), a.BSEE)
    w = by_name(found)["US: 177"]
    assert (w["td_m"], w["spud"], w["well_type"]) == (304.8, datetime.date(1990, 2, 3), "directional")
    assert sorted(r["rejected"] for r in found.collect() if r["rejected"]) == ["no name", "no place"]


def test_logs(spark):
    rows = [("15/9-1", float(d), 30000.0 if d < 20 or d >= 22 else 65000.0, 12.0 if 5 <= d <= 12 else 8.6, 8.5) for d in range(40)]
    df = spark.createDataFrame(rows, "WELL string, DEPTH_MD double, FORCE_2020_LITHOFACIES_LITHOLOGY double, CALI double, BS double")
    assert [(r["top"], r["base"], r["rock"]) for r in a.labelled_logs(df).collect()] == [(0.0, 39.0, "Sandstone")]
    (span,) = a.washouts(df).collect()
    assert (span["top"], span["base"], span["lo"], span["hi"]) == (5.0, 12.0, 3.5, 3.5) and span["text"].startswith("Caliper exceeds bit size by 3.5–3.5 in from 5.0 to 12.0 m")


def test_daily_reports(spark):
    text = "00:00 - 06:00: Drilled to 2750 m\n06:00 - 24:00: Circulated"
    df = spark.createDataFrame([("Summary for well 15/9-F-1 on 2010-02-03", text)] * 2 + [("no head", text)], "instruction string, input string")
    found = a.daily_reports(df).collect()
    assert len(found) == 2 and {r["well"] for r in found} == {"15/9-F-1"} and {r["text"] for r in found} == {"Drilled to 2750 m", "Circulated"}
