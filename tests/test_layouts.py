"""Record layouts and web tables on fixtures, in pieces of any size."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from borelog.operators import pages, scans
from borelog.sources import layouts

PIECES = [1, 2, 3, 1000]


def lines_of(spark, *page_texts, document_id=1):
    rows, seq = [], 0
    for p, text in enumerate(page_texts, 1):
        for line in text.split("\n"):
            rows.append((7, document_id, p, seq, line))
            seq += 1
    return spark.createDataFrame(rows, "well_id long, document_id long, page int, seq long, line string").repartition(3)


def test_scans_in_pieces_of_any_size(spark):
    import random

    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, None, "a", "b"]), rng.choice([0, 1, 2])) for k in ("x", "y") for i in range(60) if rng.random() < 0.9]
    wanted = []
    for k in ("x", "y"):
        last, total = None, 0
        for key, i, v, n in rows:
            if key == k:
                last, total = v or last, total + n
                wanted.append((k, i, last, total))
    df = spark.createDataFrame(rows, "k string, i long, v string, n int")
    for piece in (1, 7, 64, 1000):
        found = scans.scanned(df, ["k"], "i", last={"last": F.col("v")}, total={"upto": F.col("n")}, piece=piece)
        assert sorted((r["k"], r["i"], r["last"], r["upto"]) for r in found.collect()) == wanted


TIMES = (
    "DAILY DRILLING REPORT\n10:00 11:00 1.00 9,000 DRL not in a table\nTIME BREAKDOWN\nFROM TO HRS DEPTH CODE\n06:00 08:30 2.50 5,210 DRL-1 Drill ahead\nto section end X\n08:30 09:00 0.50 5,210 CIRC Circulate, pump fails X\nTOTAL HRS 24\nnot a row",
    "Operations Summary\nFrom To Hrs\ncarried over from page one\n23:00 05:00 6 Production Drilling Trips out from 5,150' to 1,020.5 ' and 12’\n\n05:00 06:00 1.0 no depth here\nComments\n05:00 06:00 1.0 ignored",
)


@pytest.mark.parametrize("piece", PIECES)
def test_time_tables(spark, piece):
    rows = layouts.activities(lines_of(spark, *TIMES), piece)
    found = [tuple(r) for r in rows.select("row", "page", "t0", "t1", "hours", "end_md_ft", "code", "phase", "npt", "md_ft", "text").orderBy("row").collect()]
    assert found == [
        (1, 1, "06:00", "08:30", 2.5, 5210.0, "DRL-1", None, False, 5210.0, "Drill ahead to section end X"),
        (2, 1, "08:30", "09:00", 0.5, 5210.0, "CIRC", None, True, 5210.0, "Circulate, pump fails carried over from page one"),
        (3, 2, "23:00", "05:00", 6.0, None, "Trips", "Production", False, 5150.0, "Production Drilling Trips out from 5,150' to 1,020.5 ' and 12’"),
        (4, 2, "05:00", "06:00", 1.0, None, None, None, False, None, "no depth here"),
    ]
    timed = layouts.clock_times(rows.withColumn("day", F.lit("2021-05-03").cast("date")), "day").orderBy("row").collect()
    assert [(r["t_start"], r["t_end"]) for r in timed] == [(dt.datetime(2021, 5, 2, 6), dt.datetime(2021, 5, 2, 8, 30)), (dt.datetime(2021, 5, 2, 8, 30), dt.datetime(2021, 5, 2, 9)), (dt.datetime(2021, 5, 2, 23), dt.datetime(2021, 5, 3, 5)), (dt.datetime(2021, 5, 3, 5), dt.datetime(2021, 5, 3, 6))]


def test_casing_leak_off_and_mud(spark):
    text = "Surface 13.375 54.5 K-55 1,150 1,149\nLast Casing: 9.625 at 2,172 LOT (lbs/gal): 19.20\nSurface 13.375 K-55 1,150\nLiner 7.0 29 L-80 8,000 7,500 x"
    lines = lines_of(spark, text).unionByName(lines_of(spark, text, document_id=2))
    assert [tuple(r) for r in layouts.casing_rows(lines.where("document_id = 1")).select("type", "od_in", "shoe_ft", "tvd_ft").orderBy("seq").collect()] == [("Surface", 13.375, 1150.0, 1149.0), ("Last casing", 9.625, 2172.0, None)]
    assert [tuple(r) for r in layouts.leak_off_tests(lines).collect()] == [(7, 19.2, 2172.0, 1, "Last Casing: 9.625 at 2,172 LOT (lbs/gal): 19.20")]
    mud = spark.createDataFrame([(1, 1, "TIME MW FV PV\n06:00 9.2 40\nMud Pits, Type: Active\n8.85 300\n12-Jan-20 06:00 10.1 x\n13-Jan-20 06:00 25.0 x"), (2, 1, None)], "document_id long, page int, text string")
    assert sorted(r["mw_ppg"] for r in layouts.mud_weights(mud).collect()) == [8.85, 9.2, 10.1]


LABELLED = (
    "noise before\nDate: 5-Jan-97 Operator: Acme Oil\nInvestigation: Panel Activity: Drilling\nLease: G01234 Event(s): Fire\nArea: EC Operation: Tripping\nBlock: 17 Cause: Human error\nRig/Platform: Rig 9 Water Depth: 120\n"
    "Remarks: The crew was tripping out\nwhen gas reached the floor.\n12\nafter the page number\nDate: 06-FEB-1998 Operator: Other\nRemarks:\nshort\nDate: 31-Feb-99 Operator: Third\nRemarks: This one has remarks long enough.\nGulf of Mexico Region\nnot remarks",
    "continues nothing\nDate: 7/Mar/51 Operator: \nRemarks:\nA record whose remarks begin on the next line.\nCollision No. 3\nLease: X Event(s): Y",
)


@pytest.mark.parametrize("piece", PIECES)
def test_labelled_incidents(spark, piece):
    found = layouts.labelled_incidents(lines_of(spark, *LABELLED), piece).orderBy("page", "record").collect()
    assert [(r["page"], r["record"], r["operator"], r["lease"], r["cause"], r["water_depth"], str(r["day"]), r["remarks"]) for r in found] == [
        (1, 1, "Acme Oil", "G01234", "Human error", "120", "1997-01-05", "The crew was tripping out when gas reached the floor."),
        (1, 3, "Third", None, None, None, "None", "This one has remarks long enough."),
        (2, 1, "", "X", None, None, "1951-03-07", "A record whose remarks begin on the next line."),
    ]


@pytest.mark.parametrize("piece", PIECES)
def test_compact_incidents(spark, piece):
    text = "Main Pass 93-04-21 Fire Explosion Drilling Production 2\nsome words\nRemarks: Gas came up the annulus\nand the well was shut in.\nTOTALS FOR 1993\nnot remarks\nWest Delta 51-12-31 Blowout Loss Workover 0\nremarks:\nThe well blew out for two days.\n33"
    found = layouts.compact_incidents(lines_of(spark, text), piece).orderBy("record").collect()
    assert [(r["record"], r["area"], r["date_raw"], str(r["day"]), r["remarks"]) for r in found] == [
        (1, "Main Pass", "93-04-21", "1993-04-21", "Gas came up the annulus and the well was shut in."),
        (2, "West Delta", "51-12-31", "1951-12-31", "The well blew out for two days."),
    ]


def test_scanned_incidents(spark):
    text = "heading Ship Shoal 07-04-72 Block 29 OCS-G 1234A fire\non deck West Cameron 13-45-80 no such day Mobile 01-02-60 OCS 0345 end"
    found = layouts.scanned_incidents(spark.createDataFrame([(1, 1, text), (2, 1, ""), (3, 1, None)], "document_id long, page int, text string")).orderBy("record").collect()
    assert [(r["record"], r["area"], str(r["day"]), r["block"], r["lease"]) for r in found] == [(1, "Ship Shoal", "1972-07-04", "29", "OCS 1234A"), (2, "West Cameron", "None", "", ""), (3, "Mobile", "1960-01-02", "", "OCS 0345")]
    assert found[0]["remarks"] == "Ship Shoal 07-04-72 Block 29 OCS-G 1234A fire on deck"


HTML = {
    1: "<p>a</p><table><tr><th>Well Name</th><th>Depth(m)</th></tr><tr><td>X&amp;1</td><td> 1,200 <b>m</b></td></tr><tr><td></td><td></td></tr><tr><td>X&amp;1</td><td></td></tr></table>",
    2: "<table><tr><td>out<table><tr><td>in 1</td><td>in 2</td></tr></table>side</td><td>next</td></tr></table><TABLE><tr><td>second",
    3: "</table><table><td>no row<td>not closed<tr><td>row two</table> after <td>stray</td>",
    4: "no table <!-- <table><tr><td>x</td></tr></table> --><script>'<table>'</script>",
    5: None,
}


def test_tables_nested_and_unclosed(spark):
    df = spark.createDataFrame(list(HTML.items()), "id long, html string").withColumn("page", F.lit("x"))
    found = {r["page"]: r["tables"] for r in pages.tables(df, "id", "html").collect()}
    assert found == {
        1: [[["Well Name", "Depth(m)"], ["X&1", "1,200 m"], ["X&1", ""]]],
        2: [[["out side", "next"]], [["in 1", "in 2"]], [["second"]]],
        3: [[["no row", "not closed"], ["row two"]]],
    } or found[3] == [[["no row", "not closed", "row two"]]]
    text = {(r["page"], r["table"], r["row"]): r["text"] for r in pages.titled_rows(pages.tables(df, "id", "html")).collect()}
    assert text[1, 1, 1] == "Well Name: X&1 | Depth(m): 1,200 m" and text[1, 1, 2] == "Well Name: X&1" and text[2, 1, 1] == "out side | next"


def test_body_between_markers(spark):
    html = '<nav>x</nav><div class="c" id="main">A<sup class="reference">[1]</sup>B<table class="wide infobox">gone</table><style>q</style>C[edit]<div id="end">D</div></div>'
    df = spark.createDataFrame([(html,), ("plain <b>page</b>",), (None,)], "h string")
    out = df.select(F.regexp_replace(pages.plain(pages.body(F.col("h"), 'id="main"', ('id="end"', "missing"))), r"\s+", " ").alias("t")).collect()
    assert [r["t"] for r in out] == ["ABC<div ", "plain page ", None]
