from pyspark.sql import functions as F

from borelog.functions import geo, stats, text, units


def one(spark, col, **values):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(col.alias("x")).first()["x"]


def test_wilson(spark):
    assert abs(one(spark, stats.wilson_low(F.col("k"), F.col("n")), k=8.0, n=10.0) - 0.4902) < 1e-3
    assert one(spark, stats.wilson_low(F.col("k"), F.col("n")), k=0.0, n=0.0) is None
    low, high = stats.wilson_interval(F.col("k"), F.col("n"))
    assert one(spark, F.struct(low, high), k=0.0, n=0.0) == (0.0, 1.0)


def test_distance_and_similarity(spark):
    d = one(spark, geo.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=58.0, b=2.0, c=59.0, d=2.0)
    assert abs(d - 111195.08) < 1
    s = one(spark, geo.similarity(F.lit(0.0), F.lit(None).cast("double"), F.col("a"), F.lit(None).cast("double")), a=1.0)
    assert abs(s - 0.4) < 1e-12


def test_names_and_numbers(spark):
    assert one(spark, text.canonical_well(F.col("a")), a="NO 25$47$10 - 16 s") == "25/10-16 S"
    assert one(spark, text.display_name(F.col("a")), a="HUGIN FM II") == "Hugin Fm II"
    assert one(spark, text.parent_name(F.col("a")), a="15/9-F-1 SIDETRACK2") == "15/9-F-1"
    assert one(spark, text.inches(F.col("a")), a="13 3/8") == 13.375
    assert one(spark, text.number(F.col("a")), a="-999,25") is None
    assert one(spark, text.number(F.col("a")), a="12,5") == 12.5
    assert one(spark, text.slug(F.col("a")), a=" 25/10-16 S ") == "25-10-16-s"


def test_dates(spark):
    for raw in ("2020-03-01", "01.03.2020", "20200301"):
        assert str(one(spark, text.day_of(F.col("a")), a=raw)) == "2020-03-01"
    assert one(spark, text.day_of(F.col("a")), a="soon") is None


def test_sentences_keep_abbreviations(spark):
    found = one(spark, text.sentences(F.col("a")), a="Losses at ca. 300 m. Pumped pill, e.g. mica! Done?")
    assert found == ["Losses at ca. 300 m.", "Pumped pill, e.g. mica!", "Done?"]


def test_paragraphs(spark):
    html = "<style>p{}</style><p>One&nbsp;<b>two</b></p><script>var t='</p>';</script>three<br/>four &amp; five"
    assert one(spark, text.paragraphs(F.col("a")), a=html) == ["One two", "three", "four & five"]


def test_table_like(spark):
    assert one(spark, text.table_like(F.col("a")), a="a | b | c")
    assert not one(spark, text.table_like(F.col("a")), a="The well was drilled to 2000 m without problems.")


def test_units(spark):
    rows = spark.createDataFrame([(10.0, "ft"), (1.0, "sg"), (2.0, "furlong"), (3.0, None)], "value double, unit string")
    found = {(r["unit"]): (r["converted"], r["to"]) for r in units.convert(rows).collect()}
    assert found["ft"] == (3.048, "m") and abs(found["sg"][0] - 8.345) < 1e-9 and found["furlong"] == (None, None) and found[None] == (None, None)
    assert [r["unit"] for r in units.unknown_units(rows.where("unit is not null")).collect()] == ["furlong"]


def test_beta_quantiles_take_few_steps(monkeypatch):
    import numpy as np

    from borelog.functions import stats

    draw = np.random.default_rng(1)
    a, b = np.exp(draw.uniform(-4, 6, 3000)), np.exp(draw.uniform(-4, 7, 3000))
    plain, looked = stats.beta_cdf, []
    monkeypatch.setattr(stats, "beta_cdf", lambda x, p, q, scale=None: looked.append(len(x)) or plain(x, p, q, scale))
    for level in (0.1, 0.9):
        x = stats.beta_quantiles(level, a, b)
        inside = (x > 1e-300) & (x < 1 - 1e-5)
        assert np.abs(plain(x, a, b) - level)[inside].max() < 1e-9 and inside.mean() > 0.7
    assert sum(looked) < 2 * 3000 * 10
