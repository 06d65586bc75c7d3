"""Every query that has SQL gives the same rows in Spark and in DuckDB."""

import math

import duckdb
import pytest

from borelog.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def in_order(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    found = in_order(df.select(*cols).collect())
    result = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    wanted = in_order([[r[i] for i in at] for r in result.fetchall()])
    assert found == wanted


def test_entry_has_queries():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sentences(spark, sf_dir):
    rows = registry.queries()["sentences"](spark, sf_dir)
    assert rows.count() > 1000 and rows.where("sentence = ''").count() == 0


def test_credible_intervals_hold_their_share(spark, sf_dir):
    import numpy as np

    from borelog.functions.stats import beta_cdf, beta_quantiles

    a, b = np.array([1.0, 2.0, 0.5, 0.02]), np.array([1.0, 1.0, 3.0, 2.0])
    for q in (0.1, 0.5, 0.9):
        x = beta_quantiles(q, a, b)
        assert np.allclose(beta_cdf(x, a, b), q, atol=1e-9)
        assert np.allclose(x[:2], q ** (1 / a[:2]))
        assert np.allclose(x, 1 - beta_quantiles(1 - q, b, a), atol=1e-9)
