"""Every query of the catalogue against its SQL."""

import math

import duckdb
import pytest

from tickweave.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(got, key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE])
def test_query(spark, db, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*cols).collect()]
    res = db.execute(catalog.ORACLE[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()]
    assert len(got) == len(want) and same(got, want)


@pytest.mark.parametrize("name", ["bocpd_short_run_mass", "engine_fixed", "engine_solo", "chance_recall", "simulated_engine"])
def test_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
