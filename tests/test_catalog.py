"""Every query of the catalog against its SQL."""

import datetime as dt
import math
import os

import duckdb
import pytest

from tidemark.operators import scorecard
from tidemark.plans import catalog, oracle

TABLES = "region nation customer supplier part orders lineitem events".split()
SMALL = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat()[:10] if hasattr(v, "isoformat") else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_against_sql(spark, db, name):
    df = catalog.queries()[name](spark, SMALL)
    got = df.collect()
    want = db.sql(oracle.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert {c: KINDS[t] for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    assert got, name


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(oracle.oracle_sql())))
def test_others_run(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0


def test_scorecard_shows_the_newest_years(spark, db):
    years = [str(y) for (y,) in db.sql("SELECT DISTINCT year(o_orderdate::DATE) FROM orders ORDER BY 1").fetchall()][1:]
    assert sorted(catalog.queries()["scorecard_newest_years"](spark, SMALL).columns) == sorted(["sym", *years[-8:]])
    rows = spark.createDataFrame([("A", dt.date(y, 6, 1), float(y - 2000)) for y in range(2001, 2015)], "sym string, d date, close double")
    shown = scorecard.scorecard(rows, "year")
    assert sorted(shown.columns) == [*map(str, range(2007, 2015)), "sym"] and shown.first()["2014"] == 7.69


def test_highs_at_the_references_tolerance(spark, db):
    near = db.sql(f"{oracle.HEAD} SELECT count(*) FROM (SELECT arg_max(close, d) AS c, max(close) AS hi FROM sector GROUP BY sym) WHERE c >= hi * (1 - 0.0005)").fetchall()[0][0]
    assert catalog.queries()["ath_tolerance_default"](spark, SMALL).first()["n_high"] == near
