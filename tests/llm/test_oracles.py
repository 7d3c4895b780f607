import duckdb
import pytest

from tidemark.llm.oracles import oracle_sql
from tidemark.llm.queries import queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, df = db.sql(oracle_sql()[name]), queries()[name](spark, sf)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    plain = lambda r: tuple(round(x, 3) if isinstance(x, float) else x for x in r)
    got = sorted((plain(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted((plain(r) for r in want.select(*columns).fetchall()), key=repr)
