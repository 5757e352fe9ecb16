"""Registered queries against their DuckDB oracle on the smallest test folder (same check as the driver)."""

import math
import os

import pytest

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "<null>"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "<null>" if math.isnan(v) else repr(v)
    return str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_small}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _sql_queries():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


@pytest.mark.parametrize("name", _sql_queries())
def test_query_matches_oracle(spark, duck, sf_small, name):
    import __spark_entry__ as E
    sdf = E.queries()[name](spark, sf_small).toPandas()
    odf = duck.execute(E.oracle_sql()[name]).df()
    sc, sr = _rows(sdf)
    oc, orows = _rows(odf)
    assert sc == oc
    assert len(sr) == len(orows)
    assert sr == orows


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert {r["ers_status"] for r in rows} == {"NORMAL", "ALERTA", "CRÍTICO"}
    assert df.columns == ["ers_status", "n", "level_order"]


def test_every_query_has_a_docstring():
    import __spark_entry__ as E
    for name, fn in E.queries().items():
        assert fn.__doc__, name
