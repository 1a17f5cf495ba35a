"""The registered queries: names, and every query with SQL against DuckDB on the smallest data."""

import datetime
import decimal
import os
from collections import Counter
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def norm(x):
    if isinstance(x, float):
        return "NaN" if x != x else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return int(x) if x == int(x) else float(f"{float(x):.9g}")
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(norm(y) for y in x)
    return x


def registered():
    from tideline.plans import registry

    return registry.queries(), registry.oracle_sql()


def test_names():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 140
    assert {f"p{n}_found" for n in range(1, 6)} <= set(queries)


@here
def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA) if Path(DATA).exists() else []:
        con.sql(f"create view {f.split('.')[0]} as from '{DATA}/{f}'")
    return con


@here
@pytest.mark.parametrize("name", sorted(registered()[1]))
def test_query_equals_sql(spark, duck, name):
    queries, sql = registered()
    df = queries[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(norm(v) for v in r)) for r in df.select(*cols).collect())
    rel = duck.sql(sql[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = Counter(repr(tuple(norm(r[i]) for i in at)) for r in rel.fetchall())
    assert got == want


@here
@pytest.mark.parametrize("name", sorted(set(registered()[0]) - set(registered()[1])))
def test_query_without_sql_runs(spark, name):
    assert registered()[0][name](spark, DATA).count() >= 0


def test_core_doesnt_import_the_subpackage():
    root = Path(__file__).resolve().parent.parent / "tideline"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tideline.llm" not in p.read_text(), p
