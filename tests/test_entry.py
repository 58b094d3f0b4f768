"""The driver's contract: names, and a few queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and {"p1_found", "p2_found", "title_search_flagship"} <= set(q) and all(callable(f) for f in q.values())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["p2_found", "rating_stats", "exact_title_lookup", "eval_per_query", "judgment_status"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = entry.queries()[name](spark, str(DATA))
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    show = lambda rows, names: sorted(str([round(v, 6) if isinstance(v, float) else v for v in (r[names.index(c)] for c in cols)]) for r in rows)
    assert show([tuple(r) for r in df.collect()], df.columns) == show(rel.fetchall(), rel.columns)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() >= 0
