"""The driver's contract: names, twins, and a run of the core queries on the smallest data."""

import os

import pytest

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables aren't here")


def test_every_twin_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_core_queries_match_their_twins(spark):
    duckdb = pytest.importorskip("duckdb")
    import numpy as np

    from marlspike.plans import catalogue

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")

    def rows(df):
        cell = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, (float, np.floating)) else x.item() if isinstance(x, np.generic) else x
        return sorted(tuple(repr(cell(x)) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))

    wrong = []
    for name, text in catalogue.ORACLES.items():
        ours, theirs = catalogue.QUERIES[name](spark, SMALL).toPandas(), con.execute(text).df()
        if sorted(ours.columns) != sorted(theirs.columns) or rows(ours) != rows(theirs):
            wrong.append(name)
    assert not wrong
