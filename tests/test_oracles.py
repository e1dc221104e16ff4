"""Every query with an SQL counterpart gives its rows, on the smallest tables; the others run."""

import os

import duckdb
import numpy as np
import pytest

from corvane.plans import analytics, indexing, search, streams

PLANS = (indexing, search, analytics, streams)


def plain(v):
    if v is None or (isinstance(v, float) and np.isnan(v)) or str(v) in ("<NA>", "NaT"):
        return "-"
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in (v.filled(None) if isinstance(v, np.ma.MaskedArray) else v)])
    if isinstance(v, (float, np.floating)):
        return f"{float(v) + 0.0:.5f}"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return f"{float(v):.5f}"
    return str(v)


def rows(frame):
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", [k for p in PLANS for k in p.QUERIES])
def test_query(spark, duck, data, name):
    plan = next(p for p in PLANS if name in p.QUERIES)
    got = plan.QUERIES[name](spark, data).toPandas()
    if name in plan.SQL:
        want = duck.execute(plan.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def test_entry_and_names(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
