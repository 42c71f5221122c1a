"""Every catalogue query against its oracle on the smallest tables, where they are."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def norm(v):
    return None if v is None else round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else str(v) if hasattr(v, "isoformat") else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = [tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_text_passes_the_join_of_loyalty(spark):
    """Keywords are counted below the join with the events: what is shuffled is a few numbers a row."""
    nodes, wide = [catalogue.queries()["loyalty_scores"](spark, str(DATA))._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            wide += [side.output().apply(i).name() for side in below for i in range(side.output().size())]
        nodes += below
    assert "doc_id" in wide and "text" not in wide
