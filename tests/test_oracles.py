"""Every core query against its SQL on the smallest data."""

import math
import os
from collections import Counter

import pytest

import kinloom.plans.program_queries  # noqa: F401
from kinloom.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = duck.execute(ORACLES[name])
    at = [x[0] for x in found.description]
    assert sorted(at) == cols
    theirs = Counter(tuple(plain(r[at.index(c)]) for c in cols) for r in found.fetchall())
    assert ours == theirs, (list(ours - theirs)[:2], list(theirs - ours)[:2])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, DATA).columns
    assert QUERIES[name](spark, DATA).count() > 0
