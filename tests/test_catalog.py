"""Every query against its SQL on the small tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from tesselode.plans.catalog import QUERIES, SQL  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(rows):
    def one(v):
        if hasattr(v, "tzinfo") and v is not None:
            return v.replace(tzinfo=None).isoformat()
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        x = float(v)
        return "0" if x == 0 else f"{x:.6g}" if math.isfinite(x) else str(x)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = norm(tuple(r[c] for c in cols) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = norm(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
    assert got == want, (got[:3], want[:3], len(got), len(want))
    assert want


def test_queries_without_sql_run(spark, sf):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, sf).count() > 0
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
