"""Registered queries against their SQL at the smallest size; the larger sizes are compared outside."""

import math

import duckdb
import pytest

from sieveloom.plans import registry

TABLES = ("documents", "master", "tokens", "domains_topics", "domains_formats", "labels", "taxonomy", "keep_targets", "mixtures", "embeddings", "eval_items", "events", "lineitem", "orders", "customer", "part", "supplier", "nation", "region")


#: Queries with a budget that the smallest tables don't hold.
LARGER = {"sel_01_token_budget", "sel_03_quantile_threshold", "sel_05_gumbel_top_k"}


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    return str(v)


def alike(a, b):
    """Equal, floats but for the last of six places: sums are added in another order."""
    if isinstance(a, float) and isinstance(b, float) and not math.isnan(a + b):
        return a == pytest.approx(b, rel=1e-9, abs=1.01e-6)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(alike, a, b))
    return canon(a) == canon(b)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, data, name):
    if name in LARGER:
        data = data.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = registry.QUERIES[name](spark, data)
    want = con.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    order = lambda rows: sorted(rows, key=lambda r: ([canon(x) for x in r if not isinstance(x, float)], [x for x in r if isinstance(x, float) and not math.isnan(x)]))
    got, want = order(tuple(r[c] for c in cols) for r in df.collect()), order(tuple(r[i] for i in at) for r in want.fetchall())
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want) if not alike(a, b)]
    assert not wrong, wrong[:3]


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES) and len(registry.SQL) > 120
