"""Every query with SQL gives the same rows as DuckDB; results don't depend on the number of partitions."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

ORACLE = entry.oracle_sql()
CORE = [k for k in ORACLE if not k.startswith("p")]


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 5) + 0.0
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", CORE)
def test_against_sql(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    got = df.collect()
    cur = duck.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, cur.fetchall())


@pytest.mark.parametrize("name", ["flagship_rl_step", "e2_pass_at_k", "l10_utilisation", "i8_family_split", "c11_rollout_ids", "e27_spearman_overall", "j4_j6_schedule", "h10_bm25"])
def test_partitioning_does_not_matter(spark, sf, name):
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = entry.queries()[name](spark, sf)
            seen.append(rows(df.columns, df.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE) <= set(entry.queries())
