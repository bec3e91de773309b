"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(df, columns):
    values = df[columns].astype(object).where(df[columns].notna(), None).values.tolist()
    return sorted(map(tuple, values), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


@pytest.mark.parametrize("name", ["hs_detect_score", "hs_detect_pick"])
def test_detection_beyond_its_sample(spark, duck, name, tmp_path):
    """More orders than the sample holds, keys in no order and null among them: the sample is the SQL's."""
    key = "CASE WHEN id % 50 = 7 THEN NULL ELSE (id * 7919) % 70001 END"
    spark.range(70_000).selectExpr(f"{key} AS o_orderkey", "id % 1500 AS o_custkey", "'O' AS o_orderstatus").repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    with duck.cursor() as own:
        own.execute(f"CREATE TEMP VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
        theirs = own.execute(ORACLES[name]).df()
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas(), list(theirs.columns)) == rows(theirs, list(theirs.columns))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    assert entry.entry(spark).count() > 0
