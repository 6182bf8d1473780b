"""Every query with SQL gives DuckDB's rows on the smallest driver tables; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

from tarnwork import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = [x.removesuffix(".parquet") for x in os.listdir(DATA)] if os.path.isdir(DATA) else []
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in TABLES:
        con.execute(f"create view {n} as select * from '{DATA}/{n}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
        return "N"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else repr(round(x, 9))
    return str(x.tolist() if hasattr(x, "tolist") else x)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        assert rows(got) == rows(duck.sql(sql).df())
    else:
        assert len(got)


def test_stream_equals_batch(spark):
    batch = catalogue._current(spark, DATA).selectExpr("cast(run_id as string) run_id", "state", "error_code", "cast(sequence as bigint) sequence", "attempts").collect()
    stream = catalogue.queries()["run_state_stream"](spark, DATA).collect()
    assert set(map(tuple, batch)) == set(map(tuple, stream)) and len(batch) == len(stream)


def test_bands_are_among_the_exhaustive_pairs(spark):
    q = catalogue.queries()
    pairs = lambda n: {(r["lab_id"], r["first_id"], r["second_id"]) for r in q[n](spark, DATA).collect()}
    lsh, every = pairs("lsh_candidates"), pairs("similarity_candidates")
    assert lsh <= every and len(lsh) >= 0.9 * len(every)


def test_no_shingle_is_sorted_for_a_join(spark):
    """Texts meet their rows before they are cut: in the plan every regex of tokens stands above the join."""
    plan = catalogue.entities(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and plan.rindex("regexp_extract_all") < plan.index("Join LeftOuter")
