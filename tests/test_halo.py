"""Windows over cut keys against the plain windows of the same functions."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from haulage.operators import halo as W
from haulage.plans import catalog
from haulage.plans.sql_sweep import SWEEP
from haulage.sources.load import run_sql

ALL = {"rn": W.RowNumber(), "rk": W.Rank(), "dr": W.DenseRank(), "n": W.KeyCount(), "q": W.Ntile(4), "l1": W.Lag("v"), "l3": W.Lag("v", 3),
       "f1": W.Lead("v"), "f2": W.Lead("w", 2), "s3": W.SumRows("v", 3), "s5": W.SumRows("v", 5), "c": W.CountSpan("1 HOUR"), "last": W.LastBefore("w")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, data):
    df = spark.createDataFrame(data, "k int, t long, id long, v double, w string").withColumn("v", F.col("v").cast("decimal(18,2)"))
    return df.withColumn("t", F.timestamp_seconds("t")).repartition(3)


def drawn(seed, n, keys, span, nulls=0.0):
    r = random.Random(seed)
    none = lambda x: None if r.random() < nulls else x
    return [(r.choice(keys), none(r.randrange(span)), k, none(r.randrange(1000) / 4), none(r.choice("abc"))) for k in range(n)]


@pytest.mark.parametrize("data", [
    drawn(1, 400, [7], 50_000),                       # one key on all rows, many slices within one span
    drawn(2, 400, [1, 1, 1, 2, 3, None], 2_000_000),  # a hot key, a null key, spans within a slice
    drawn(3, 300, [1, 2], 600, 0.2),                  # nulls in order and values, peers, one span covers all
    drawn(4, 200, [5], 3),                            # nearly all rows are peers
    drawn(5, 40, list(range(30)), 9000)])             # no large key
@pytest.mark.parametrize("slice_rows", [9, 60])
def test_cut_keys_equal_plain_windows(spark, data, slice_rows):
    df = frame(spark, data)
    for nulls_last in (False, True):
        out = {n: f for n, f in ALL.items() if not (nulls_last and n == "c")}
        got = W.windows(df, ["k"], "t", ["id"], out, nulls_last=nulls_last, slice_rows=slice_rows)
        want = W.windows(df, ["k"], "t", ["id"], out, nulls_last=nulls_last)
        assert got.columns == want.columns == ["k", "t", "id", "v", "w", *out]
        assert rows(got) == rows(want)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 2**20), n=st.integers(30, 120), span=st.sampled_from([20, 5000, 40_000]), slice_rows=st.integers(2, 30))
def test_any_slices(spark, seed, n, span, slice_rows):
    df = frame(spark, drawn(seed, n, [1, 1, 2], span, 0.1))
    assert rows(W.windows(df, ["k"], "t", ["id"], ALL, slice_rows=slice_rows)) == rows(W.windows(df, ["k"], "t", ["id"], ALL))


@pytest.mark.parametrize("name,query,table", [("h6_asof_join", catalog._h6_asof, "events"), ("h10_ranking", catalog._h10_ranking, "customer"),
                                              ("h11_lag_lead", catalog._h11_lag_lead, "events")])
def test_queries_with_one_key_on_all_rows(spark, small, scratch, name, query, table):
    key = {"events": "user_id", "customer": "c_nationkey"}[table]
    spark.read.parquet(f"{small}/{table}.parquet").withColumn(key, F.lit(3)).write.parquet(f"{scratch}/{table}.parquet")
    want = run_sql(spark, SWEEP[name][0], {table: f"{scratch}/{table}.parquet"})
    got = query(spark, scratch, slice_rows=40)
    assert got.columns == want.columns and rows(got) == rows(want)


def test_one_exchange_of_the_rows_and_no_self_join(spark, small):
    plan = catalog.QUERIES["h11_lag_lead"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_unknown_function(spark):
    with pytest.raises(TypeError):
        W.windows(frame(spark, drawn(1, 5, [1], 9)), ["k"], "t", ["id"], {"x": "rank"})
