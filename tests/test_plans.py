"""Plan shapes the scale design relies on (read from the physical plan text)."""

from pyspark.sql import functions as F

from haulage.operators import keyed as D
from haulage.operators import paging as P
from haulage.operators import tasks as T
from haulage.plans import catalog
from haulage.streaming import notify as G


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_projection_and_filters_reach_the_scan(spark, small):
    text = plan(catalog.QUERIES["h1_filter"](spark, small))
    assert "PushedFilters: [IsNotNull(o_totalprice)" in text or "PushedFilters" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string," in text
    flag = plan(catalog.flagship(spark, small))
    assert "c_acctbal" not in flag and "o_orderpriority" not in flag  # pruned columns never read


def test_upsert_is_one_shuffle_of_partial_aggregates(spark, small):
    ev = spark.read.parquet(f"{small}/events.parquet")
    out = plan(D.upsert(ev, ev.limit(50), ["user_id"], "event_id"))
    assert "Join" not in out and out.count("Exchange hashpartitioning(user_id") == 1


def test_aggregations_combine_map_side(spark, small):
    ev = spark.read.parquet(f"{small}/events.parquet")
    for df in (T.latest_status(T.task_events(ev)), D.upsert(None, ev, ["event_type"], "event_id")):
        text = plan(df)
        assert "partial_" in text or text.count("Aggregate") >= 2


def test_numbering_has_no_single_partition_exchange_of_rows(spark, small):
    li = spark.read.parquet(f"{small}/lineitem.parquet")
    text = plan(P.with_page(li, li.columns, 10))
    assert "BroadcastHashJoin" in text
    # the only single-partition step is the per-partition offsets table, which has two columns
    for line in text.splitlines():
        if "SinglePartition" in line:
            assert "l_orderkey" not in line


def test_fan_out_is_an_equi_join_without_hints(spark, small):
    subs = spark.read.parquet(f"{small}/nation.parquet").select(F.col("n_name").alias("subscriber"))
    msgs = G.messages(spark.read.parquet(f"{small}/events.parquet"))
    text = plan(G.fan_out(msgs, subs))
    assert "NestedLoop" not in text and "Cartesian" not in text
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "Broadcast" not in plan(G.fan_out(msgs, subs))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
