from pyspark.sql import functions as F

from haulage.operators import tasks as T
from haulage.streaming import jobs as J
from haulage.streaming import notify as G


def _split_events(spark, small, folder, parts):
    """Write the events table as several files into ``folder`` (one call per batch of files)."""
    ev = spark.read.parquet(f"{small}/events.parquet")
    for lo, hi in parts:
        (ev.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1)
           .write.mode("append").parquet(folder))
    return ev


def test_stream_fan_out_equals_batch_with_restart(spark, small, scratch):
    src = scratch + "/events"
    ev = _split_events(spark, small, src, [(0, 300), (300, 600)])
    subs = spark.read.parquet(f"{small}/region.parquet").select(F.col("r_name").alias("subscriber"))
    sink, ck = scratch + "/sink", scratch + "/ck"
    J.notification_stream(spark, src, ev.schema, subs, sink, ck).awaitTermination()
    _split_events(spark, small, src, [(600, 10 ** 9)])          # new files arrive
    J.notification_stream(spark, src, ev.schema, subs, sink, ck).awaitTermination()  # restart
    got = spark.read.parquet(sink).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = G.fan_out(G.messages(ev), subs)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_status_stream_equals_batch(spark, small, scratch):
    src = scratch + "/events"
    ev = _split_events(spark, small, src, [(0, 400), (400, 700), (700, 10 ** 9)])
    sink, ck = scratch + "/sink", scratch + "/ck"
    J.status_stream(spark, src, ev.schema, sink, ck).awaitTermination()
    got = J.read_status_table(spark, sink)
    want = T.latest_status(T.task_events(ev))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _cancels(spark, sink):
    return J.read_ordered(spark, sink).select("task_id", "seq", F.col("ts").cast("timestamp_ntz").alias("ts"), "outcome")


def test_cancel_stream_puts_events_in_order_across_restarts(spark, small, scratch):
    """Rows of Jan 17 arrive after rows up to Jan 20: within the delay they are judged in order, and
    the newest events have their outcome without waiting for newer ones."""
    ev = spark.read.parquet(f"{small}/events.parquet")
    d = {k: F.lit(v).cast("timestamp_ntz") for k, v in
         {"17": "2024-01-17", "18": "2024-01-18", "20": "2024-01-20"}.items()}
    late_rows = (F.col("ts") >= d["17"]) & (F.col("ts") < d["18"])
    first = ev.filter((F.col("ts") < d["20"]) & ~late_rows)
    second = ev.filter(late_rows | (F.col("ts") >= d["20"]))
    src, sink, ck = scratch + "/events", scratch + "/sink", scratch + "/ck"
    first.coalesce(1).write.parquet(src)
    J.cancel_stream(spark, src, ev.schema, sink, ck, delay="5 days").awaitTermination()
    part = T.cancel_outcomes(T.task_events(first))
    assert _cancels(spark, sink).exceptAll(part).count() == 0 and part.exceptAll(_cancels(spark, sink)).count() == 0
    second.coalesce(1).write.mode("append").parquet(src)
    J.cancel_stream(spark, src, ev.schema, sink, ck, delay="5 days").awaitTermination()
    got, want = _cancels(spark, sink), T.cancel_outcomes(T.task_events(ev))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert J.late_events(spark, sink).count() == 0


def test_events_behind_the_watermark_are_kept_apart(spark, scratch):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    src, sink, ck = scratch + "/events", scratch + "/sink", scratch + "/ck"

    def arrive(*rows):
        (spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string")
         .withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src))
        from pyspark.sql.types import _parse_datatype_string
        J.cancel_stream(spark, src, _parse_datatype_string(schema), sink, ck, delay="1 hour").awaitTermination()
        return {(r.seq, r.outcome) for r in _cancels(spark, sink).collect()}

    assert arrive((1, "2024-01-01 00:00:00", 7, "signup"), (2, "2024-01-01 10:00:00", 7, "click")) == {(2, "accepted")}
    # late by ten hours: no outcome, but counted and kept
    assert arrive((3, "2024-01-01 00:30:00", 7, "click")) == {(2, "accepted")}
    assert [r.seq for r in J.late_events(spark, sink).collect()] == [3]
    # late by less than the delay: judged before the event that came first
    assert arrive((4, "2024-01-01 09:30:00", 7, "purchase")) == {(2, "rejected")}
    assert arrive((5, "2024-01-02 00:00:00", 8, "click"), (6, "2024-01-02 00:00:01", 7, "click")) == {
        (2, "rejected"), (5, "not_found"), (6, "rejected")}


def test_failures_recorded_between_batches_apply(spark, scratch):
    from pyspark.sql.types import _parse_datatype_string
    src, sink, ck, bad = (f"{scratch}/{x}" for x in ("events", "sink", "ck", "failures"))
    subs = spark.createDataFrame([("a",), ("b",)], "subscriber string")
    fails = lambda *rows: spark.createDataFrame(rows, "subscriber string, failed_seq long").write.mode("append").parquet(bad)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"

    def arrive(seq):
        (spark.createDataFrame([(seq, "2024-01-01", 1, "view")], "event_id long, ts string, user_id long, event_type string")
         .withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src))
        J.notification_stream(spark, src, _parse_datatype_string(schema), subs, sink, ck, failures=bad).awaitTermination()

    fails(("x", 0))
    arrive(1)
    fails(("b", 2))
    arrive(3)
    assert sorted((r.seq, r.subscriber) for r in spark.read.parquet(sink).collect()) == [(1, "a"), (1, "b"), (3, "a")]
    import pytest
    with pytest.raises(TypeError):
        J.notification_stream(spark, src, _parse_datatype_string(schema), subs, sink, ck, failures=subs)


def test_subscription_stream_equals_batch_across_restarts(spark, small, scratch):
    src = scratch + "/events"
    ev = _split_events(spark, small, src, [(0, 500)])
    sink, ck = scratch + "/sink", scratch + "/ck"
    J.subscription_stream(spark, src, ev.schema, sink, ck).awaitTermination()
    _split_events(spark, small, src, [(500, 10 ** 9)])
    J.subscription_stream(spark, src, ev.schema, sink, ck).awaitTermination()
    got = J.read_active_subscribers(spark, sink)
    want = G.active_subscribers(ev, "user_id", "event_type", "event_id")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_disorder_of_hours_passes_over_several_batches(spark, small, scratch):
    """Judged, waiting and late events are all there, each event once, and together they give what a
    batch over all events gives."""
    from haulage.plans import catalog
    from haulage.streaming import ordered
    schema = catalog._arriving_events(spark, small, f"{scratch}/events")
    sink = f"{scratch}/sink"
    J.cancel_stream(spark, f"{scratch}/events", schema, sink, f"{scratch}/ck", delay=catalog.STREAM_DELAY, max_files_per_trigger=1).awaitTermination()
    ev = T.task_events(spark.read.parquet(f"{small}/events.parquet"))
    passed, late, open_ = (x.select("task_id", "seq") for x in (ordered._written(spark, sink, False), J.late_events(spark, sink), ordered.waiting(spark, sink)))
    assert min(passed.count(), late.count(), open_.count()) > 0
    every = passed.unionByName(late).unionByName(open_)
    assert every.exceptAll(ev.select("task_id", "seq")).count() == 0 and every.count() == ev.count()
    got, want = J.read_recounted(spark, sink).withColumn("ts", F.col("ts").cast("timestamp_ntz")), T.cancel_outcomes(ev)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # without the late ones, too: what the stream itself said is the batch over the other events
    on_time = ev.join(late, ["task_id", "seq"], "left_anti").select(ev.columns)
    got, want = _cancels(spark, sink), T.cancel_outcomes(on_time)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_stopped_stream_goes_on_with_its_state(spark, scratch):
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string("event_id long, ts timestamp_ntz, user_id long, event_type string")
    src, sink, ck = scratch + "/events", scratch + "/sink", scratch + "/ck"

    def arrive(*rows):
        (spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string")
         .withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src))
        J.cancel_stream(spark, src, schema, sink, ck, delay="1 hour", forget="10 days").awaitTermination()
        return {(r.seq, r.outcome) for r in J.read_recounted(spark, sink).collect()}

    assert arrive((1, "2024-01-01 00:00:00", 7, "signup"), (2, "2024-01-01 05:00:00", 7, "click")) == {(2, "accepted")}
    assert arrive((3, "2024-01-01 04:59:00", 7, "error"), (4, "2024-01-01 00:10:00", 7, "click")) == {(2, "rejected"), (4, "accepted")}
    assert arrive((5, "2024-01-05 00:00:00", 7, "click")) == {(2, "rejected"), (4, "accepted"), (5, "rejected")}
    # nothing for ten days: the task is forgotten
    arrive((6, "2024-01-20 00:00:00", 8, "signup"))
    arrive((7, "2024-01-21 00:00:00", 8, "click"))
    from haulage.streaming import ordered
    assert [r.task_id for r in ordered._state(spark, ck, "last", "value").collect()] == [8]
    arrive((8, "2024-01-22 00:00:00", 7, "click"))
    assert {(8, "not_found"), (7, "accepted")} <= {(r.seq, r.outcome) for r in J.read_ordered(spark, sink).collect()}


def test_log_is_folded_as_it_grows(spark, small, scratch):
    """Batches are folded into one row per key; readers see the same before, between and after."""
    import os
    src = scratch + "/events"
    ev = _split_events(spark, small, src, [(k * 150, (k + 1) * 150) for k in range(6)] + [(900, 10 ** 9)])
    want = T.latest_status(T.task_events(ev))
    for sink, every in ((f"{scratch}/folded", 2), (f"{scratch}/plain", None)):
        J.status_stream(spark, src, ev.schema, sink, f"{sink}-ck", max_files_per_trigger=1, compact_every=every).awaitTermination()
        got = J.read_status_table(spark, sink)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    parts = lambda p: sorted(d for d in os.listdir(p.removeprefix("file:")) if d.startswith("batch_id="))
    assert len(parts(f"{scratch}/plain")) == 7 and len(parts(f"{scratch}/folded")) < 4 and J._base(f"{scratch}/folded") == 5
    # a fold that was cut off does not count; batches that a fold covers are not read again
    os.makedirs(f"{scratch}/plain-base/upto-6".removeprefix("file:"))
    assert J._base(f"{scratch}/plain") is None
    J.compact_log(spark, f"{scratch}/plain", "task_id", 3)
    spark.createDataFrame([(1, "stale")], "task_id long, status string").write.parquet(f"{scratch}/plain/batch_id=2")
    got = J.read_status_table(spark, f"{scratch}/plain")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_few_subscribers_need_no_shuffle(spark, small, monkeypatch):
    msgs = G.messages(spark.read.parquet(f"{small}/events.parquet"))
    subs = spark.read.parquet(f"{small}/nation.parquet").select(F.col("n_name").alias("subscriber"), "n_regionkey")
    few = G.fan_out(msgs, subs)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    monkeypatch.setattr(G, "FEW", 3)
    many = G.fan_out(msgs, subs)
    assert few.columns == many.columns and few.exceptAll(many).count() == 0 and few.count() == many.count() == msgs.count() * 25
