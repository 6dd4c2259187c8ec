"""Deliveries to those subscribed at the time, batch and streams, against a plain loop."""

import datetime as dt
import random

from pyspark.sql import functions as F

from haulage.operators import ranges as R
from haulage.streaming import jobs as J
from haulage.streaming import notify as G
from haulage.streaming import subscriptions as U

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"
START = dt.datetime(2024, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def expected(events):
    """(message seq, subscriber) of all messages to all who are subscribed then."""
    out = set()
    for seq, when, _, kind in events:
        if kind not in G.DOWNLOAD_STAGES:
            continue
        for sub in {e[2] for e in events if e[2] is not None}:
            before = [e for e in events if e[2] == sub and e[3] in G.SUBSCRIPTION_ACTIONS and e[1] <= when]
            if before and max(before, key=lambda e: (e[1], e[0]))[3] == "view":
                out.add((seq, sub))
    return out


def drawn(seed, n, hours):
    r = random.Random(seed)
    kinds = ["view", "error", "click", "purchase", "signup"]
    return [(k, at(r.random() * hours), r.randrange(6), r.choice(kinds)) for k in range(n)]


def delivered(df):
    got = [(r.seq, r.subscriber) for r in df.select("seq", "subscriber").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_batch_equals_plain_loop(spark):
    events = drawn(1, 120, 100) + [(500, at(3), 2, "view"), (501, at(3), 2, "error"), (502, at(3), 3, "view"), (503, at(3), None, "view")]
    df = spark.createDataFrame(events, SCHEMA)
    got = U.fan_out_subscribed(G.messages(df.where("user_id IS NOT NULL")), U.subscription_intervals(df))
    assert delivered(got) == expected([e for e in events if e[2] is not None])
    # no action at all
    assert U.fan_out_subscribed(G.messages(df), U.subscription_intervals(df.where("event_type = 'click'"))).count() == 0


def test_streams_equal_batch_across_batches_and_restarts(spark, scratch):
    """Messages come before the piece they belong to is known, and pieces before their messages."""
    events = sorted(drawn(2, 160, 110), key=lambda e: e[1])
    acts, msgs = f"{scratch}/actions", f"{scratch}/messages"
    schema = spark.createDataFrame([], SCHEMA).schema
    put = lambda rows, to: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(to)

    def pieces():
        U.piece_stream(J.event_stream(spark, acts, schema), f"{scratch}/pieces", f"{scratch}/ck-pieces", "2 hours").awaitTermination()

    def deliver():
        U.delivery_stream(G.messages(J.event_stream(spark, msgs, schema)), f"{scratch}/pieces", f"{scratch}/sink", f"{scratch}/ck-sink", "2 hours").awaitTermination()

    cut = [e for e in events if e[1] < at(50)], [e for e in events if e[1] >= at(50)]
    put(cut[0], acts)
    put(cut[0], msgs)
    pieces()
    deliver()                     # the last day's pieces are not known yet: its messages wait in the join
    first = delivered(spark.read.parquet(f"{scratch}/sink"))
    assert first and first < expected(events)
    put(cut[1] + [(900, at(200), None, U.HEARTBEAT)], acts)
    pieces()
    put([cut[1][0]], msgs)
    deliver()
    put(cut[1][1:], msgs)
    deliver()
    assert delivered(spark.read.parquet(f"{scratch}/sink")) == expected(events)
    # behind the watermark: kept apart
    put([(901, at(20), 3, "view")], acts)
    pieces()
    assert [(r.subscriber, r.seq) for r in U.late_actions(spark, f"{scratch}/pieces").collect()] == [(3, 901)]


PER = ["task_id", "seq", "stage"]
TOTALS = {"n": R.Count(), "least": R.Min("subscriber"), "most": R.Max("subscriber"), "total": R.Sum("subscriber")}


def by_message(events):
    subs = {}
    for seq, sub in expected(events):
        subs.setdefault(seq, []).append(sub)
    return {seq: (len(s), min(s), max(s), sum(s)) for seq, s in subs.items()}


def test_stream_of_totals_equals_loop_and_makes_no_pairs(spark, scratch):
    """Also where nobody is subscribed at the end, so that no piece ends the last slot."""
    events = sorted(drawn(3, 160, 110), key=lambda e: e[1])
    events += [(600 + k, at(111), k, "error") for k in range(6)] + [(700, at(112), 1, "click"), (701, at(111), 2, "click")]
    acts, schema = f"{scratch}/events", spark.createDataFrame([], SCHEMA).schema
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(acts)

    def run():
        U.piece_stream(J.event_stream(spark, acts, schema), f"{scratch}/pieces", f"{scratch}/ck-pieces", "2 hours").awaitTermination()
        msgs = G.messages(J.event_stream(spark, acts, schema), {**G.DOWNLOAD_STAGES, U.HEARTBEAT: U.HEARTBEAT})
        query = U.delivery_stream(msgs, f"{scratch}/pieces", f"{scratch}/sink", f"{scratch}/ck-sink", "2 hours", partitions=2, per=PER, totals=TOTALS)
        query.awaitTermination()
        return {r.seq: tuple(r)[3:] for r in U.read_totals(spark, f"{scratch}/sink", PER, TOTALS).collect()}

    put([e for e in events if e[1] < at(50)])
    first = run()
    put([e for e in events if e[1] >= at(50)] + [(900, at(200), None, U.HEARTBEAT)])
    wanted = by_message(events)
    assert first and first.items() < wanted.items()
    assert run() == wanted


def test_arrivals_of_several_files_have_no_late_events(spark, small, monkeypatch):
    from haulage.plans import catalog
    monkeypatch.setattr(catalog, "ARRIVAL_FILE_ROWS", 150)
    columns = ["task_id", "seq", "stage", "n_subscribers", "first_subscriber", "last_subscriber", "subscriber_sum"]
    rows = lambda name: sorted(map(tuple, catalog.QUERIES[name](spark, small).select(*columns).collect()))
    assert rows("g11_stream_fan_out_subscribed") == rows("g10_fan_out_subscribed")


def test_query_makes_every_delivery(spark, scratch, monkeypatch):
    """The query counts deliveries that the fan-out has made, a row each; sums that would overflow on the way are exact."""
    from haulage.plans import catalog
    far = [(601, at(3), 2**62, "view"), (602, at(3), -(2**62), "view"), (603, at(4), 2**62 + 1, "view")]
    events = drawn(4, 150, 100) + far + [(604, at(101), 1, "click")]
    spark.createDataFrame(events, SCHEMA).write.parquet(f"{scratch}/events.parquet")
    made = []

    def kept(*args, fan_out=U.fan_out_subscribed, **how):
        made.append(fan_out(*args, **how))
        return made[-1]

    monkeypatch.setattr(U, "fan_out_subscribed", kept)
    found = catalog.QUERIES["g10_fan_out_subscribed"](spark, scratch)
    assert found.columns == ["task_id", "seq", "stage", "n_subscribers", "first_subscriber", "last_subscriber", "subscriber_sum"]
    assert delivered(made[0]) == expected(events)
    assert {r.seq: tuple(r)[3:] for r in found.collect()} == by_message(events)
