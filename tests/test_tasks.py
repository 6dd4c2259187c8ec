import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haulage.operators import tasks as T

CASES = {1: ["start"], 2: ["start", "cancel"], 3: ["start", "cancel", "cancel"],
         4: ["start", "cancel", "complete"], 5: ["start", "complete", "cancel"], 6: ["cancel"],
         7: ["start", "fail", "start", "cancel"], 8: ["cancel", "start"]}


def _events(spark):
    rows, seq = [], 0
    for t, kinds in CASES.items():
        for i, k in enumerate(kinds):
            rows.append((t, k, dt.datetime(2024, 1, 1, 0, 0, i), seq))
            seq += 1
    return spark.createDataFrame(rows, "task_id long, kind string, ts timestamp_ntz, seq long")


def test_golden_states(spark):
    got = {r.task_id: r.status for r in T.latest_status(_events(spark)).collect()}
    assert got == {1: "in_progress", 2: "cancel_requested", 3: "cancel_requested", 4: "completed",
                   5: "completed", 7: "cancel_requested", 8: "in_progress"}


def test_golden_cancels(spark):
    got = sorted((r.task_id, r.outcome) for r in T.cancel_outcomes(_events(spark)).collect())
    assert got == [(2, "accepted"), (3, "accepted"), (3, "rejected"), (4, "accepted"), (5, "rejected"),
                   (6, "not_found"), (7, "accepted"), (8, "not_found")]


def test_lookup_and_gate(spark):
    statuses = T.latest_status(_events(spark))
    req = spark.createDataFrame([(i,) for i in range(1, 10)], "task_id long")
    look = {r.task_id: r.status for r in T.status_lookup(req, statuses).collect()}
    assert look[6] == "not_found" and look[9] == "not_found" and look[4] == "completed"
    results = spark.createDataFrame([(4, "/out/4.zip")], "task_id long, output_path string")
    gate = {r.task_id: (r.code, r.detail) for r in T.download_gate(req, statuses, results).collect()}
    assert gate[4] == (200, "/out/4.zip")
    assert gate[5][0] == 500 and gate[6][0] == 404 and gate[1][0] == 409
    fails = statuses.withColumn("status", F.lit("failed"))
    assert {r.code for r in T.download_gate(req.filter("task_id = 1"), fails, results).collect()} == {500}


def _fold(kinds):
    """Step-by-step model of the rules: final status and each cancel's outcome."""
    status, outcomes = None, []
    for k in kinds:
        if k == "start":
            status = "in_progress"
        elif k == "complete":
            status = "completed"
        elif k == "fail":
            status = "failed"
        elif status is None:
            outcomes.append("not_found")
        elif status == "in_progress":
            status = "cancel_requested"
            outcomes.append("accepted")
        else:
            outcomes.append("rejected")
    return status, outcomes


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["start", "complete", "fail", "cancel"]), min_size=1, max_size=6),
                min_size=1, max_size=40))
def test_closed_forms_match_fold(spark, sequences):
    rows, seq = [], 0
    for t, kinds in enumerate(sequences):
        for i, k in enumerate(kinds):
            rows.append((t, k, dt.datetime(2024, 1, 1, 0, 0, i), seq))
            seq += 1
    ev = spark.createDataFrame(rows, "task_id long, kind string, ts timestamp_ntz, seq long")
    statuses = {r.task_id: r.status for r in T.latest_status(ev).collect()}
    outcomes = {}
    for r in T.cancel_outcomes(ev, num_partitions=3).orderBy("seq").collect():
        outcomes.setdefault(r.task_id, []).append(r.outcome)
    for t, kinds in enumerate(sequences):
        status, outs = _fold(kinds)
        assert statuses.get(t) == status, kinds
        assert outcomes.get(t, []) == outs, kinds


def test_one_task_with_all_events_is_cut(spark, small):
    """The same outcomes and orders from slices, in one exchange and without a join of the events."""
    from haulage.streaming import notify as G
    ev = spark.read.parquet(f"{small}/events.parquet").withColumn("user_id", F.lit(5) + F.col("user_id") * 0)
    tasks = T.task_events(ev)
    whole = T.cancel_outcomes(tasks)
    assert "Join" not in whole._jdf.queryExecution().executedPlan().toString()
    cut = T.cancel_outcomes(tasks, slice_rows=37)
    assert cut.exceptAll(whole).count() == 0 and whole.count() == cut.count() > 100
    msgs = G.messages(ev)
    cut, whole = G.message_order(msgs, slice_rows=41), G.message_order(msgs)
    assert cut.exceptAll(whole).count() == 0 and whole.count() == cut.count() > 100
