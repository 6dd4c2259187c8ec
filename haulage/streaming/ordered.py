"""Event-time order on a stream: per key, events are judged once the watermark has passed them.

A ``transformWithState`` operator keeps, for each task, its waiting events and what came last before
them. Tasks are dealt out to buckets by a hash, and a bucket is the operator's key: every access to the
state is a call from Python to the JVM, which serves all of a bucket's tasks at once. An event-time
timer at a bucket's earliest waiting event wakes it when the watermark has passed that: the events
that are due are judged, task by task in order of (time, seq), and leave the state. An event that
the watermark had passed when it came is late: it is given out at once, marked, and not judged.

The operator's output is one file table, partitioned by ``late``, in which every event stands once.
What still waits is read from the operator's state (Spark's ``statestore`` source), so results can be
had as things stand without a second copy.

State is bounded by the events within the delay and one short row per task; ``forget`` drops the
rows of tasks that had no event for that long (they count as unknown again). A bucket's waiting
events are handled together, so they should fit a worker's memory: there are ``BUCKETS`` for each
partition of the state.
"""

from __future__ import annotations

import json
from contextlib import contextmanager
from typing import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from haulage.sinks.archive import _fs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JUDGED = "task_id long, kind string, at long, seq long, outcome string"
WAITING = "task_id long, kind string, at long, seq long"
LAST = "kind string, at long, known boolean"
BUCKETS = 64            # of a partition of the state
_APPEND = 10_000        # rows of one call to the state
_BEFORE = -(2**63)      # seq of the events that stand for what is past


def judge_cancel(kind: str, last: str | None, known: bool) -> str | None:
    """A cancel's outcome from the task's event before it; other events have none."""
    if kind != "cancel":
        return None
    return "not_found" if not known else "accepted" if last == "start" else "rejected"


def judge_order(kind: str, last: str | None, known: bool) -> str | None:
    """Whether a message follows the stage that comes before its own."""
    from haulage.streaming.notify import PREVIOUS_STAGE
    right = kind == "processing" if last is None else last == PREVIOUS_STAGE[kind]
    return "in order" if right else "out of order"


RULES: dict[str, Callable[[str, str | None, bool], str | None]] = {"cancel": judge_cancel, "order": judge_order}


class OrderedJudge(StatefulProcessor):
    """Rows (task_id, kind, at, seq), ``at`` in microseconds, to the same rows with ``outcome`` and ``late``."""

    def __init__(self, rule: str, forget_ms: int | None = None):
        self.rule, self.forget_ms = rule, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.last = handle.getMapState("last", "task_id long", LAST)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed, fresh, first = timerValues.getCurrentWatermarkInMs(), [], None
        for r in rows:
            ms = r.at // 1000
            if ms <= passed:
                yield self._row(r.task_id, r.kind, r.at, r.seq, None, True)
                continue
            first = ms if first is None else min(first, ms)
            fresh.append((r.task_id, r.kind, r.at, r.seq))
            if len(fresh) == _APPEND:
                self.waiting.appendList(fresh)
                fresh = []
        if fresh:
            self.waiting.appendList(fresh)
        if first is not None:
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed, judge = timerValues.getCurrentWatermarkInMs(), RULES[self.rule]
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((e for e in held if e[2] // 1000 <= passed), key=lambda e: (e[2], e[3]))
        rest = [e for e in held if e[2] // 1000 > passed]
        if not due and self.forget_ms is None:
            return
        last = {task[0]: tuple(value) for task, value in self.last.iterator()} if self.last.exists() else {}
        touched = set()
        for task, kind, at, seq in due:
            before, _, known = last.get(task, (None, None, False))
            yield self._row(task, kind, at, seq, judge(kind, before, known), False)
            last[task] = (kind, at, known or kind != "cancel")
            touched.add(task)
        for task in touched:
            self.last.updateValue((task,), last[task])
        if due:
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(e[2] for e in rest) // 1000)
            else:
                self.waiting.clear()
        if self.forget_ms is not None:
            open_ = touched | {e[0] for e in rest}
            for task in [t for t, (_, at, _) in last.items() if t not in open_ and passed >= at // 1000 + self.forget_ms]:
                self.last.removeKey((task,))
                del last[task]
            for at in {at // 1000 + self.forget_ms for t, (_, at, _) in last.items() if t in touched}:
                self.handle.registerTimer(at)

    def _row(self, task, kind, at, seq, outcome, late) -> Row:
        return Row(task_id=task, kind=kind, at=at, seq=seq, outcome=outcome, late=late)

    def close(self) -> None:
        pass


@contextmanager
def stateful(spark: SparkSession, partitions: int | None = None):
    """Settings for starting a stateful query, which keeps those it is started with: the state store
    that ``transformWithState`` needs and, if given, the number of state partitions."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS}
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ordered_stream(events: DataFrame, rule: str, sink: str, checkpoint: str, delay: str, trigger: str,
                   forget: str | None = None, partitions: int | None = None) -> StreamingQuery:
    """Judge a stream of (task_id, kind, ts, seq) by ``rule``; read with :func:`judged`, :func:`late`
    and :func:`recounted`. ``delay`` and ``forget`` are intervals; ``partitions`` of the state are
    fixed when a checkpoint is first used (default: the session's shuffle partitions)."""
    spark = events.sparkSession
    forget_ms = None
    if forget:
        forget_ms = spark.range(1).select((F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.expr(f"INTERVAL {forget}"))
                                           - F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp"))) / 1000).first()[0]
    # the time goes on as a number: Spark would drop rows behind the watermark before the operator
    # sees them, here they are wanted
    rows = events.withWatermark("ts", delay).select("task_id", "kind", F.unix_micros("ts").alias("at"), "seq")
    buckets = BUCKETS * (partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    # their number is fixed with the checkpoint, as that of the partitions is
    about = _bucketed(spark, sink, checkpoint, rule, buckets)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("task_id"), F.lit(about["buckets"])))
    found = rows.groupBy("bucket").transformWithState(OrderedJudge(rule, None if forget_ms is None else int(forget_ms)),
                                                       f"{JUDGED}, late boolean", "append", "EventTime")
    with stateful(spark, partitions):
        writer = found.writeStream.option("checkpointLocation", checkpoint).partitionBy("late").format("parquet")
        writer = writer.trigger(availableNow=True) if trigger == "availableNow" else writer.trigger(processingTime=trigger)
        return writer.start(sink)


def _written(spark: SparkSession, sink: str, late_: bool) -> DataFrame:
    return spark.read.schema(f"{JUDGED}, late boolean").parquet(sink).where(F.col("late") == late_).drop("late")


def _about(spark: SparkSession, sink: str) -> dict:
    return json.loads(spark.read.text(f"{sink}-about").first()[0])


def _bucketed(spark: SparkSession, sink: str, checkpoint: str, rule: str, buckets: int) -> dict:
    """What is noted about an ordered stream; a stream that goes on keeps its number of buckets."""
    fs, root = _fs(f"{sink}-about")
    if fs.get_file_info(f"{root}/_SUCCESS").type.name == "File":
        before = _about(spark, sink)
        if before["checkpoint"] == checkpoint:
            buckets = before.get("buckets", buckets)
    about = {"checkpoint": checkpoint, "rule": rule, "buckets": buckets}
    spark.createDataFrame([(json.dumps(about),)], "about string").write.mode("overwrite").text(f"{sink}-about")
    return about


def _state(spark: SparkSession, checkpoint: str, name: str, value: str) -> DataFrame:
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    if "user_map_key" in state.columns:
        return state.select(F.col("user_map_key.task_id").alias("task_id"), F.col(f"user_map_{value}.*"))
    return state.select(F.col(f"{value}.*"))


def _by_batch(rule: str, events: DataFrame) -> DataFrame:
    """(task_id, kind, at, seq, outcome) by the batch operators, in order and without gathering a task."""
    from haulage.operators.tasks import cancel_outcomes
    from haulage.streaming.notify import message_order
    timed = events.select("task_id", "kind", F.timestamp_micros("at").alias("ts"), "seq")
    if rule == "cancel":
        return cancel_outcomes(timed).select("task_id", F.lit("cancel").alias("kind"), F.unix_micros("ts").alias("at"), "seq", "outcome")
    out = message_order(timed.withColumnRenamed("kind", "stage"), with_ts=True)
    told = F.when(F.col("in_order"), "in order").otherwise("out of order")
    return out.select("task_id", F.col("stage").alias("kind"), F.unix_micros("ts").alias("at"), "seq", told.alias("outcome"))


def waiting(spark: SparkSession, sink: str) -> DataFrame:
    """(task_id, kind, at, seq) of events that the watermark has not passed."""
    return _state(spark, _about(spark, sink)["checkpoint"], "waiting", "list_element")


def _open_outcomes(spark: SparkSession, sink: str, about: dict) -> DataFrame:
    """Outcomes of waiting events as things stand: judged behind what each task had last."""
    held = waiting(spark, sink)
    last = _state(spark, about["checkpoint"], "last", "value").join(held.select("task_id").distinct(), "task_id", "left_semi")
    past = last.select("task_id", "kind", "at", F.lit(_BEFORE).alias("seq"))
    known = last.where("known AND kind = 'cancel'").select("task_id", F.lit("complete").alias("kind"), (F.col("at") - 1).alias("at"), F.lit(_BEFORE).alias("seq"))
    return _by_batch(about["rule"], held.unionByName(past).unionByName(known)).where(F.col("seq") != _BEFORE)


def judged(spark: SparkSession, sink: str) -> DataFrame:
    """(task_id, kind, at, seq, outcome): events the watermark has passed and, as things stand,
    those that wait. Late events have no outcome; see :func:`recounted`."""
    passed = _written(spark, sink, False).where("outcome IS NOT NULL")
    return passed.unionByName(_open_outcomes(spark, sink, _about(spark, sink)))


def late(spark: SparkSession, sink: str) -> DataFrame:
    """(task_id, kind, at, seq) of events that came after the watermark had passed them."""
    return _written(spark, sink, True).drop("outcome")


def recounted(spark: SparkSession, sink: str) -> DataFrame:
    """As :func:`judged`, with the late events put in their place: the tasks that have any are judged
    again as a whole, from the events kept in the sink and the state."""
    about = _about(spark, sink)
    tasks = late(spark, sink).select("task_id").distinct()
    kept = judged(spark, sink).join(tasks, "task_id", "left_anti")
    again = _written(spark, sink, False).unionByName(_written(spark, sink, True)).drop("outcome").unionByName(waiting(spark, sink))
    return kept.unionByName(_by_batch(about["rule"], again.join(tasks, "task_id", "left_semi")))
