"""Structured Streaming jobs for task states (F) and notifications (G).

Sources are file streams (any folder or glob of parquet files, e.g. event logs as
they land); sinks are file tables written per micro-batch, with checkpoints, so a
restarted query continues where it stopped and a lost executor only repeats a
micro-batch. ``trigger="availableNow"`` processes what is there and stops (tests,
batch-like runs); ``processingTime`` values keep the query running.
"""

from __future__ import annotations

from typing import Callable

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from haulage.operators.tasks import latest_status, task_events
from haulage.sinks.archive import _fs
from haulage.streaming import ordered
from haulage.streaming.notify import drop_failed, fan_out, messages, subscription_states, with_failures

WATERMARK = "1 hour"
MAX_FILES_PER_TRIGGER = 1000    # bounds a micro-batch; None takes all files at once
COMPACT_EVERY = 50              # micro-batches after which an upsert log is folded


def event_stream(spark: SparkSession, path: str, schema: StructType, ts_col: str = "ts",
                 max_files_per_trigger: int | None = MAX_FILES_PER_TRIGGER) -> DataFrame:
    """Parquet files as a stream; ``timestamp_ntz`` times become ``timestamp`` for watermarks."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.parquet(path)
    return df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))


def write_batch_partition(batch: DataFrame, batch_id: int, sink: str) -> None:
    """Write one micro-batch as its own ``batch_id`` partition, replacing an earlier
    attempt of the same batch: a retried batch never leaves duplicate rows."""
    (batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
          .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
          .partitionBy("batch_id").parquet(sink))


def _start(df: DataFrame, sink: str, checkpoint: str, trigger: str, mode: str = "append",
           batch_fn: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger == "availableNow" else w.trigger(processingTime=trigger)
    if batch_fn is not None:
        return w.foreachBatch(batch_fn).start()
    return w.format("parquet").start(sink)


def notification_stream(spark: SparkSession, events_path: str, schema: StructType,
                        subscribers: DataFrame, sink: str, checkpoint: str,
                        failures: Callable[[SparkSession], DataFrame] | str | None = None,
                        trigger: str = "availableNow") -> StreamingQuery:
    """G1+G2(+G3): messages of new events, fanned out to the (static) subscriber table.

    ``failures`` is a parquet path or a function that makes the frame: it is looked up anew for
    every micro-batch, so failures recorded meanwhile apply. (A frame itself would keep the file
    list it was made with, so it is refused.)
    """
    if isinstance(failures, DataFrame):
        raise TypeError("failures must be a path or a function, so that every batch reads them anew")
    msgs = messages(event_stream(spark, events_path, schema).withWatermark("ts", WATERMARK))
    if failures is None:
        return _start(fan_out(msgs, subscribers), sink, checkpoint, trigger)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        frame = batch.sparkSession.read.parquet(failures) if isinstance(failures, str) else failures(batch.sparkSession)
        write_batch_partition(drop_failed(fan_out(batch, with_failures(subscribers, frame))), batch_id, sink)

    return _start(msgs, sink, checkpoint, trigger, batch_fn=write_batch)


def upsert_log_stream(states: DataFrame, sink: str, checkpoint: str, key: str,
                      trigger: str = "availableNow", compact_every: int | None = COMPACT_EVERY) -> StreamingQuery:
    """Run a streaming aggregation in update mode; each micro-batch appends the changed
    keys as its own ``batch_id`` partition (an upsert log, idempotent per batch). Every
    ``compact_every`` batches the log up to the batch before is folded (:func:`compact_log`)."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch_partition(batch, batch_id, sink)
        if compact_every and batch_id and batch_id % compact_every == 0:
            compact_log(batch.sparkSession, sink, key, batch_id - 1)

    return _start(states, sink, checkpoint, trigger, mode="update", batch_fn=write_batch)


def _base(sink: str) -> int | None:
    """The batch up to which the log is folded: the latest fold that was written in full."""
    fs, root = _fs(f"{sink}-base")
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
    return max((int(i.path.rsplit("/", 2)[1].removeprefix("upto-")) for i in found if i.path.endswith("/_SUCCESS")), default=None)


def _log(spark: SparkSession, sink: str, upto: int | None = None) -> DataFrame | None:
    """The rows that count: the fold, and the batches behind it."""
    base = _base(sink)
    fs, root = _fs(sink)
    ids = [int(i.path.rsplit("=", 1)[1]) for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if "/batch_id=" in i.path]
    ids = [i for i in ids if (base is None or i > base) and (upto is None or i <= upto)]
    log = spark.read.option("basePath", sink).parquet(*[f"{sink}/batch_id={i}" for i in sorted(ids)]) if ids else None
    if log is not None:
        log = log.withColumn("batch_id", F.col("batch_id").cast("bigint"))
    if base is None:
        return log
    folded = spark.read.parquet(f"{sink}-base/upto-{base}")
    return folded if log is None else folded.unionByName(log.select(folded.columns))


def compact_log(spark: SparkSession, sink: str, key: str, upto: int) -> None:
    """Fold an upsert log's batches up to ``upto`` into one row per key, and drop them.

    The fold is written beside the log and counts once it is complete; batches it covers are left
    out by readers from then on, whether they are deleted yet or not, so a stop at any point loses
    nothing and shows nothing twice. ``upto`` must be a batch that has ended.
    """
    base, log = _base(sink), _log(spark, sink, upto)
    if log is None or (base is not None and base >= upto):
        return
    values = [c for c in log.columns if c != key]
    latest = log.groupBy(key).agg(F.max_by(F.struct(*values), F.col("batch_id")).alias("_v")).select(key, "_v.*")
    latest.write.mode("overwrite").parquet(f"{sink}-base/upto-{upto}")
    fs, root = _fs(sink)
    for info in fs.get_file_info(pafs.FileSelector(root)):
        if "/batch_id=" in info.path and int(info.path.rsplit("=", 1)[1]) <= upto:
            fs.delete_dir(info.path)
    fs, root = _fs(f"{sink}-base")
    for info in fs.get_file_info(pafs.FileSelector(root)):
        if int(info.path.rsplit("upto-", 1)[1]) < upto:
            fs.delete_dir(info.path)


def read_latest(spark: SparkSession, sink: str, key: str) -> DataFrame:
    """Current row per key of an upsert log (the row of the latest batch)."""
    log = _log(spark, sink)
    values = [c for c in log.columns if c not in (key, "batch_id")]
    return (log.groupBy(key).agg(F.max_by(F.struct(*values), F.col("batch_id")).alias("_v"))
               .select(key, "_v.*"))


def status_stream(spark: SparkSession, events_path: str, schema: StructType, sink: str, checkpoint: str, trigger: str = "availableNow",
                  max_files_per_trigger: int | None = MAX_FILES_PER_TRIGGER, compact_every: int | None = COMPACT_EVERY) -> StreamingQuery:
    """F1 as a streaming aggregation in update mode.

    Each micro-batch appends the tasks whose state changed, tagged with the batch
    id; :func:`read_status_table` keeps the last row per task (an upsert log).
    """
    ev = task_events(event_stream(spark, events_path, schema, max_files_per_trigger=max_files_per_trigger))
    return upsert_log_stream(latest_status(ev), sink, checkpoint, "task_id", trigger, compact_every)


def subscription_stream(spark: SparkSession, actions_path: str, schema: StructType, sink: str,
                        checkpoint: str, sub_col: str = "user_id", action_col: str = "event_type",
                        seq_col: str = "event_id", trigger: str = "availableNow",
                        max_files_per_trigger: int | None = MAX_FILES_PER_TRIGGER, compact_every: int | None = COMPACT_EVERY) -> StreamingQuery:
    """G4 as a stream: the latest subscribe / unsubscribe per subscriber, as an upsert log.

    The log keeps unsubscribed rows too, so that a later unsubscribe replaces an
    earlier subscribe; :func:`read_active_subscribers` filters when reading.
    """
    actions = event_stream(spark, actions_path, schema, max_files_per_trigger=max_files_per_trigger)
    return upsert_log_stream(subscription_states(actions, sub_col, action_col, seq_col), sink, checkpoint,
                             "subscriber", trigger, compact_every)


def read_active_subscribers(spark: SparkSession, sink: str) -> DataFrame:
    """Subscribers whose latest action in the log is a subscribe."""
    latest = read_latest(spark, sink, "subscriber")
    return latest.filter(F.col("last_action") == F.lit("subscribe")).select("subscriber", "since")


def read_status_table(spark: SparkSession, sink: str) -> DataFrame:
    """Current state per task from the upsert log written by :func:`status_stream`."""
    return read_latest(spark, sink, "task_id")


def _outcomes(found: DataFrame, rule: str) -> DataFrame:
    ts = F.timestamp_micros("at").alias("ts")
    if rule == "cancel":
        return found.select("task_id", "seq", ts, "outcome")
    return found.select("task_id", "seq", F.col("kind").alias("stage"), ts, (F.col("outcome") == "in order").alias("in_order"))


def read_ordered(spark: SparkSession, sink: str) -> DataFrame:
    """All outcomes of an ordered stream: passed events and, as things stand, waiting ones."""
    return _outcomes(ordered.judged(spark, sink), ordered._about(spark, sink)["rule"])


def read_recounted(spark: SparkSession, sink: str) -> DataFrame:
    """All outcomes with late events put in their place: what a batch over all events gives."""
    return _outcomes(ordered.recounted(spark, sink), ordered._about(spark, sink)["rule"])


def late_events(spark: SparkSession, sink: str) -> DataFrame:
    """Events that came after the watermark had passed them; they have no outcome."""
    return ordered.late(spark, sink).select("task_id", "kind", F.timestamp_micros("at").alias("ts"), "seq")


def cancel_stream(spark: SparkSession, events_path: str, schema: StructType, sink: str,
                  checkpoint: str, delay: str = WATERMARK, trigger: str = "availableNow",
                  max_files_per_trigger: int | None = MAX_FILES_PER_TRIGGER, forget: str | None = None,
                  partitions: int | None = None) -> StreamingQuery:
    """F2 over a stream, in event-time order; read with :func:`read_ordered`.

    Events up to ``delay`` late are put in order; later ones go to :func:`late_events`. Tasks without
    an event for ``forget`` (an interval; None: for ever) leave the state and are unknown again.
    """
    ev = task_events(event_stream(spark, events_path, schema, max_files_per_trigger=max_files_per_trigger))
    return ordered.ordered_stream(ev, "cancel", sink, checkpoint, delay, trigger, forget, partitions)


def message_order_stream(spark: SparkSession, events_path: str, schema: StructType, sink: str,
                         checkpoint: str, delay: str = WATERMARK, trigger: str = "availableNow",
                         max_files_per_trigger: int | None = MAX_FILES_PER_TRIGGER, forget: str | None = None,
                  partitions: int | None = None) -> StreamingQuery:
    """G5 over a stream: each download message with ``stage`` and ``in_order`` (event-time order per
    task); read with :func:`read_ordered`."""
    stream = event_stream(spark, events_path, schema, max_files_per_trigger=max_files_per_trigger)
    msgs = messages(stream).select("task_id", F.col("stage").alias("kind"), "ts", "seq")
    return ordered.ordered_stream(msgs, "order", sink, checkpoint, delay, trigger, forget, partitions)
