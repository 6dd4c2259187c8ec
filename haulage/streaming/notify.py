"""Notifications: event -> message text -> every active subscriber.

The same functions work on batch and on streaming DataFrames; the streaming
entry points run them under Structured Streaming with checkpoints in the shared
checkpoint folder.

Fan-out is a product by definition (each message to each subscriber), so its
output is messages x subscribers. Where there are at most ``FEW`` subscribers, which is
counted, they are broadcast (unless the session forbids it) and the messages stay where
they are read. More are met in salt buckets: the messages are spread over them and each bucket meets a copy of the
subscriber table in an ordinary equi-join: as many buckets as the session has shuffle
partitions, so they rise with the cluster, and no hint, so Spark goes by measured sizes.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.operators import halo

# The three notification texts and their lifecycle order.
MESSAGE_FORMATS = {
    "processing": "Download processing for task %s",
    "started": "Download started for task %s",
    "finished": "Download finished for task %s",
}
PREVIOUS_STAGE = {"processing": "finished", "started": "processing", "finished": "started"}

# Mapping used on the driver's ``events`` table.
DOWNLOAD_STAGES = {"view": "processing", "click": "started", "purchase": "finished"}
SUBSCRIPTION_ACTIONS = {"view": "subscribe", "error": "unsubscribe"}

FEW = 10_000    # subscribers that are broadcast


def _mapped(col: Column, mapping: Mapping[str, str]) -> Column:
    expr = F.lit(None).cast("string")
    for src, dst in mapping.items():
        expr = F.when(col == F.lit(src), F.lit(dst)).otherwise(expr)
    return expr


def messages(events: DataFrame, stages: Mapping[str, str] = DOWNLOAD_STAGES, task_col: str = "user_id",
             type_col: str = "event_type", ts_col: str = "ts", seq_col: str = "event_id") -> DataFrame:
    """G1: (task_id, stage, ts, seq, message) for every download event."""
    stage = _mapped(F.col(type_col), stages)
    text = F.lit(None).cast("string")
    for st, fmt in MESSAGE_FORMATS.items():
        text = F.when(F.col("stage") == F.lit(st),
                      F.format_string(fmt, F.col("task_id").cast("string"))).otherwise(text)
    return (events.filter(F.col(type_col).isin(*stages))
                  .select(F.col(task_col).alias("task_id"), stage.alias("stage"),
                          F.col(ts_col).alias("ts"), F.col(seq_col).alias("seq"))
                  .withColumn("message", text))


def subscription_states(actions: DataFrame, sub_col: str, action_col: str, seq_col: str,
                        mapping: Mapping[str, str] = SUBSCRIPTION_ACTIONS) -> DataFrame:
    """Per subscriber: the latest action and the seq of its latest action (max_by, map-side)."""
    act = _mapped(F.col(action_col), mapping)
    return (actions.filter(F.col(action_col).isin(*mapping))
                   .groupBy(F.col(sub_col).alias("subscriber"))
                   .agg(F.max_by(act, F.col(seq_col)).alias("last_action"),
                        F.max(F.col(seq_col)).alias("since")))


def active_subscribers(actions: DataFrame, sub_col: str, action_col: str, seq_col: str,
                       mapping: Mapping[str, str] = SUBSCRIPTION_ACTIONS) -> DataFrame:
    """Subscribers whose latest action is a subscribe."""
    latest = subscription_states(actions, sub_col, action_col, seq_col, mapping)
    return latest.filter(F.col("last_action") == F.lit("subscribe")).select("subscriber", "since")


def fan_out(msgs: DataFrame, subscribers: DataFrame, sub_col: str = "subscriber",
            salt_buckets: int | None = None) -> DataFrame:
    """Every message to every subscriber, no per-task filter.

    Subscriber columns ride along (``sub_col`` is renamed ``subscriber``). ``salt_buckets`` asks for
    buckets however few subscribers there are; their number defaults to the session's shuffle partitions.
    """
    subs = subscribers.withColumnRenamed(sub_col, "subscriber") if sub_col != "subscriber" else subscribers
    allowed = not msgs.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")
    if salt_buckets is None and allowed and subs.limit(FEW + 1).count() <= FEW:
        # a key that all rows share, made from columns so that this stays a hash join
        shared = lambda df: df.withColumn("_all", F.pmod(F.xxhash64(*df.columns), F.lit(1)))
        return shared(msgs).join(F.broadcast(shared(subs)), "_all").drop("_all")
    buckets = salt_buckets or int(msgs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = msgs.withColumn("_salt", F.pmod(F.xxhash64(*msgs.columns), F.lit(buckets)).cast("int"))
    copies = subs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return salted.join(copies, "_salt").drop("_salt")


def with_failures(subscribers: DataFrame, failures: DataFrame, sub_col: str = "subscriber",
                  failed_seq_col: str = "failed_seq") -> DataFrame:
    """G3, first half: each subscriber with the message (``failed_seq``) its send first failed at.

    Both sides are subscriber-sized; the result goes into :func:`fan_out` so the
    check travels with the subscriber table instead of shuffling the deliveries.
    """
    first_fail = (failures.groupBy(F.col(sub_col).alias("_sub"))
                          .agg(F.min(failed_seq_col).alias("failed_seq")))
    return (subscribers.join(first_fail, subscribers[sub_col] == F.col("_sub"), "left").drop("_sub"))


def drop_failed(deliveries: DataFrame) -> DataFrame:
    """G3, second half: no message at or after a subscriber's failed send."""
    return (deliveries.filter(F.col("failed_seq").isNull() | (F.col("seq") < F.col("failed_seq")))
                      .drop("failed_seq"))


def message_order(msgs: DataFrame, num_partitions: int | None = None, with_ts: bool = False, slice_rows: int = halo.SLICE_ROWS) -> DataFrame:
    """Each message with ``in_order``: its predecessor (same task, by time) is the stage before."""
    lagged = halo.windows(msgs.select("task_id", "stage", "ts", "seq"), ["task_id"], "ts", ["seq"], {"prev_stage": halo.Lag("stage")},
                          slice_rows=slice_rows, num_partitions=num_partitions)
    expected = _mapped(F.col("stage"), PREVIOUS_STAGE)
    first_ok = F.col("prev_stage").isNull() & (F.col("stage") == F.lit("processing"))
    follows = F.coalesce(F.col("prev_stage") == expected, F.lit(False))
    return lagged.select("task_id", "seq", "stage", *(["ts"] if with_ts else []), (first_ok | follows).alias("in_order"))
