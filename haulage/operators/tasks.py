"""Task states folded from an event table: latest status, guarded cancel, lookups.

Rules (one state per task):
* ``start`` sets ``in_progress``; ``complete`` sets ``completed``; ``fail`` sets
  ``failed`` — each overwrites whatever was there, also ``cancel_requested``;
* ``cancel`` of an unknown task is ``not_found``; it is ``accepted`` (state
  becomes ``cancel_requested``) only from ``in_progress``, else ``rejected``.

Closed forms replace the step-by-step fold:
* the final state depends only on the last non-cancel event E and on whether a
  cancel follows it (the first cancel after a start is accepted) — an
  aggregation, combined map-side, so a task holding a third of all events is
  never gathered into one task;
* a cancel is accepted iff the task's previous event is a start, a lag that
  :mod:`haulage.operators.halo` gives without a large task in one sort.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.operators import halo

# Event kinds, states and the gate's replies.
KINDS = ("start", "complete", "fail", "cancel")
STATE_OF = {"start": "in_progress", "complete": "completed", "fail": "failed"}
CANCEL_REQUESTED = "cancel_requested"
NOT_FOUND = "not_found"

# Mapping used on the driver's ``events`` table.
EVENT_KINDS = {"signup": "start", "purchase": "complete", "error": "fail", "click": "cancel"}


def _state_of(kind: Column) -> Column:
    expr = F.lit(None).cast("string")
    for k, s in STATE_OF.items():
        expr = F.when(kind == F.lit(k), F.lit(s)).otherwise(expr)
    return expr


def task_events(events: DataFrame, mapping: Mapping[str, str] = EVENT_KINDS, task_col: str = "user_id",
                type_col: str = "event_type", ts_col: str = "ts", seq_col: str = "event_id",
                error_col: str | None = None) -> DataFrame:
    """Standard shape (task_id, kind, ts, seq[, error]); event types outside ``mapping`` are dropped."""
    kind = F.lit(None).cast("string")
    for src, k in mapping.items():
        if k not in KINDS:
            raise ValueError(f"unknown kind {k!r}")
        kind = F.when(F.col(type_col) == F.lit(src), F.lit(k)).otherwise(kind)
    return (events.filter(F.col(type_col).isin(*mapping))
                  .select(F.col(task_col).alias("task_id"), kind.alias("kind"),
                          F.col(ts_col).alias("ts"), F.col(seq_col).alias("seq"),
                          *([F.col(error_col).alias("error")] if error_col else [])))


def latest_status(ev: DataFrame) -> DataFrame:
    """one row per known task: task_id, status (one aggregation, map-side combined).

    With an ``error`` column in the events, a failed task also carries the error of its last failure.
    """
    pos = F.struct("ts", "seq")
    is_cancel = F.col("kind") == F.lit("cancel")
    has_error = "error" in ev.columns
    last_error = F.max_by(F.struct("error"), F.when(F.col("kind") == F.lit("fail"), pos))["error"] if has_error else F.lit(None).cast("string")
    agg = ev.groupBy("task_id").agg(
        last_error.alias("_error"),
        F.max_by(F.when(~is_cancel, F.col("kind")), F.when(~is_cancel, pos)).alias("_last_kind"),
        F.max(F.when(~is_cancel, pos)).alias("_last_pos"),
        F.max(F.when(is_cancel, pos)).alias("_last_cancel"),
    )
    cancel_after = (F.col("_last_kind") == F.lit("start")) & (F.col("_last_cancel") > F.col("_last_pos"))
    status = F.when(cancel_after, F.lit(CANCEL_REQUESTED)).otherwise(_state_of(F.col("_last_kind")))
    error = [F.when(F.col("_last_kind") == F.lit("fail"), F.col("_error")).alias("error")] if has_error else []
    return agg.filter(F.col("_last_kind").isNotNull()).select("task_id", status.alias("status"), *error)


def cancel_outcomes(ev: DataFrame, num_partitions: int | None = None, slice_rows: int = halo.SLICE_ROWS) -> DataFrame:
    """every cancel with its outcome: accepted, rejected or not_found.

    One exchange of the events: the event before, and whether a non-cancel event came before, are
    windows over the task (:mod:`haulage.operators.halo` cuts a large task into slices).
    """
    marked = ev.withColumn("_sets", F.when(F.col("kind") != "cancel", F.lit(True)))
    seen = halo.windows(marked, ["task_id"], "ts", ["seq"], {"prev_kind": halo.Lag("kind"), "_known": halo.LastBefore("_sets")},
                        slice_rows=slice_rows, num_partitions=num_partitions)
    outcome = (F.when(F.col("_known").isNull(), F.lit(NOT_FOUND))
                .when(F.col("prev_kind") == F.lit("start"), F.lit("accepted"))
                .otherwise(F.lit("rejected")))
    return seen.where(F.col("kind") == "cancel").select("task_id", "seq", "ts", outcome.alias("outcome"))


def status_lookup(requests: DataFrame, statuses: DataFrame, task_col: str = "task_id") -> DataFrame:
    """requested task ids with their status, ``not_found`` for unknown ones."""
    return (requests.select(F.col(task_col).alias("task_id")).join(statuses, "task_id", "left")
                    .select("task_id", F.coalesce(F.col("status"), F.lit(NOT_FOUND)).alias("status")))


def download_gate(requests: DataFrame, statuses: DataFrame, results: DataFrame,
                  task_col: str = "task_id") -> DataFrame:
    """per request a code and what stands behind it, in the order the checks run.

    unknown 404; failed 500 (with its error, if recorded); not completed 409; completed without a
    path 500; else 200 and the path.
    ``results`` holds (task_id, output_path) for tasks that recorded one.
    """
    error = F.col("error") if "error" in statuses.columns else F.lit(None).cast("string")
    j = (requests.select(F.col(task_col).alias("task_id"))
                 .join(statuses.select("task_id", "status", error.alias("error")), "task_id", "left")
                 .join(results.select("task_id", "output_path"), "task_id", "left"))
    code = (F.when(F.col("status").isNull(), F.lit(404))
             .when(F.col("status") == F.lit("failed"), F.lit(500))
             .when(F.col("status") != F.lit("completed"), F.lit(409))
             .when(F.col("output_path").isNull(), F.lit(500))
             .otherwise(F.lit(200)))
    reason = (F.when(F.col("status").isNull(), F.lit("unknown task"))
               .when(F.col("status") == F.lit("failed"), F.coalesce(F.col("error"), F.lit("failed")))
               .when(F.col("status") != F.lit("completed"), F.col("status"))
               .when(F.col("output_path").isNull(), F.lit("no output recorded"))
               .otherwise(F.col("output_path")))
    return j.select("task_id", code.alias("code"), reason.alias("detail"))
