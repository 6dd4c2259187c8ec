"""Messages to those who are subscribed at the time of the message.

A subscription holds from a subscribe to the subscriber's next action. In batch that is a lead over
each subscriber's actions and a range join of message times with the intervals. As streams there
are two jobs with watermarks on both sides:

* ``piece_stream`` follows the actions in event-time order (``transformWithState``) and gives out
  each subscription in pieces that end at multiples of ``PIECE``, a piece as soon as the watermark
  has passed its end. A subscriber's state is one time and the actions that still wait.
* ``delivery_stream`` joins pieces and messages, stream with stream, on the piece's number and the
  exact times. A piece is no longer than ``PIECE``, which bounds how long Spark keeps either side.
  Asked for totals (``per`` and ``totals``), it makes no pairs, whose number is as messages times
  subscribers: both sides wait, spread over buckets of a slot of length ``PIECE``, until the watermark
  of both has passed the slot, and a slot's messages and pieces then meet in ``range_join``, which
  gives totals in work that grows with the rows.

Actions behind their watermark are kept apart (:func:`late_actions`). Messages up to ``delay`` late
are delivered; Spark counts later ones as dropped by the watermark. A heartbeat moves the watermark
where nothing else happens: as an action, which also leaves a piece without length at the end of the
last slot that is known, and as a message of that stage, which is not delivered.
"""

from __future__ import annotations

from typing import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from haulage.operators import halo
from haulage.operators.ranges import Max, Min, range_join
from haulage.streaming.notify import SUBSCRIPTION_ACTIONS, _mapped
from haulage.streaming.ordered import BUCKETS, stateful

PIECE = 86_400_000_000          # microseconds
HEARTBEAT = "heartbeat"
OPEN_END = "9999-12-31 00:00:00"
FAN_OUT_ROWS = 20_000           # of messages by as many intervals a task makes its deliveries
PIECES = "subscriber long, piece long, since long, until long"


def subscription_intervals(actions: DataFrame, sub_col: str = "user_id", action_col: str = "event_type", ts_col: str = "ts",
                           seq_col: str = "event_id", mapping: Mapping[str, str] = SUBSCRIPTION_ACTIONS) -> DataFrame:
    """(subscriber, since, until): from every subscribe to the subscriber's next action by (time, seq),
    or to ``OPEN_END``. Actions without a time or subscriber are left out."""
    rows = actions.where(F.col(action_col).isin(*mapping) & F.col(ts_col).isNotNull() & F.col(sub_col).isNotNull()).select(
        F.col(sub_col).alias("subscriber"), _mapped(F.col(action_col), mapping).alias("action"), F.col(ts_col).alias("since"), F.col(seq_col).alias("seq"))
    found = halo.windows(rows, ["subscriber"], "since", ["seq"], {"until": halo.Lead("since")})
    end = F.lit(OPEN_END).cast(rows.schema["since"].dataType)
    return found.where("action = 'subscribe'").select("subscriber", "since", F.coalesce("until", end).alias("until"))


def fan_out_subscribed(msgs: DataFrame, intervals: DataFrame, cell_rows: int = FAN_OUT_ROWS) -> DataFrame:
    """Every message with every subscriber whose interval holds its time: a product by definition, each
    delivery a row. Messages are spread over the session's shuffle partitions, so that none meets the
    subscribers in the few tasks that read it, and cells of ``cell_rows`` messages or intervals are
    dealt out (see :func:`haulage.operators.ranges.range_join`)."""
    dealt = msgs.repartition(int(msgs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = range_join(dealt, intervals, "ts", "since", "until", cell_rows=cell_rows)
    return met.select(*msgs.columns, "subscriber")


class SubscriptionPieces(StatefulProcessor):
    """Rows (subscriber, action, at, seq), ``at`` in microseconds, to pieces of subscriptions."""

    def __init__(self, piece: int = PIECE):
        self.piece = piece

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "action string, at long, seq long")
        self.open = handle.getValueState("open", "since long")
        self.beat = handle.getValueState("beat", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed, fresh, beat = timerValues.getCurrentWatermarkInMs(), [], False
        for r in rows:
            if r.action == HEARTBEAT:
                beat = True
                continue
            if r.at // 1000 <= passed:
                yield Row(subscriber=key[0], piece=r.seq, since=r.at, until=r.at, late=True)
            else:
                fresh.append((r.action, r.at, r.seq))
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(e[1] for e in fresh) // 1000)
        if beat:
            # as soon as the watermark moves
            self.beat.update((passed,))
            self.handle.registerTimer(passed + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        # no action up to here can come any more, so whole pieces up to here are known
        upto = (passed + 1) * 1000 // self.piece * self.piece
        if self.beat.exists():
            yield Row(subscriber=key[0], piece=upto // self.piece - 1, since=upto, until=upto, late=False)
            self.beat.clear()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        since = self.open.get()[0] if self.open.exists() else None
        for action, at, _ in sorted((e for e in held if e[1] // 1000 <= passed), key=lambda e: (e[1], e[2])):
            if since is not None:
                yield from self._pieces(key, since, at)
            since = at if action == "subscribe" else None
        rest = [e for e in held if e[1] // 1000 > passed]
        if len(rest) < len(held):
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(min(e[1] for e in rest) // 1000)
        if since is None:
            self.open.clear()
            return
        if upto > since:
            yield from self._pieces(key, since, upto)
            since = upto
        self.open.update((since,))
        self.handle.registerTimer((since // self.piece + 1) * self.piece // 1000)

    def _pieces(self, key, since: int, until: int) -> Iterator[Row]:
        while since < until:
            number = since // self.piece
            end = min((number + 1) * self.piece, until)
            yield Row(subscriber=key[0], piece=number, since=since, until=end, late=False)
            since = end

    def close(self) -> None:
        pass


def piece_stream(actions: DataFrame, sink: str, checkpoint: str, delay: str, trigger: str = "availableNow", sub_col: str = "user_id",
                 action_col: str = "event_type", ts_col: str = "ts", seq_col: str = "event_id",
                 mapping: Mapping[str, str] = SUBSCRIPTION_ACTIONS, partitions: int | None = None) -> StreamingQuery:
    """Subscriptions of a stream of actions as a file table of pieces; actions of kind ``HEARTBEAT``
    only move the watermark."""
    spark = actions.sparkSession
    kinds = dict(mapping) | {HEARTBEAT: HEARTBEAT}
    rows = actions.where(F.col(action_col).isin(*kinds)).withWatermark(ts_col, delay).select(
        F.coalesce(F.col(sub_col).cast("long"), F.lit(-1)).alias("subscriber"), _mapped(F.col(action_col), kinds).alias("action"),
        F.unix_micros(ts_col).alias("at"), F.col(seq_col).cast("long").alias("seq"))
    found = rows.groupBy("subscriber").transformWithState(SubscriptionPieces(), f"{PIECES}, late boolean", "append", "EventTime")
    with stateful(spark, partitions):
        writer = found.writeStream.option("checkpointLocation", checkpoint).partitionBy("late").format("parquet")
        writer = writer.trigger(availableNow=True) if trigger == "availableNow" else writer.trigger(processingTime=trigger)
        return writer.start(sink)


def late_actions(spark: SparkSession, sink: str) -> DataFrame:
    """(subscriber, at, seq) of actions that came after the watermark had passed them."""
    rows = spark.read.schema(f"{PIECES}, late boolean").parquet(sink).where("late")
    return rows.select("subscriber", F.timestamp_micros("since").alias("at"), F.col("piece").alias("seq"))


def delivery_stream(msgs: DataFrame, pieces: str, sink: str, checkpoint: str, delay: str, trigger: str = "availableNow",
                    partitions: int | None = None, per: Sequence[str] | None = None, totals: Mapping[str, object] | None = None) -> StreamingQuery:
    """Deliveries of a stream of messages to the subscribers of :func:`piece_stream`'s table ``pieces``,
    joined stream with stream. Pieces of one batch of that job are read together, so their order
    among each other does not matter. ``per`` and ``totals``: the deliveries of slots that have
    passed, grouped by columns of the messages, with totals of ``subscriber`` (see
    :func:`haulage.operators.ranges.range_join`); read with :func:`read_totals`."""
    spark = msgs.sparkSession
    left = msgs.withWatermark("ts", delay).withColumn("_at", F.unix_micros("ts")).withColumn("_piece", F.floor(F.col("_at") / F.lit(PIECE)))
    right = (spark.readStream.schema(f"{PIECES}, late boolean").parquet(pieces).where("NOT late")
             .select("subscriber", F.col("piece").alias("_number"), "since", "until", F.timestamp_micros("until").alias("_ends")))
    if totals is None:
        right = right.withWatermark("_ends", delay)
        # the last two say the same as the first three, in event times: they tell Spark when rows can go
        cond = ((F.col("_piece") == F.col("_number")) & (F.col("_at") >= F.col("since")) & (F.col("_at") < F.col("until"))
                & (F.col("ts") < F.col("_ends")) & (F.col("ts") >= F.col("_ends") - F.expr(f"INTERVAL {PIECE // 1_000_000} SECONDS")))
        found = left.join(right, cond).where(~F.col("stage").eqNullSafe(F.lit(HEARTBEAT))).select(*msgs.columns, "subscriber")
    else:
        found = _held(left, right, list(per or ()), delay, BUCKETS * (partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))))
    with stateful(spark, partitions):
        writer = found.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
        writer = writer.trigger(availableNow=True) if trigger == "availableNow" else writer.trigger(processingTime=trigger)
        if totals is not None:
            return writer.foreachBatch(lambda batch, batch_id: _write_totals(batch, batch_id, sink, list(per or ()), dict(totals))).start()
        return writer.format("parquet").start(sink)


def _held(left: DataFrame, right: DataFrame, per: list[str], delay: str, buckets: int) -> DataFrame:
    """Messages and pieces of each slot, in lists that come once the watermark of both has passed the
    slot. The lists of a slot come together, however many buckets they are spread over."""
    kinds = {c: left.schema[c].dataType for c in per}
    none = F.lit(None).cast("long")
    # a heartbeat has neither a time nor an end here
    at = F.when(~F.col("stage").eqNullSafe(F.lit(HEARTBEAT)), F.col("_at"))
    asks = left.select(F.col("ts").alias("_t"), F.struct(*per, at.alias("_at"), none.alias("subscriber"), none.alias("since"), none.alias("until")).alias("_row"))
    # a piece's last microsecond lies in its slot
    gives = right.withColumn("_t", F.timestamp_micros(F.col("until") - 1)).withWatermark("_t", delay).select(
        "_t", F.struct(*[F.lit(None).cast(kinds[c]).alias(c) for c in per], none.alias("_at"), "subscriber", "since", "until").alias("_row"))
    rows = asks.unionByName(gives).withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    return rows.groupBy(F.window("_t", f"{PIECE // 1_000_000} seconds"), "_bucket").agg(F.collect_list("_row").alias("_rows"))


def _write_totals(batch: DataFrame, batch_id: int, sink: str, per: list[str], totals: dict[str, object]) -> None:
    from haulage.streaming.jobs import write_batch_partition
    # once only: the batch comes out of the state
    rows = batch.select(F.explode("_rows").alias("_row")).select("_row.*").checkpoint(eager=True)
    msgs, intervals = rows.where("_at IS NOT NULL").select(*per, "_at"), rows.where("until IS NOT NULL").select("subscriber", "since", "until")
    if msgs.isEmpty():
        found = msgs.select(*per, *[F.lit(None).cast("long").alias(name) for name in totals])
    else:
        found = range_join(msgs, intervals, "_at", "since", "until", per=per, totals=totals)
    write_batch_partition(found, batch_id, sink)


def read_totals(spark: SparkSession, sink: str, per: Sequence[str], totals: Mapping[str, object]) -> DataFrame:
    """What :func:`delivery_stream` with ``per`` and ``totals`` has written; a group may have rows in several slots."""
    add = {name: F.min if isinstance(t, Min) else F.max if isinstance(t, Max) else F.sum for name, t in totals.items()}
    return spark.read.parquet(sink).groupBy(*per).agg(*[f(name).alias(name) for name, f in add.items()])
