"""Global order without a single task.

``row_number()`` over a window without ``partitionBy`` moves every row into one task.
Here the frame is range-partitioned on the keys instead (range bounds come from a
sample, so a hot key is split over several partitions), sorted inside each
partition, and numbered there; a tiny per-partition count table (one row per
partition, a proven size bound) gives each partition its starting offset and is
broadcast back.

The keys must order the rows totally (add tie-breakers, or use all columns), else
rows that tie are numbered in an arbitrary order.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_POS_MASK = (1 << 33) - 1  # monotonically_increasing_id = partition << 33 | position


def _order_cols(keys: Sequence[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def ranged(df: DataFrame, keys: Sequence[str | Column], num_partitions: int | None = None,
           pid: str = "_pid", pos: str = "_pos") -> tuple[DataFrame, DataFrame]:
    """Range-partition on ``keys``; return (sorted rows tagged with partition and
    position, per-partition offsets).

    Range bounds come from a sample whose seed depends on the RDD, so two separately
    planned exchanges (column pruning makes them differ) may cut the key space
    differently. The tagged rows are therefore checkpointed once (reliable storage,
    ``spark.checkpoint.dir``) and both readers use that copy; it also cuts lineage,
    so a lost executor never re-samples.

    Without ``num_partitions`` adaptive execution sizes the range partitions from
    the data (coalescing merges adjacent key ranges, so the order holds); the
    offsets table has at most one row per partition either way.
    """
    from haulage.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    order = _order_cols(keys)
    parts = df.repartitionByRange(int(num_partitions), *order) if num_partitions else df.repartitionByRange(*order)
    tagged = (parts
                .sortWithinPartitions(*order)
                .withColumn(pid, F.spark_partition_id())
                .withColumn(pos, F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK))))
    tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy(pid).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(pid, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return tagged, offsets


def with_row_number(df: DataFrame, keys: Sequence[str | Column], name: str = "row_no",
                    num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based global row number in ``keys`` order, computed in parallel."""
    tagged, offsets = ranged(df, keys, num_partitions)
    return (tagged.join(F.broadcast(offsets), "_pid")
                  .withColumn(name, (F.col("_offset") + F.col("_pos")).cast("bigint"))
                  .drop("_pid", "_pos", "_offset"))


def _same_key(a: Sequence[str], b: Sequence[str]) -> Column:
    cond = F.lit(True)
    for x, y in zip(a, b):
        cond = cond & F.col(x).eqNullSafe(F.col(y))
    return cond


def _arrow_lag(carried: list[str]):
    """mapInArrow function: lag of ``carried`` columns inside one partition, in row order.

    Rows of a partition arrive sorted by position, batch after batch; the last row of
    one batch is carried into the next. The first row of the partition gets nulls
    and ``_first = true`` (filled from the previous partition by the caller).
    """
    def lag(batches):
        import pyarrow as pa

        carry = None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            out = [batch.column(i) for i in range(batch.num_columns)]
            names = list(batch.schema.names)
            for c in carried:
                col = batch.column(batch.schema.get_field_index(c))
                head = pa.array([None if carry is None else carry[c]], type=col.type)
                out.append(pa.concat_arrays([head, col.slice(0, n - 1)]))
                names.append(f"_l_{c}")
            first = [carry is None] + [False] * (n - 1)
            out.append(pa.array(first, type=pa.bool_()))
            names.append("_first")
            carry = {c: batch.column(batch.schema.get_field_index(c))[n - 1].as_py() for c in carried}
            yield pa.RecordBatch.from_arrays(out, names=names)

    return lag


def lag_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
               prefix: str = "prev_", num_partitions: int | None = None, method: str = "arrow") -> DataFrame:
    """``lag(col)`` within each key in ``order``, without gathering a key in one task.

    Rows are range-partitioned on ``keys + order`` (a hot key spans several
    partitions) and lagged inside each range partition; the first row of a
    partition takes the last row of the previous non-empty partition from a tiny
    per-partition table (proven bound: one row per partition, broadcast). A value
    from another key is discarded. ``keys + order`` must order rows totally.

    ``method="arrow"`` lags inside each checkpointed partition with vectorised Arrow
    shifts (no further shuffle); ``"window"`` uses a window over the partition id
    (one more hash exchange of all rows). Both give the same result.
    """
    keys, order, cols = list(keys), list(order), list(cols)
    if method not in ("arrow", "window"):
        raise ValueError("method must be arrow or window")
    tagged, _ = ranged(df, keys + order, num_partitions)
    carried = keys + [c for c in cols if c not in keys]
    if method == "arrow":
        from pyspark.sql.types import BooleanType, StructField, StructType

        from haulage.session import ship_package
        ship_package(df.sparkSession)
        fields = list(tagged.schema.fields)
        extra = [StructField(f"_l_{c}", tagged.schema[c].dataType, True) for c in carried]
        schema = StructType(fields + extra + [StructField("_first", BooleanType(), False)])
        lagged = tagged.mapInArrow(_arrow_lag(carried), schema)
    else:
        within = Window.partitionBy("_pid").orderBy("_pos")
        lagged = tagged.select(
            "*", *[F.lag(c).over(within).alias(f"_l_{c}") for c in carried],
            F.lag("_pos").over(within).isNull().alias("_first"))
    last = (tagged.groupBy("_pid")
                  .agg(F.max_by(F.struct(*[F.col(c).alias(f"_b_{c}") for c in carried]), F.col("_pos"))
                        .alias("_last")))
    before = Window.orderBy("_pid")
    boundary = last.select("_pid", F.lag("_last").over(before).alias("_prev_last")) \
                   .select("_pid", "_prev_last.*")
    joined = lagged.join(F.broadcast(boundary), "_pid", "left")
    picked = {c: F.when(F.col("_first"), F.col(f"_b_{c}")).otherwise(F.col(f"_l_{c}")) for c in carried}
    joined = joined.select("*", *[picked[c].alias(f"_p_{c}") for c in carried])
    same = _same_key(keys, [f"_p_{k}" for k in keys])
    out = joined.select(*df.columns, *[F.when(same, F.col(f"_p_{c}")).alias(f"{prefix}{c}") for c in cols])
    return out
