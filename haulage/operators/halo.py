"""Window functions over keys that may hold any share of the rows.

A window needs a key's rows side by side, in one task. Here a key of over ``slice_rows`` rows is cut
into slices of its order first, at quantiles of the order column, so that the rows go out by
(key, slice) in one exchange and Spark's own windows run inside each slice. What a slice owes to
the ones before and after it is small and is handed over:

* positions and ranks: the rows and distinct values of the earlier slices;
* lag, lead and frames of n rows: the last (first) n rows of the neighbouring slices;
* frames of a time span: of the earlier rows those whose span ends in the slice, sent there
  along with its own rows as a halo (each row goes to one slice more at most); rows whose span
  covers a slice as a whole are only counted;
* the last value so far: that of the earlier slices.

These hand-overs are tables of a few rows for every slice. A cut key has over ``slice_rows``
rows, so there are at most rows / ``slice_rows`` cut keys and about as many slices: that
bounds the broadcasts. Where no key is that large the plan is one exchange with plain windows.

Rows of one key and one value of the order column stay together (they are peers).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 2_000_000
MAX_SLICES = 4096          # of one key; beyond, slices grow with the key
_CHUNK = 64                # slice bounds are looked up in two steps of this size


@dataclass(frozen=True)
class RowNumber:
    """1-based place within the key."""


@dataclass(frozen=True)
class Rank:
    """1-based rank by the order column alone, with gaps."""


@dataclass(frozen=True)
class DenseRank:
    """1-based rank by the order column alone, without gaps."""


@dataclass(frozen=True)
class KeyCount:
    """Rows of the key."""


@dataclass(frozen=True)
class Ntile:
    """Groups 1 .. ``groups`` of nearly equal size, the first ones one larger."""
    groups: int


@dataclass(frozen=True)
class Lag:
    column: str
    offset: int = 1


@dataclass(frozen=True)
class Lead:
    column: str
    offset: int = 1


@dataclass(frozen=True)
class SumRows:
    """Sum over the row and the ``rows`` - 1 before it; null where all are null."""
    column: str
    rows: int


@dataclass(frozen=True)
class CountSpan:
    """Rows whose order value lies at most ``interval`` (``"1 DAY"``) before the row's, peers included."""
    interval: str


@dataclass(frozen=True)
class LastBefore:
    """Last non-null value of the rows before the row (an as-of lookup)."""
    column: str


def _same(keys: Sequence[str], prefix: str) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def _named(keys: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(k).alias(prefix + k) for k in keys]


def _cut_keys(rows: DataFrame, keys: list[str], slice_rows: int) -> DataFrame | None:
    """(keys as _h_*, _cuts): for every key of over ``slice_rows`` rows the values of ``_by`` at which
    its slices begin, in chunks. None where no key is that large."""
    large = rows.groupBy(*_named(keys, "_h_")).agg(F.count(F.lit(1)).alias("_h_n")).where(F.col("_h_n") > slice_rows)
    most = large.agg(F.max("_h_n")).first()[0]
    if most is None:
        return None
    m = min(MAX_SLICES, -(-most // slice_rows))
    of_large = rows.join(F.broadcast(large), _same(keys, "_h_"))
    cuts = of_large.groupBy(*[f"_h_{k}" for k in keys]).agg(
        F.percentile_approx("_by", [k / m for k in range(1, m)] or [1.0], max(10_000, 4 * m)).alias("_c"), F.max("_h_n").alias("_h_n"))
    step = F.greatest(F.floor(F.lit(m * slice_rows) / F.col("_h_n")), F.lit(1))
    chosen = F.array_distinct(F.filter("_c", lambda v, i: (i + 1) % step == 0))
    cuts = cuts.where(F.col("_c").isNotNull()).withColumn("_c", chosen).where(F.size("_c") > 0)
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_c") / _CHUNK) - 1), lambda k: F.slice("_c", k.cast("int") * _CHUNK + 1, _CHUNK))
    return cuts.select(*[f"_h_{k}" for k in keys], chunks.alias("_cuts")).checkpoint(eager=True)


def _slice_of(value: Column, nulls_last: bool) -> Column:
    """Number of cuts up to ``value``; 0 for keys that are not cut."""
    chunk = F.size(F.filter("_cuts", lambda c: F.get(c, 0) <= value))
    within = F.size(F.filter(F.get("_cuts", chunk - 1), lambda c: c <= value))
    at = F.when(chunk > 0, (chunk - 1) * _CHUNK + within).otherwise(0)
    null = F.lit(2**30 if nulls_last else 0)
    return F.when(F.col("_cuts").isNull(), 0).when(value.isNull(), null).otherwise(at).cast("int")


def windows(df: DataFrame, keys: Sequence[str], by: str | Column, ties: Sequence[str], out: dict[str, object],
            nulls_last: bool = False, slice_rows: int = SLICE_ROWS, num_partitions: int | None = None) -> DataFrame:
    """``df`` with the columns of ``out`` (name -> one of the functions above), over rows of equal
    ``keys`` ordered by ``by`` and then ``ties``.

    ``by`` is a number, date or timestamp in ascending order (negate a number for descending). Keys
    may be null. ``num_partitions`` is that of the exchange (by default the session's, which
    adaptive execution coalesces). Names that begin with an underscore are used inside.
    """
    keys, ties = list(keys), list(ties)
    rows = df.withColumn("_by", F.col(by) if isinstance(by, str) else by)
    order = [F.col("_by").asc_nulls_last() if nulls_last else F.col("_by").asc_nulls_first(), *ties]
    cuts = _cut_keys(rows, keys, slice_rows)
    if cuts is None:
        own = Window.partitionBy(*keys)
        rows = rows.repartition(num_partitions, *keys) if num_partitions else rows
        return rows.select(*df.columns, *[_inside(f, own, keys, order).alias(name) for name, f in out.items()])
    return _sliced(df, rows, cuts, keys, order, out, nulls_last, num_partitions)


def _inside(f, own, keys: list[str], order: list[Column]) -> Column:
    """The function as a plain window over the partitions of ``own``."""
    ordered, peers = own.orderBy(*order), own.orderBy(order[0])
    if isinstance(f, RowNumber):
        return F.row_number().over(ordered).cast("bigint")
    if isinstance(f, Rank):
        return F.rank().over(peers).cast("bigint")
    if isinstance(f, DenseRank):
        return F.dense_rank().over(peers).cast("bigint")
    if isinstance(f, KeyCount):
        return F.count(F.lit(1)).over(own)
    if isinstance(f, Ntile):
        return F.ntile(f.groups).over(ordered).cast("bigint")
    if isinstance(f, Lag):
        return F.lag(f.column, f.offset).over(ordered)
    if isinstance(f, Lead):
        return F.lead(f.column, f.offset).over(ordered)
    if isinstance(f, SumRows):
        return F.sum(f.column).over(ordered.rowsBetween(1 - f.rows, 0))
    if isinstance(f, LastBefore):
        return F.last(f.column, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    if isinstance(f, CountSpan):
        names = ", ".join(f"`{k}`" for k in keys)
        return F.expr(f"count(1) OVER (PARTITION BY {names} ORDER BY _by RANGE BETWEEN INTERVAL {f.interval} PRECEDING AND CURRENT ROW)")
    raise TypeError(f"not a window function: {f!r}")


def _sliced(df: DataFrame, rows: DataFrame, cuts: DataFrame, keys: list[str], order: list[Column], out: dict[str, object], nulls_last: bool,
            num_partitions: int | None) -> DataFrame:
    spans = {f.interval for f in out.values() if isinstance(f, CountSpan)}
    if len(spans) > 1:
        raise ValueError("one time span per call")
    reach = max([0, *(f.offset for f in out.values() if isinstance(f, (Lag, Lead))), *(f.rows - 1 for f in out.values() if isinstance(f, SumRows))])
    carried = sorted({f.column for f in out.values() if isinstance(f, (Lag, Lead, SumRows))})
    lasts = sorted({f.column for f in out.values() if isinstance(f, LastBefore)})

    # a cut key's broadcast row is bounded by its slices, and there are rows / slice_rows of them at most
    placed = rows.join(F.broadcast(cuts), _same(keys, "_h_"), "left").withColumn("_cut", F.col("_cuts").isNotNull())
    placed = placed.withColumn("_slice", _slice_of(F.col("_by"), nulls_last))
    until = F.lit(None).cast("int")
    if spans:
        until = F.when(F.col("_cut") & F.col("_by").isNotNull(), _slice_of(F.col("_by") + F.expr(f"INTERVAL {spans.copy().pop()}"), nulls_last))
    placed = placed.withColumn("_until", until).drop("_cuts", *[f"_h_{k}" for k in keys])
    if spans:
        to = F.struct(F.col("_slice").alias("s"), F.lit(False).alias("halo"))
        halo = F.struct(F.col("_until").alias("s"), F.lit(True).alias("halo"))
        goes = F.when(F.col("_until") > F.col("_slice"), F.array(to, halo)).otherwise(F.array(to))
        placed = placed.withColumn("_from", F.col("_slice")).withColumn("_to", F.explode(goes)).select(
            *[c for c in placed.columns if c != "_slice"], F.col("_from"), F.col("_to.s").alias("_slice"), F.col("_to.halo").alias("_halo"))
    else:
        placed = placed.withColumn("_halo", F.lit(False))

    # one exchange by (key, slice): it also serves the windows that set the halo apart
    own = Window.partitionBy(*keys, "_slice", "_halo")
    ordered = own.orderBy(*order)
    inside = {f"_f{k}": f for k, f in enumerate(out.values()) if not isinstance(f, Ntile)}
    placed = placed.repartition(num_partitions, *keys, "_slice") if num_partitions else placed.repartition(*keys, "_slice")
    found = placed.select(
        "*", F.row_number().over(ordered).cast("bigint").alias("_rn"), F.count(F.lit(1)).over(own).alias("_n"),
        F.dense_rank().over(own.orderBy(order[0])).cast("bigint").alias("_dense"),
        *[(_inside(f, own, [*keys, "_slice"], order)).alias(c) for c, f in inside.items()])
    found = found.where(~F.col("_halo")).checkpoint(eager=True)

    # a few rows for every slice of a cut key
    row = F.struct("_rn", *[F.col(c).alias(f"v_{c}") for c in carried])
    ends = found.where("_cut").groupBy(*_named(keys, "_s_"), F.col("_slice").alias("_s_slice")).agg(
        F.max("_n").alias("_s_n"), F.max("_dense").alias("_s_dense"),
        F.sort_array(F.collect_list(F.when(F.col("_rn") <= reach, row))).alias("_s_head"),
        F.sort_array(F.collect_list(F.when(F.col("_n") - F.col("_rn") < reach, row))).alias("_s_tail"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_rn"))).alias(f"_s_last_{c}") for c in lasts])
    names = [f"_s_{k}" for k in keys]
    if spans:  # rows whose span covers slices as a whole: they start to count behind their own slice and end at the last
        passed = found.where("_cut AND _until > _slice + 1").groupBy(*_named(keys, "_s_"), "_slice", "_until").agg(F.count(F.lit(1)).alias("c"))
        steps = passed.select(*names, F.explode(F.array(F.struct((F.col("_slice") + 1).alias("at"), F.col("c").alias("d")),
                                                         F.struct(F.col("_until").alias("at"), (-F.col("c")).alias("d")))).alias("e"))
        line = ends.select(*names, F.col("_s_slice").alias("at"), F.lit(0).cast("bigint").alias("d"), F.lit(True).alias("real")).unionByName(
            steps.select(*names, "e.at", "e.d", F.lit(False).alias("real")))
        so_far = Window.partitionBy(*names).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
        whole = (line.withColumn("_s_whole", F.sum("d").over(so_far)).where("real")
                 .select(*[F.col(n).alias(f"_w{n}") for n in names], F.col("at").alias("_w_slice"), "_s_whole"))
        same = functools.reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_w{n}")) for n in names])
        ends = ends.join(whole, same & (F.col("_s_slice") == F.col("_w_slice"))).drop("_w_slice", *[f"_w{n}" for n in names])
    by_slice = Window.partitionBy(*names).orderBy("_s_slice")
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    near = max(reach, 1)
    ends = ends.select(
        *names, "_s_slice", F.sum("_s_n").over(Window.partitionBy(*names)).alias("_total"),
        F.coalesce(F.sum("_s_n").over(before), F.lit(0)).alias("_earlier"), F.coalesce(F.sum("_s_dense").over(before), F.lit(0)).alias("_values"),
        F.flatten(F.collect_list("_s_tail").over(by_slice.rowsBetween(-near, -1))).alias("_carry"),
        F.flatten(F.collect_list("_s_head").over(by_slice.rowsBetween(1, near))).alias("_next"),
        *[F.last(f"_s_last_{c}", ignorenulls=True).over(before).alias(f"_last_{c}") for c in lasts],
        *(["_s_whole"] if spans else []))
    joined = found.join(F.broadcast(ends), _same(keys, "_s_") & (F.col("_slice") == F.col("_s_slice")), "left")
    return joined.select(*df.columns, *[_whole(f, f"_f{k}", found).alias(name) for k, (name, f) in enumerate(out.items())])


def _whole(f, inside: str, found: DataFrame) -> Column:
    """The function over the whole key, from its value inside the slice and what was handed over."""
    rn, held = F.col("_rn"), F.col(inside)
    earlier, total = F.coalesce("_earlier", F.lit(0)), F.coalesce("_total", "_n")
    number = rn + earlier
    carry = F.coalesce(F.size("_carry"), F.lit(0))
    if isinstance(f, RowNumber):
        return number
    if isinstance(f, Rank):
        return held + earlier
    if isinstance(f, DenseRank):
        return held + F.coalesce("_values", F.lit(0))
    if isinstance(f, KeyCount):
        return total
    if isinstance(f, Ntile):
        size, more = F.floor(total / f.groups), total % f.groups
        wide = more * (size + 1)
        return F.when(number <= wide, F.floor((number - 1) / (size + 1)) + 1).otherwise(
            more + F.floor((number - 1 - wide) / F.greatest(size, F.lit(1))) + 1).cast("bigint")
    if isinstance(f, Lag):
        return F.when(rn > f.offset, held).otherwise(F.get("_carry", (carry - (f.offset - rn) - 1).cast("int"))[f"v_{f.column}"])
    if isinstance(f, Lead):
        back = F.col("_n") - rn + 1
        return F.when(back > f.offset, held).otherwise(F.get("_next", (f.offset - back).cast("int"))[f"v_{f.column}"])
    if isinstance(f, SumRows):
        kind = found.schema[inside].dataType
        values = F.transform("_carry", lambda r: r[f"v_{f.column}"].cast(kind))
        wanted = F.greatest(F.lit(f.rows) - rn, F.lit(0)).cast("int")
        start = F.greatest(carry - wanted + 1, F.lit(1)).cast("int")
        parts = F.array_compact(F.concat(F.array(held), F.coalesce(F.slice(values, start, wanted), F.array().cast(f"array<{kind.simpleString()}>"))))
        return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind)))
    if isinstance(f, LastBefore):
        return F.coalesce(held, F.col(f"_last_{f.column}"))
    return held + F.coalesce("_s_whole", F.lit(0))
