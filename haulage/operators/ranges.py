"""Joins of points and intervals without comparing all pairs.

Intervals are laid out in cells: level L has cells of width ``base`` * 2 ** L, and an interval lies
on the lowest level whose cells are as wide as itself, so it touches two cells at most however
long it is. A point has one cell on every level in use (a few tens at most, since widths double).
Point and interval meet in an equi-join on (keys, level, cell), where the exact condition decides;
they share one cell at most, so each pair comes once.

A cell of over ``cell_rows`` points or intervals is dealt out as a grid: its points over the rows of
the grid, its intervals over the columns, each copied along the other side, so each pair still
meets once. The table of such cells has at most rows / ``cell_rows`` rows, which bounds its broadcast.

Where the pairs are only wanted in sums (``per`` and ``totals``), they are never made. Places (the
distinct times at which something is asked or changes) are cut into slices of their order. Counts
and sums are differences of running totals over the places, inside a slice by a window, with the
slices before it as an offset. For least and greatest values an interval goes to the two slices in
which it ends; the slices that it covers as a whole are covered by two runs of 2 ** k slices, which
meet in a table of a few rows for each slice. So the work grows with the rows of both sides, not
with the pairs, however many meet at one time.

Nulls in a point, a bound or a key join with nothing.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL_ROWS = 200_000
MAX_SLICES = 4096          # beyond, slices grow with the places
_CHUNK = 64                # slice bounds are looked up in two steps of this size
_DAY = 86_400_000_000


@dataclass(frozen=True)
class Count:
    """Pairs."""


@dataclass(frozen=True)
class Sum:
    """Sum of a column of integers or decimals over the pairs; null where all are null."""
    column: str


@dataclass(frozen=True)
class Min:
    """Least value of a column of integers."""
    column: str


@dataclass(frozen=True)
class Max:
    """Greatest value of a column of integers."""
    column: str


def axis(df: DataFrame, column: str) -> Column:
    """A column of numbers, dates or timestamps as numbers in the same order (times in microseconds).
    Timestamps without zone are read off as they stand, so no session zone can fold them."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * _DAY
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
        return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    raise TypeError(f"{column}: {kind.simpleString()} has no order to cut in cells")


def _checked(left: DataFrame, right: DataFrame) -> None:
    both = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if both:
        raise ValueError(f"columns on both sides: {sorted(both)}")


def range_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, keys: Sequence[tuple[str, str]] = (),
               closed: bool = False, after: bool = False, base: float | None = None, cell_rows: int = CELL_ROWS,
               per: Sequence[str] | None = None, totals: Mapping[str, Count | Sum | Min | Max] | None = None) -> DataFrame:
    """Rows of ``points`` with rows of ``intervals`` where ``low`` <= ``at`` < ``high`` (``closed``: also
    ``at`` = ``high``; ``after``: not ``at`` = ``low``) and, for ``keys`` (point column, interval
    column), equal keys. ``base`` is the width of the smallest cells, by default the median length.

    With ``per`` and ``totals`` these rows come grouped by the columns ``per`` of one side, with totals
    of the other side's columns (of points counts and sums, no ``keys``), and no pair is made."""
    _checked(points, intervals)
    start, stop = axis(intervals, low), axis(intervals, high)
    spans = intervals.where(F.col(f"`{low}`") <= F.col(f"`{high}`")).withColumns({"_low": start, "_high": stop})
    spans = spans.where(F.col("_low").isNotNull() & F.col("_high").isNotNull())
    if totals is not None:
        if keys:
            raise ValueError("totals of a join with keys are not built")
        spots = points.withColumn("_at", axis(points, at)).where("_at IS NOT NULL")
        return _totals(spots, spans, list(per or ()), dict(totals), closed, after, cell_rows)
    if base is None:
        base = spans.agg(F.percentile_approx(F.col("_high") - F.col("_low"), 0.5)).first()[0]
    base = base if base and base > 0 else 1     # points as intervals fit cells of any width
    length = F.col("_high") - F.col("_low")
    level = F.when(length <= base, 0).otherwise(F.ceil(F.log2(length / F.lit(base)))).cast("int")
    # rounding of the logarithm must not leave an interval longer than its cell
    level = F.when(F.lit(base) * F.pow(F.lit(2.0), level) < length, level + 1).otherwise(level)
    spans = spans.withColumn("_level", level)
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())
    cell = lambda x, lv: F.floor(x / (F.lit(float(base)) * F.pow(F.lit(2.0), lv)))
    spans = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col("_low"), F.col("_level")), cell(F.col("_high"), F.col("_level")))))
    spots = points.withColumn("_at", axis(points, at)).where("_at IS NOT NULL")
    spots = spots.withColumn("_on", F.explode(F.array(*[F.lit(lv) for lv in levels]).cast("array<int>"))).withColumn("_spot", cell(F.col("_at"), F.col("_on")))
    spots, spans, dealt = _dealt(spots, spans, list(keys), cell_rows)
    same = [(F.col("_on") == F.col("_level")), (F.col("_spot") == F.col("_cell")), *[F.col(f"`{p}`") == F.col(f"`{v}`") for p, v in keys], *dealt]
    inside = (F.col("_at") > F.col("_low") if after else F.col("_at") >= F.col("_low"))
    inside = inside & ((F.col("_at") <= F.col("_high")) if closed else (F.col("_at") < F.col("_high")))
    cond = inside
    for s in same:
        cond = s & cond
    return spots.join(spans, cond).select(*[f"`{c}`" for c in points.columns], *[f"`{c}`" for c in intervals.columns])


def _dealt(spots: DataFrame, spans: DataFrame, keys: list[tuple[str, str]], cell_rows: int) -> tuple[DataFrame, DataFrame, list[Column]]:
    """Both sides with large cells dealt out as grids, and the conditions that make the places meet."""
    names = [f"_k{k}" for k in range(len(keys))]
    one = spots.groupBy(*[F.col(f"`{p}`").alias(n) for n, (p, _) in zip(names, keys)], F.col("_on").alias("_h_level"), F.col("_spot").alias("_h_cell")).agg(
        F.count(F.lit(1)).alias("_p"), F.lit(0).cast("long").alias("_v"))
    two = spans.groupBy(*[F.col(f"`{v}`").alias(n) for n, (_, v) in zip(names, keys)], F.col("_level").alias("_h_level"), F.col("_cell").alias("_h_cell")).agg(
        F.lit(0).cast("long").alias("_p"), F.count(F.lit(1)).alias("_v"))
    large = one.where(F.col("_p") > cell_rows).unionByName(two.where(F.col("_v") > cell_rows)).groupBy(*names, "_h_level", "_h_cell").agg(
        F.ceil(F.greatest(F.max("_p"), F.lit(1)) / cell_rows).cast("int").alias("_rows"), F.ceil(F.greatest(F.max("_v"), F.lit(1)) / cell_rows).cast("int").alias("_cols"))
    large = large.checkpoint(eager=True)
    if large.isEmpty():
        return spots, spans, []

    def place(side: DataFrame, level: str, cell: str, own: list[str], mine: str, other: str, count: str, across: str) -> DataFrame:
        data = [c for c in side.columns]
        at = (F.col(level) == F.col("_h_level")) & (F.col(cell) == F.col("_h_cell"))
        for n, c in zip(names, own):
            at = at & (F.col(n) == F.col(f"`{c}`"))
        # rows / cell_rows rows at most
        found = side.join(F.broadcast(large), at, "left")
        found = found.withColumn(mine, F.pmod(F.xxhash64(*[f"`{c}`" for c in data]), F.coalesce(count, F.lit(1))).cast("int"))
        return found.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(across, F.lit(1)) - 1))).select(*[f"`{c}`" for c in data], mine, other)

    spots = place(spots, "_on", "_spot", [p for p, _ in keys], "_pr", "_pc", "_rows", "_cols")
    spans = place(spans, "_level", "_cell", [v for _, v in keys], "_vc", "_vr", "_cols", "_rows")
    return spots, spans, [F.col("_pr") == F.col("_vr"), F.col("_pc") == F.col("_vc")]


def _totals(spots: DataFrame, spans: DataFrame, per: list[str], totals: dict[str, object], closed: bool, after: bool, slice_rows: int) -> DataFrame:
    """The join grouped by ``per``, from running totals over the places."""
    asks_points = set(per) <= set(spots.columns)
    asked, counted = (spots, spans) if asks_points else (spans, spots)
    if not per or set(per) - set(asked.columns):
        raise ValueError(f"per must be columns of one side: {per}")
    columns = sorted({t.column for t in totals.values() if not isinstance(t, Count)})
    kinds = {c: counted.schema[c].dataType for c in columns}
    extremes = sorted({t.column for t in totals.values() if isinstance(t, (Min, Max))})
    for t in totals.values():
        kind = None if isinstance(t, Count) else kinds[t.column]
        # sums of more digits would be rounded on the way
        fine = kind is None or isinstance(kind, T.IntegralType) or isinstance(t, Sum) and isinstance(kind, T.DecimalType) and kind.precision <= 28 and kind.scale <= 6
        if not fine:
            raise TypeError(f"{t.column}: no exact total of {kind.simpleString()}")
    if extremes and not asks_points:
        raise ValueError("least and greatest values of points are not built")
    if after or not closed:
        spans = spans.where("_low < _high")     # the others hold no point, and running totals would not see that
        asked, counted = (spots, spans) if asks_points else (spans, spots)

    # one row a place: what begins to count there and, of intervals, what ends
    zero = {f"s{i}": F.lit(0).cast("decimal(20,0)" if isinstance(kinds[c], T.IntegralType) else kinds[c]) for i, c in enumerate(columns)}
    own = {"n": F.lit(1).cast("long"), **{f"k{i}": F.col(f"`{c}`").isNotNull().cast("long") for i, c in enumerate(columns)},
           **{f"s{i}": F.coalesce(F.col(f"`{c}`").cast("decimal(20,0)") if isinstance(kinds[c], T.IntegralType) else F.col(f"`{c}`"), zero[f"s{i}"])
              for i, c in enumerate(columns)}}
    ends = {"b": "_low", "e": "_high"} if asks_points else {"b": "_at"}

    def marks_of(side: DataFrame, x: str, end: str | None) -> DataFrame:
        return side.select(F.col(x).alias("_x"), F.lit(end is None).alias("_asked"), *[
            (v if end == e else zero.get(name, F.lit(0).cast("long"))).alias(f"_{e}{name}") for e in ends for name, v in own.items()])

    marks = functools.reduce(DataFrame.unionByName, [*[marks_of(counted, x, e) for e, x in ends.items()],
                                                     *[marks_of(asked, x, None) for x in (["_at"] if asks_points else ["_low", "_high"])]])
    series = marks.columns[2:]
    places = marks.groupBy("_x").agg(F.max("_asked").alias("_asked"), *[F.sum(c).alias(c) for c in series]).checkpoint(eager=True)
    n_places = places.count()
    m = max(1, min(MAX_SLICES, -(-n_places // slice_rows)))
    cuts = places.agg(F.percentile_approx("_x", [k / m for k in range(1, m)], max(10_000, 4 * m))).first()[0] if m > 1 else []
    cuts = sorted(set(cuts or []))
    places = places.withColumn("_slice", _slice(F.col("_x"), cuts))
    # running totals inside a slice, and the slices before it (a few thousand rows at most)
    sums = places.groupBy("_slice").agg(*[F.sum(c).alias(f"_t{c}") for c in series])
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_slice").alias("_o_slice"), *[F.sum(f"_t{c}").over(before).alias(f"_o{c}") for c in series])
    inside = Window.partitionBy("_slice").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = places.select("_x", "_asked", "_slice", *[F.struct(F.sum(c).over(inside).alias("upto"), F.col(c).alias("here")).alias(c) for c in series])
    run = run.where("_asked")
    if cuts:
        run = run.join(F.broadcast(offsets), F.col("_slice") == F.col("_o_slice"))
    upto = lambda c: F.col(f"{c}.upto") + F.coalesce(F.col(f"_o{c}"), F.lit(0)) if cuts else F.col(f"{c}.upto")
    below = lambda c: upto(c) - F.col(f"{c}.here")

    names = list(own)
    if asks_points:
        found = {name: (below if after else upto)(f"_b{name}") - (below if closed else upto)(f"_e{name}") for name in names}
        at = run.select("_x", *[v.alias(f"_{name}") for name, v in found.items()])
        for i, c in enumerate(extremes):
            at = at.join(_extremes(places.where("_asked").select("_x", "_slice"), counted, c, cuts, closed, after, f"_l{i}", f"_g{i}"), "_x", "left")
        rows = asked.select(*[F.col(f"`{c}`") for c in per], F.col("_at").alias("_x")).join(at, "_x").where("_n > 0")
    else:
        at = run.select("_x", *[f(f"_b{name}").alias(f"{to}{name}") for name in names for f, to in ((upto, "_u"), (below, "_w"))])
        ask = F.explode(F.array(F.struct(F.col("_high").alias("x"), F.lit(True).alias("plus")), F.struct(F.col("_low").alias("x"), F.lit(False).alias("plus"))))
        rows = asked.select(*[F.col(f"`{c}`") for c in per], ask.alias("_ask")).select(*[F.col(f"`{c}`") for c in per], F.col("_ask.x").alias("_x"), F.col("_ask.plus").alias("_plus"))
        signed = lambda name: F.when(F.col("_plus"), F.col(f"{'_u' if closed else '_w'}{name}")).otherwise(-F.col(f"{'_u' if after else '_w'}{name}"))
        rows = rows.join(at, "_x").select(*[F.col(f"`{c}`") for c in per], *[signed(name).alias(f"_{name}") for name in names])
    out = {"_n": F.sum("_n")}
    for name, t in totals.items():
        if isinstance(t, Count):
            out[name] = F.sum("_n")
        elif isinstance(t, Sum):
            i, kind = columns.index(t.column), kinds[t.column]
            whole = "bigint" if isinstance(kind, T.IntegralType) else f"decimal({min(38, kind.precision + 10)},{kind.scale})"
            out[name] = F.when(F.sum(f"_k{i}") > 0, F.sum(f"_s{i}")).cast(whole)
        else:
            i = extremes.index(t.column)
            out[name] = (F.min(f"_l{i}") if isinstance(t, Min) else F.max(f"_g{i}")).cast(kinds[t.column])
    grouped = rows.groupBy(*[F.col(f"`{c}`") for c in per]).agg(*[v.alias(name) for name, v in out.items()]).where("_n > 0")
    return grouped.select(*[f"`{c}`" for c in per], *[f"`{name}`" for name in totals])


def _slice(value: Column, cuts: list) -> Column:
    """Number of cuts up to ``value``."""
    if not cuts:
        return F.lit(0)
    chunks = F.lit([cuts[k:k + _CHUNK] for k in range(0, len(cuts), _CHUNK)])
    chunk = F.size(F.filter(chunks, lambda c: F.get(c, 0) <= value))
    within = F.size(F.filter(F.get(chunks, chunk - 1), lambda c: c <= value))
    return F.when(chunk > 0, (chunk - 1) * _CHUNK + within).otherwise(0).cast("int")


def _extremes(asked: DataFrame, spans: DataFrame, column: str, cuts: list, closed: bool, after: bool, least: str, greatest: str) -> DataFrame:
    """(_x, least, greatest) of ``column`` over the intervals that hold an asked place."""
    rows = spans.where(F.col(f"`{column}`").isNotNull()).select("_low", "_high", F.col(f"`{column}`").cast("long").alias("_v"),
                                                               _slice(F.col("_low"), cuts).alias("_i"), _slice(F.col("_high"), cuts).alias("_j"))
    both = [F.min("_v").alias("_least"), F.max("_v").alias("_greatest")]
    none = F.lit(0).cast(rows.schema["_low"].dataType)
    ends = rows.withColumn("_slice", F.explode(F.array_distinct(F.array("_i", "_j")))).select(
        "_slice", "_v", (F.col("_slice") > F.col("_i")).alias("_open_low"), (F.col("_slice") < F.col("_j")).alias("_open_high"), "_low", "_high")
    ends = ends.withColumns({"_low": F.when(F.col("_open_low"), none).otherwise(F.col("_low")), "_high": F.when(F.col("_open_high"), none).otherwise(F.col("_high"))})
    parts = ends.groupBy("_slice", "_open_low", "_open_high", "_low", "_high").agg(*both)
    if len(cuts) > 1:
        # whole slices between: two runs of 2 ** k slices, which may overlap
        runs = rows.where("_j - _i > 1").withColumn("_k", F.floor(F.log2(F.col("_j") - F.col("_i") - 1)).cast("int"))
        runs = runs.withColumn("_run", F.expr("shiftleft(1, _k)")).withColumn("_s", F.explode(F.array(F.col("_i") + 1, F.col("_j") - F.col("_run"))))
        runs = runs.groupBy("_s", "_run").agg(*both).withColumn("_slice", F.explode(F.sequence(F.col("_s"), F.col("_s") + F.col("_run") - 1)))
        whole = runs.groupBy("_slice").agg(F.min("_least").alias("_least"), F.max("_greatest").alias("_greatest"))
        parts = parts.unionByName(whole.select("_slice", F.lit(True).alias("_open_low"), F.lit(True).alias("_open_high"), none.alias("_low"), none.alias("_high"), "_least", "_greatest"))

    def spread(places: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(places["_x"].to_numpy())
        first = np.where(held["_open_low"], 0, np.searchsorted(x, held["_low"].to_numpy(), "right" if after else "left"))
        last = np.where(held["_open_high"], len(x), np.searchsorted(x, held["_high"].to_numpy(), "right" if closed else "left"))
        keep = first < last
        first, last = first[keep], last[keep]
        low, high = held["_least"].to_numpy()[keep], held["_greatest"].to_numpy()[keep]
        level = np.frexp((last - first).astype("float64"))[1] - 1
        lows, highs = np.full(len(x), np.iinfo("int64").max), np.full(len(x), np.iinfo("int64").min)
        for k in range(int(level.max(initial=-1)), -1, -1):
            # a run of 2 ** (k + 1) places is two of 2 ** k
            width = 1 << k
            lows[width:], highs[width:] = np.minimum(lows[width:], lows[:-width]), np.maximum(highs[width:], highs[:-width])
            mine = level == k
            for at in (first[mine], last[mine] - width):
                np.minimum.at(lows, at, low[mine])
                np.maximum.at(highs, at, high[mine])
        met = lows <= highs
        return pd.DataFrame({"_x": x[met], least: lows[met], greatest: highs[met]})

    kind = asked.schema["_x"].dataType.simpleString()
    return asked.groupBy("_slice").cogroup(parts.groupBy("_slice")).applyInPandas(spread, f"_x {kind}, {least} long, {greatest} long")


def overlap_join(left: DataFrame, right: DataFrame, left_low: str, left_high: str, right_low: str, right_high: str,
                 keys: Sequence[tuple[str, str]] = (), cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs of half-open intervals that overlap, each once: where the later one starts, inside the
    other. Empty intervals overlap with nothing."""
    _checked(left, right)
    left = left.where(F.col(f"`{left_low}`") < F.col(f"`{left_high}`"))
    right = right.where(F.col(f"`{right_low}`") < F.col(f"`{right_high}`"))
    names = [*left.columns, *right.columns]
    right_later = range_join(right, left, right_low, left_low, left_high, [(r, x) for x, r in keys], cell_rows=cell_rows)
    left_later = range_join(left, right, left_low, right_low, right_high, keys, after=True, cell_rows=cell_rows)
    return right_later.select(*[f"`{c}`" for c in names]).unionByName(left_later.select(*[f"`{c}`" for c in names]))
