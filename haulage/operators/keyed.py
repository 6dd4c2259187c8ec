"""Keyed tables: upsert change batches into a base table, list, clear, mask.

A list that is scanned per item becomes one aggregation: base and changes are unioned and grouped
by key, ``max_by`` over ``(origin, seq)`` picking the winner. ``max_by`` / ``min_by`` / ``count``
aggregate partially on the map side, so a key that holds a third of all rows is combined inside
each task before the one shuffle. There is one plan for every batch size, so the rows never depend
on how large a batch is; a base with repeated keys is reduced to its latest row per key.

Ordering: a key keeps its first place (``first_seq``), values come from its last
change. ``seq`` must grow across batches (an offset, event id or time).
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.functions.scalars import MASK, masked


def _check_keys(df: DataFrame, keys: Sequence[str], seq: str) -> None:
    missing = [c for c in (*keys, seq) if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} not in {df.columns}")


def _null_key(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def _guard_null_keys(rows: DataFrame, keys: Sequence[str], null_key: str, what: str) -> DataFrame:
    if null_key == "skip":
        return rows.filter(~_null_key(keys))
    if null_key == "error":
        # Raised by the executors while the rows stream: no extra pass over the data.
        # A filter (not a dropped column) so that column pruning cannot remove the check.
        guard = F.when(_null_key(keys), F.raise_error(F.lit(f"upsert: null key in {what}")))
        return rows.filter(F.coalesce(guard.cast("boolean"), F.lit(True)))
    raise ValueError("null_key must be 'error' or 'skip'")


def _grouped(base: DataFrame | None, changes: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """One row per key: winner struct, first position, origin flags and change count."""
    values = [c for c in changes.columns if c not in keys]
    parts = []
    if base is not None:
        # A base made by an earlier upsert keeps the positions it already had.
        base_pos = F.col("first_seq") if "first_seq" in base.columns else F.col(seq)
        base = base.withColumn("_pos", base_pos)
        if sorted(c for c in base.columns if c not in ("first_seq", "_pos")) != sorted(changes.columns):
            raise ValueError(f"base {base.columns} and changes {changes.columns} differ")
        parts.append(base.select(*changes.columns, "_pos").withColumn("_origin", F.lit(0)))
    parts.append(changes.withColumn("_pos", F.col(seq)).withColumn("_origin", F.lit(1)))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    order = F.struct(F.col("_origin"), F.col(seq))
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*values), order).alias("_w"),
        F.min_by(F.col("_pos"), order).alias("first_seq"),
        F.max(F.when(F.col("_origin") == 0, True).otherwise(False)).alias("_in_base"),
        F.sum(F.col("_origin")).alias("_n_changes"),
    )


def upsert(base: DataFrame | None, changes: DataFrame, keys: Sequence[str], seq: str,
           null_key: str = "error") -> DataFrame:
    """Replace rows whose key matches, append the others.

    Returns the columns of ``changes`` (winner's values) plus ``first_seq``, the position the key
    keeps: one row per key, whatever the sizes. A base that repeats a key counts with its latest
    row and its first position. ``null_key="error"`` fails the job on a null key in either table,
    ``"skip"`` drops such rows. ``base=None`` is an empty base.
    """
    keys = list(keys)
    _check_keys(changes, keys, seq)
    changes = _guard_null_keys(changes, keys, null_key, "changes")
    if base is not None:
        base = _guard_null_keys(base, keys, null_key, "base")
    g = _grouped(base, changes, keys, seq)
    return g.select(*keys, "_w.*", "first_seq")


def upsert_counts(base: DataFrame | None, changes: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """One row (added, updated, skipped) for a bulk upsert with null keys skipped.

    A key new to the base counts once as added; every further change of it in the
    same batch counts as updated. Raises at once on an empty batch. Base keys and changes
    meet in one aggregation per key, partially combined before its shuffle.
    """
    keys = list(keys)
    _check_keys(changes, keys, seq)
    if changes.isEmpty():
        raise ValueError("no changes given")
    rows = changes.select(*keys, F.lit(0).alias("_base"), F.lit(1).alias("_n"))
    if base is not None:
        rows = rows.unionByName(base.select(*keys, F.lit(1).alias("_base"), F.lit(0).alias("_n")).filter(~_null_key(keys)))
    per_key = rows.groupBy(*keys).agg(F.max("_base").alias("_base"), F.sum("_n").alias("_n"))
    null = _null_key(keys)
    added = F.sum(F.when(~null & (F.col("_base") == 0), 1).otherwise(0))
    return per_key.agg(
        added.cast("bigint").alias("added"),
        (F.sum(F.when(null, 0).otherwise(F.col("_n"))) - added).cast("bigint").alias("updated"),
        F.sum(F.when(null, F.col("_n")).otherwise(0)).cast("bigint").alias("skipped"))


def latest(df: DataFrame, seq: str) -> DataFrame:
    """The single active row (latest by ``seq``); an empty table gives one null row."""
    return df.agg(F.max_by(F.struct(*df.columns), F.col(seq)).alias("_w")).select("_w.*")


def with_kind(stores: Mapping[str, DataFrame]) -> DataFrame:
    """Several stores as one table with a ``kind`` column (names must agree)."""
    frames = [df.withColumn("kind", F.lit(kind)) for kind, df in stores.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def kind_totals(df: DataFrame, kind: str = "kind") -> DataFrame:
    """Rows per kind plus a total row (kind null), by ROLLUP."""
    return df.rollup(kind).agg(F.count(F.lit(1)).alias("n_rows"))


def clear(df: DataFrame, kind: str | None = None, kind_col: str = "kind") -> DataFrame:
    """Drop one kind, or everything (schema kept)."""
    if kind is None:
        return df.filter(F.lit(False))
    return df.filter(F.col(kind_col).isNull() | (F.col(kind_col) != F.lit(kind)))


def mask_value(df: DataFrame, text_col: str, secret_col: str, out: str | None = None) -> DataFrame:
    """Every occurrence of the secret in the text becomes ``*****``; empty secret: no change."""
    return df.withColumn(out or text_col, masked(text_col, secret_col))


def mask_text(text: str, secret: str | None) -> str:
    """D9 for one driver-side string (e.g. a connection string in a log line)."""
    return text.replace(secret, MASK) if secret else text
