"""Column reshaping by position (rename, reorder, move) as one projection.

All decisions use the schema only, on the driver; the data sees a single ``select``
that Catalyst folds into the scan (column pruning reaches parquet untouched).
"""

from __future__ import annotations

import logging
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType

from haulage.specs import ColumnSpec, as_specs

log = logging.getLogger(__name__)


class ReorderConflict(ValueError):
    """Two columns were sent to the same position."""


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _positional(df: DataFrame) -> DataFrame:
    """Give duplicate input names unique stand-ins so that every position resolves."""
    if len(set(df.columns)) == len(df.columns):
        return df
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def _ref(df: DataFrame, i: int) -> Column:
    return F.col(_quote(df.columns[i]))


def _case_sensitive(df: DataFrame) -> bool:
    return df.sparkSession.conf.get("spark.sql.caseSensitive", "false").lower() == "true"


def check_unique_names(names: Sequence[str], case_sensitive: bool = False) -> None:
    """Raise if two output names clash (also when they differ in case only, unless case-sensitive)."""
    seen: dict[str, str] = {}
    for n in names:
        key = n if case_sensitive else n.lower()
        if key in seen:
            raise ValueError(f"duplicate column name {n!r} (clashes with {seen[key]!r})")
        seen[key] = n


# ---------------------------------------------------------------- plans (driver)

def plan_renames(n_columns: int, specs: Iterable[ColumnSpec]) -> dict[int, str]:
    """Position -> new name. Later specs win; unusable specs are skipped."""
    out: dict[int, str] = {}
    for s in specs:
        if not s.renames:
            continue
        if 0 <= s.column < n_columns:
            out[s.column] = s.name
        else:
            log.warning("rename skipped: position %s outside 0..%s", s.column, n_columns - 1)
    return out


def plan_order(n_columns: int, specs: Iterable[ColumnSpec], on_conflict: str = "error") -> list[int]:
    """Final order of input positions after place-and-fill.

    A column keeps its *first* place in the processing line but its *last* target;
    targets are clamped into range. Columns without a target fill the free slots in
    their original order. When two columns claim one slot the later one stays;
    with ``on_conflict="drop"`` the earlier one is then lost (as the original tool
    did), with ``"error"`` a :class:`ReorderConflict` is raised.
    """
    targets: dict[int, int] = {}
    for s in specs:
        if not s.moves:
            continue
        if not 0 <= s.column < n_columns:
            log.warning("reorder skipped: position %s outside 0..%s", s.column, n_columns - 1)
            continue
        targets[s.column] = min(max(s.change_order, 0), n_columns - 1)
    if not targets:
        return list(range(n_columns))

    owner: dict[int, int] = {}          # slot -> input position
    for pos, slot in targets.items():   # dict order = first time a position was named
        if slot in owner:
            if on_conflict == "error":
                raise ReorderConflict(
                    f"positions {owner[slot]} and {pos} both target slot {slot}")
            log.warning("slot %s taken by %s is overwritten by %s", slot, owner[slot], pos)
        owner[slot] = pos
    free_slots = (s for s in range(n_columns) if s not in owner)
    for pos in (p for p in range(n_columns) if p not in targets):
        owner[next(free_slots)] = pos
    return [owner[s] for s in sorted(owner)]


# ---------------------------------------------------------------- operators

def rename_columns(df: DataFrame, specs: Iterable[ColumnSpec | dict]) -> DataFrame:
    """B1: rename by position, all at once."""
    return apply_specs(df, [ColumnSpec(name=s.name, column=s.column) for s in as_specs(specs)])


def reorder_columns(df: DataFrame, specs: Iterable[ColumnSpec | dict],
                    on_conflict: str = "error") -> DataFrame:
    """Place-and-fill reorder by position."""
    return apply_specs(df, [ColumnSpec(column=s.column, change_order=s.change_order)
                            for s in as_specs(specs)], on_conflict=on_conflict)


def apply_specs(df: DataFrame, specs: Iterable[ColumnSpec | dict],
                on_conflict: str = "error") -> DataFrame:
    """Rename and reorder fused into one ``select``; positions refer to the input."""
    specs = as_specs(specs)
    n = len(df.columns)
    names = list(df.columns)
    if any(s.renames for s in specs):
        for pos, new in plan_renames(n, specs).items():
            names[pos] = new
        check_unique_names(names, _case_sensitive(df))
    order = plan_order(n, specs, on_conflict) if any(s.moves for s in specs) else list(range(n))
    if order == list(range(n)) and names == list(df.columns):
        return df
    df = _positional(df)
    return df.select(*[_ref(df, i).alias(names[i]) for i in order])


def select_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep and order columns by name."""
    return df.select(*[_quote(n) for n in names])


def identity_specs(df: DataFrame) -> list[ColumnSpec]:
    """One spec per column that leaves the frame as it is."""
    return [ColumnSpec(name=c, column=i, change_order=i) for i, c in enumerate(df.columns)]


def move_column(df: DataFrame, src: int, dst: int) -> DataFrame:
    """Take the column at ``src`` out and insert it at ``dst`` (current order)."""
    n = len(df.columns)
    if not (0 <= src < n and 0 <= dst < n):
        raise IndexError(f"move {src} -> {dst} outside 0..{n - 1}")
    if src == dst:
        return df
    order = list(range(n))
    order.insert(dst, order.pop(src))
    names = list(df.columns)
    df = _positional(df)
    return df.select(*[_ref(df, i).alias(names[i]) for i in order])


def rename_display(df: DataFrame, position: int, new_name: str | None) -> DataFrame:
    """Rename one column as typed by a user: trimmed; blank is an error; unchanged is a no-op."""
    if new_name is None:
        return df
    name = new_name.strip()
    if not name:
        raise ValueError("column name cannot be empty")
    if not 0 <= position < len(df.columns):
        raise IndexError(f"position {position} outside 0..{len(df.columns) - 1}")
    if name == df.columns[position]:
        return df
    return apply_specs(df, [ColumnSpec(name=name, column=position)])


def _as_text(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    col = F.col(_quote(name))
    if isinstance(dtype, (ArrayType, MapType, StructType)):
        return F.to_json(col)
    if isinstance(dtype, BinaryType):
        return F.base64(col)
    return col.cast("string")


def text_rows(df: DataFrame, columns: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Header plus rows of text, in a chosen order.

    ``columns`` lists ``(source_name, display_name)``; a source column the table
    lacks becomes an empty string, nulls stay null. The header is the schema.
    """
    if columns is None:
        columns = [(c, c) for c in df.columns]
    check_unique_names([d for _, d in columns], _case_sensitive(df))
    have = set(df.columns)
    return df.select(*[(_as_text(df, src) if src in have else F.lit("")).alias(disp)
                       for src, disp in columns])
