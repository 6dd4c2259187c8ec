"""Plain data classes that describe a job: column specs, a source, an export.

They replace the request models of a web service with frozen dataclasses; checks
happen in ``__post_init__`` so that a bad spec fails before any Spark work.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

SPEC_SCHEMA = StructType([
    StructField("name", StringType(), True),
    StructField("column", IntegerType(), True),
    StructField("change_order", IntegerType(), True),
])


@dataclass(frozen=True)
class ColumnSpec:
    """One instruction on a column chosen by zero-based position.

    ``name`` renames the column, ``change_order`` moves it; every field is optional
    and a spec that names no usable column is simply skipped.
    """

    name: str | None = None
    column: int | None = None
    change_order: int | None = None

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> "ColumnSpec":
        return cls(name=data.get("name"), column=data.get("column"),
                   change_order=data.get("change_order"))

    @property
    def renames(self) -> bool:
        return self.column is not None and bool(self.name)

    @property
    def moves(self) -> bool:
        return self.column is not None and self.change_order is not None


def as_specs(items: Iterable[ColumnSpec | Mapping[str, Any]]) -> list[ColumnSpec]:
    return [i if isinstance(i, ColumnSpec) else ColumnSpec.from_dict(i) for i in items]


SOURCE_KINDS = ("sql", "script", "jdbc", "parquet", "csv", "json", "orc", "table")


@dataclass(frozen=True)
class Source:
    """Where the rows come from. ``kind`` is explicit, never guessed from the fields.

    * ``sql``: ``query`` over the tables in ``tables`` (name -> path or DataFrame)
    * ``script``: ``script`` (many statements) then ``query``
      (both with ``args``, values for markers in the text)
    * ``jdbc``: ``query`` run by an external database (``db_type``, ``host`` ...)
    * ``parquet`` / ``csv`` / ``json`` / ``orc``: files at ``path`` with reader ``options``
    * ``table``: a catalog table or view called ``path``
    """

    kind: str
    query: str | None = None
    script: str | None = None
    path: str | None = None
    tables: Mapping[str, Any] = field(default_factory=dict)
    args: Mapping[str, Any] | Sequence[Any] = ()
    options: Mapping[str, str] = field(default_factory=dict)
    db_type: str | None = None
    username: str | None = None
    password: str | None = None
    host: str | None = None
    port: str | None = None
    db_name: str | None = None
    driver: str | None = None
    connection_parameters: str | None = None
    url: str | None = None
    partition_column: str | None = None
    lower_bound: int | None = None
    upper_bound: int | None = None
    num_partitions: int | None = None
    fetch_size: int = 10_000

    def __post_init__(self):
        if self.kind not in SOURCE_KINDS:
            raise ValueError(f"unknown source kind {self.kind!r}; expected one of {SOURCE_KINDS}")

    def __repr__(self) -> str:  # never print the secret
        shown = "*****" if self.password else None
        return f"Source(kind={self.kind!r}, path={self.path!r}, host={self.host!r}, password={shown!r})"

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> "Source":
        return cls(**dict(data))


FILE_TYPES = ("csv", "json", "xlsx", "zip", "parquet")


@dataclass(frozen=True)
class ExportSpec:
    """A whole job: read ``source``, apply ``specs``, write ``file_type`` under ``root/task_id``."""

    task_id: str
    source: Source
    root: str
    specs: tuple[ColumnSpec, ...] = ()
    file_type: str | None = "csv"
    on_conflict: str = "error"
    single_file: bool = False
    rows_per_file: int | None = None
    compresslevel: int | None = None   # ZIP / XLSX deflate level (None: the sink's default)

    def __post_init__(self):
        if not isinstance(self.task_id, str) or not self.task_id.strip():
            raise ValueError("task_id must be a non-empty string")
        if self.on_conflict not in ("error", "drop"):
            raise ValueError("on_conflict must be 'error' or 'drop'")
        object.__setattr__(self, "specs", tuple(as_specs(self.specs)))

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> "ExportSpec":
        data = dict(data)
        source = data.pop("source")
        if not isinstance(source, Source):
            source = Source.from_dict(source)
        return cls(source=source, **data)
