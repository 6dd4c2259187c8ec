"""Built-in sinks (CSV, JSON, parquet), JSON records, manifest and media types.

Every writer runs on the executors, one file per partition; nothing passes through
the driver. ``single_file=True`` coalesces to one writer task and is meant for
small results only.
"""

from __future__ import annotations

import posixpath
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType

from haulage.functions.scalars import DEFAULT_MEDIA_TYPE, MEDIA_TYPES, file_suffix, media_type  # noqa: F401
from haulage.operators.columns import _quote, check_unique_names

FORMATS = ("csv", "json", "xlsx", "zip", "parquet")

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

# Options that keep text as it is: "" quoting, no trimming, microseconds kept.
CSV_WRITE_OPTIONS = {
    "header": "true",
    "escape": '"',
    "quote": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampFormat": TS_FORMAT + "XXX",
    "timestampNTZFormat": TS_FORMAT,
}
LONE_NULL = "\\N"
JSON_WRITE_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": TS_FORMAT + "XXX",
    "timestampNTZFormat": TS_FORMAT,
}


def normalize_format(fmt: str | None) -> str:
    """Null means csv; trimmed and lower-cased; unknown formats are an error."""
    value = "csv" if fmt is None else fmt.strip().lower()
    if value not in FORMATS:
        raise ValueError(f"unsupported export format {fmt!r}; expected one of {FORMATS}")
    return value


def flat_for_text(df: DataFrame) -> DataFrame:
    """Columns a text sink cannot hold become text: nested as JSON, binary as base64."""
    check_unique_names(df.columns, df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true")
    out = []
    for f in df.schema.fields:
        c = F.col(_quote(f.name))
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, BinaryType):
            c = F.base64(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def _writer(df: DataFrame, single_file: bool, mode: str, partition_by: Sequence[str] | None,
            rows_per_file: int | None = None):
    if single_file:
        df = df.coalesce(1)
    elif partition_by:
        # rows of one folder meet in a few tasks; REBALANCE splits a folder that is large
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if rows_per_file:
        w = w.option("maxRecordsPerFile", str(int(rows_per_file)))
    return w


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite",
              partition_by: Sequence[str] | None = None, rows_per_file: int | None = None) -> str:
    """CSV with header; one part file per partition (more with ``rows_per_file``).

    A lone column's null would be an empty line, which CSV readers skip: there it is written as
    ``LONE_NULL`` (read back with ``nullValue``).
    """
    flat = flat_for_text(df)
    options = CSV_WRITE_OPTIONS | ({"nullValue": LONE_NULL} if len(flat.columns) - len(partition_by or ()) == 1 else {})
    _writer(flat, single_file, mode, partition_by, rows_per_file).options(**options).csv(path)
    return path


def write_json(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite",
               partition_by: Sequence[str] | None = None, rows_per_file: int | None = None) -> str:
    """One JSON object per line, null fields kept, types kept (no CSV detour)."""
    check_unique_names(df.columns)
    _writer(df, single_file, mode, partition_by, rows_per_file).options(**JSON_WRITE_OPTIONS).json(path)
    return path


def write_parquet(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite",
                  partition_by: Sequence[str] | None = None, rows_per_file: int | None = None) -> str:
    check_unique_names(df.columns)
    _writer(df, single_file, mode, partition_by, rows_per_file).parquet(path)
    return path


def write_table(df: DataFrame, path: str, fmt: str | None = "csv", single_file: bool = False,
                mode: str = "overwrite", partition_by: Sequence[str] | None = None,
                entry_name: str | None = None, rows_per_file: int | None = None,
                compresslevel: int | None = None) -> str:
    """Write ``df`` under ``path`` in the chosen format; returns the path."""
    kind = normalize_format(fmt)
    if kind == "csv":
        return write_csv(df, path, single_file, mode, partition_by, rows_per_file)
    if kind == "json":
        return write_json(df, path, single_file, mode, partition_by, rows_per_file)
    if kind == "parquet":
        return write_parquet(df, path, single_file, mode, partition_by, rows_per_file)
    from haulage.sinks.archive import write_xlsx, write_zip
    if partition_by:
        raise ValueError(f"partition_by is not supported for {kind}")
    if kind == "zip":
        return write_zip(df, path, entry_name=entry_name, single_file=single_file, mode=mode,
                         rows_per_file=rows_per_file, compresslevel=compresslevel)
    return write_xlsx(df, path, entry_name=entry_name, single_file=single_file, mode=mode,
                      rows_per_file=rows_per_file, compresslevel=compresslevel)


def records(df: DataFrame) -> DataFrame:
    """One JSON object per row (null fields kept); the result stays distributed."""
    check_unique_names(df.columns)
    return df.select(F.to_json(F.struct(*[F.col(_quote(c)) for c in df.columns]),
                               {"ignoreNullFields": "false", "timestampNTZFormat": TS_FORMAT})
                     .alias("record"))


def task_path(root: str, task_id: str) -> str:
    """Output folder of one task."""
    if not task_id or "/" in task_id or task_id in (".", ".."):
        raise ValueError(f"bad task id {task_id!r}")
    return posixpath.join(root.rstrip("/"), task_id)


def rows_per_output(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """(file, file_rows) of every output file of a CSV, JSON or parquet job: a count by file name."""
    kind = normalize_format(fmt)
    reader = spark.read.option("recursiveFileLookup", "true")
    if kind == "csv":
        from haulage.sources.load import MULTILINE_OPTIONS
        df = reader.options(**MULTILINE_OPTIONS).csv(path)
    else:
        df = reader.format(kind).load(path)
    return df.groupBy(F.substring_index(F.input_file_name(), "/", -1).alias("file")).agg(F.count(F.lit(1)).alias("file_rows"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per output file: path, file_type, size, modified. Content is never read.

    Hidden and marker files (``_SUCCESS``, ``.crc``) are skipped by the file index.
    An empty or missing output is an error, as a job must leave its files behind.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select(F.col("path"), F.col("length").alias("size"),
                     F.col("modificationTime").alias("modified")))
    return files.select("path", file_suffix(F.col("path")).alias("file_type"),
                        media_type(F.col("path")).alias("media_type"), "size", "modified")
