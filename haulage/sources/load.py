"""Readers: one dispatch over source kinds, SQL text, SQL scripts, typed re-read of text."""

from __future__ import annotations

import logging
from typing import Any, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from haulage.specs import Source

log = logging.getLogger(__name__)


def clean_query(text: str | None) -> str:
    """Strip outer blanks and trailing semicolons; an empty query is an error."""
    q = (text or "").strip().rstrip(";").strip()
    if not q:
        raise ValueError("the SQL query must not be empty")
    return q


def register_tables(spark: SparkSession, tables: Mapping[str, Any] | None) -> None:
    """Expose ``name -> DataFrame | parquet path`` as temporary views for SQL text.

    A view of that name is replaced: names given here belong to the text that is run.
    """
    for name, value in (tables or {}).items():
        frame = value if isinstance(value, DataFrame) else spark.read.parquet(str(value))
        frame.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, tables: Mapping[str, Any] | None = None,
            args: Mapping[str, Any] | Sequence[Any] | None = None) -> DataFrame:
    """H0: run caller SQL (Spark SQL dialect) over registered tables; the plan stays lazy.

    ``args`` are values for the text's markers, ``:name`` (a mapping) or ``?`` (a sequence). They go
    to Spark as literals of their type and are never put into the text.
    """
    register_tables(spark, tables)
    return spark.sql(clean_query(text), args=args or None)


def run_script(spark: SparkSession, script: str | None, query: str,
               tables: Mapping[str, Any] | None = None, args: Mapping[str, Any] | None = None) -> DataFrame:
    """Run a multi-statement script (CREATE / INSERT / views ...), then the query.

    The script runs as one Spark SQL compound block, so statement splitting, quoting
    and errors are Spark's; its rows are not asked for, only the query's frame is returned.
    It runs every time it is given: use fresh names or ``CREATE OR REPLACE``. Local variables, loops,
    conditions, handlers and ``EXECUTE IMMEDIATE ... USING`` are Spark's SQL scripting; declarations
    come first. ``args`` are values for ``:name`` markers in the script and in the query.
    """
    if args is not None and not isinstance(args, Mapping):
        raise ValueError("a script takes named values")
    register_tables(spark, tables)
    if script and script.strip():
        body = script.strip()
        if not body.endswith(";"):
            body += ";"
        spark.sql(f"BEGIN\n{body}\nEND", args=args or None)
    return spark.sql(clean_query(query), args=args or None)


# Options that make the CSV round trip keep text as it was written (see sinks.writers).
CSV_READ_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
}


# Only for text that holds line ends: such files are read whole, one task per file.
MULTILINE_OPTIONS = {**CSV_READ_OPTIONS, "multiLine": "true"}


def read_text_table(spark: SparkSession, path: str, infer: bool = True, multiline: bool = False) -> DataFrame:
    """Read CSV written by :func:`haulage.sinks.writers.write_csv`; types inferred over all rows.

    Files are split over tasks at line ends; ``multiline=True`` is for values with line ends.
    """
    reader = spark.read.options(**(MULTILINE_OPTIONS if multiline else CSV_READ_OPTIONS))
    if infer:
        reader = reader.option("inferSchema", "true")
    return reader.csv(path)


def retype_via_text(df: DataFrame, path: str, multiline: bool = False) -> DataFrame:
    """Write as CSV, read back with inferred types (``007`` becomes 7, '' becomes null).

    Kept for parity with tools that pass data through CSV; the export path does not
    use it, because it loses types.
    """
    from haulage.sinks.writers import write_csv

    write_csv(df, path)
    return read_text_table(df.sparkSession, path, infer=True, multiline=multiline)


def load(spark: SparkSession, source: Source | Mapping[str, Any]) -> DataFrame:
    """A1: build the DataFrame a source describes. Nothing is read until an action."""
    if not isinstance(source, Source):
        source = Source.from_dict(source)
    kind = source.kind
    if kind == "sql":
        return run_sql(spark, source.query, source.tables, source.args)
    if kind == "script":
        return run_script(spark, source.script, source.query, source.tables, source.args or None)
    if kind == "jdbc":
        from haulage.sources.jdbc import read_jdbc
        return read_jdbc(spark, source)
    if kind in ("parquet", "csv", "json", "orc"):
        if not source.path:
            raise ValueError(f"a {kind} source needs a path")
        reader = spark.read.format(kind)
        if kind == "csv":
            reader = reader.options(**CSV_READ_OPTIONS)
        return reader.options(**dict(source.options)).load(source.path)
    if kind == "table":
        return spark.table(source.path)
    raise ValueError(f"unsupported source kind {kind!r}")
