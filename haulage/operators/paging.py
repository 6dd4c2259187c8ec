"""Pages, previews, counts and vertical concatenation.

A page is defined by an explicit total order (``keys``); without one, repeated
reads may repeat or skip rows. Nothing here runs on the driver except counts.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType, VariantType

from haulage.operators.ordered import with_row_number

# Most rows a bounded top-k keeps per task ((page + 1) * size); deeper pages are numbered in parallel.
TOP_K_ROWS = 100_000
PREVIEW_ROWS = 100   # rows a preview shows
DEFAULT_PAGE_SIZE = 10


def _cols(keys: Sequence[str | Column]) -> list[Column]:
    if not keys:
        raise ValueError("paging needs ordering keys that make rows unique")
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def _total_order(df: DataFrame, keys: Sequence[str | Column]) -> list[Column]:
    """The keys, then every other column that can be sorted, to settle ties."""
    named = {k for k in keys if isinstance(k, str)}
    rest = [f.name for f in df.schema.fields if f.name not in named and not isinstance(f.dataType, (MapType, VariantType))]
    return [*_cols(keys), *(F.col(f"`{c}`") for c in rest)]


def page(df: DataFrame, keys: Sequence[str | Column], size: int = DEFAULT_PAGE_SIZE,
         number: int = 0, method: str = "auto") -> DataFrame:
    """A4: rows ``number*size .. number*size+size-1`` in ``keys`` order.

    ``method``: ``"topk"`` keeps (number+1)*size rows per task and merges them, at most
    ``TOP_K_ROWS``; ``"numbered"`` numbers all rows in parallel and filters one page; ``"auto"``
    picks top-k while the rows kept stay under that. Both order by ``keys`` and then by all other
    sortable columns, so rows that tie on the keys stand in one order for either method and only rows that
    agree in every column can change places.
    """
    if size <= 0 or number < 0:
        raise ValueError("size must be positive and number non-negative")
    if method not in ("auto", "topk", "numbered"):
        raise ValueError("method must be auto, topk or numbered")
    if method == "topk" and (number + 1) * size > TOP_K_ROWS:
        raise ValueError(f"topk keeps at most {TOP_K_ROWS} rows; number the rows for deeper pages")
    keys = _total_order(df, keys)
    if method == "topk" or (method == "auto" and (number + 1) * size <= TOP_K_ROWS):
        # TakeOrderedAndProject: each task keeps at most (number+1)*size rows.
        return df.orderBy(*keys).offset(number * size).limit(size)
    numbered = with_row_number(df, keys, "_row")
    return (numbered.filter((F.col("_row") >= number * size) & (F.col("_row") < (number + 1) * size))
                    .orderBy("_row").drop("_row"))


def with_page(df: DataFrame, keys: Sequence[str | Column], size: int = DEFAULT_PAGE_SIZE,
              num_partitions: int | None = None) -> DataFrame:
    """A5: every row with its ``row_no`` and ``page_no`` (0-based), numbered in parallel."""
    if size <= 0:
        raise ValueError("size must be positive")
    numbered = with_row_number(df, keys, "row_no", num_partitions)
    return numbered.withColumn("page_no", F.floor(F.col("row_no") / F.lit(size)).cast("bigint"))


def pages(df: DataFrame, keys: Sequence[str], size: int = DEFAULT_PAGE_SIZE,
          num_partitions: int | None = None) -> DataFrame:
    """A5: one row per page: page_no, n_rows, first and last key (first key column)."""
    key = keys[0]
    numbered = with_page(df.select(*keys), keys, size, num_partitions)
    return numbered.groupBy("page_no").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min_by(F.col(key), F.col("row_no")).alias("first_key"),
        F.max_by(F.col(key), F.col("row_no")).alias("last_key"),
    )


def concat_frames(frames: Iterable[DataFrame], schema: StructType | None = None,
                  spark: SparkSession | None = None) -> DataFrame:
    """Strict vertical concatenation; names and types must agree. None -> empty frame."""
    frames = list(frames)
    if not frames:
        if schema is None or spark is None:
            raise ValueError("an empty concatenation needs spark and a schema")
        return spark.createDataFrame([], schema)
    first = frames[0].schema
    for f in frames[1:]:
        if [(x.name, x.dataType) for x in f.schema] != [(x.name, x.dataType) for x in first]:
            raise ValueError(f"schemas differ: {f.schema.simpleString()} vs {first.simpleString()}")
    return reduce(lambda a, b: a.unionByName(b), frames)


def is_empty(df: DataFrame) -> bool:
    """Stops at the first row found."""
    return df.isEmpty()


def emptiness(frames: Mapping[str, DataFrame]) -> DataFrame:
    """C1 for several frames as one table (name, is_empty); one row per frame is looked at."""
    return reduce(lambda a, b: a.unionByName(b), [
        df.select(F.lit(1).alias("_one")).limit(1).agg((F.count("_one") == 0).alias("is_empty")).select(F.lit(name).alias("name"), "is_empty")
        for name, df in frames.items()])


def preview(df: DataFrame, keys: Sequence[str | Column], rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``rows`` rows in a fixed order (a bounded top-k)."""
    return df.orderBy(*_cols(keys)).limit(rows)


def total_rows(df: DataFrame) -> DataFrame:
    """One row with the row count (partial counts per task, one tiny merge)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def preview_notice(total: int, rows: int = PREVIEW_ROWS) -> str | None:
    """Text shown under a preview when the table has more rows than shown."""
    return f"{rows} of {total} rows in view" if total > rows else None


def observed(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """C4: count rows while a sink writes them: no second pass over the data."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("n_rows")), obs


def shape(df: DataFrame) -> tuple[int, int]:
    """C4: (rows, columns)."""
    return df.count(), len(df.columns)
