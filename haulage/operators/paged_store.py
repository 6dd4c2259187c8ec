"""A stored table whose pages are found through a directory.

``write_paged`` sorts a table once over the cluster and stores it in files of bounded size, each a
run of the order, and a directory beside them: per file its first and last key, its rows and how
many rows come before it. A page, however deep, then reads the one or two files it lies in;
``page_after`` goes on from a key the caller saw last (keyset paging), which stays right when
the caller does not know a page number. No rows are numbered.

The order is that of ``keys`` and then of every other sortable column, so only rows that agree in
all columns can change places. The directory has one row per file.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulage.operators.paging import _total_order

ROWS_PER_FILE = 1_000_000


def write_paged(df: DataFrame, keys: Sequence[str], folder: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Store ``df`` in the order of ``keys`` under ``folder``; returns the directory."""
    spark, names = df.sparkSession, list(keys)
    order = _total_order(df, names)
    data, directory = f"{folder}/rows", f"{folder}/directory"
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").option("maxRecordsPerFile", str(rows_per_file)).parquet(data))
    # the whole order, so that files that begin with equal keys stand in order too
    key = F.struct(*order)
    stored = spark.read.schema(df.schema).parquet(data)
    files = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first"), F.max(key).alias("last"))
    before = Window.orderBy("first", "last", "file").rowsBetween(Window.unboundedPreceding, -1)
    files.select("file", "n_rows", "first", "last", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("offset")).write.mode("overwrite").parquet(directory)
    spark.createDataFrame([(n,) for n in names], "key string").coalesce(1).write.mode("overwrite").text(f"{folder}/keys")
    return read_directory(spark, folder)


def read_directory(spark: SparkSession, folder: str) -> DataFrame:
    """(file, n_rows, first, last, offset), one row per file."""
    return spark.read.parquet(f"{folder}/directory")


def _keys(spark: SparkSession, folder: str) -> list[str]:
    return [r[0] for r in spark.read.text(f"{folder}/keys").collect()]


def _from_files(spark: SparkSession, folder: str, found: DataFrame, skip_to: int, size: int) -> DataFrame:
    """``size`` rows from place ``skip_to`` on, out of the files that ``found`` (of the directory) names."""
    files = found.orderBy("offset").collect()       # those a page touches
    whole = spark.read.parquet(f"{folder}/rows")
    if not files:
        return whole.limit(0)
    rows = spark.read.schema(whole.schema).parquet(*[r["file"] for r in files])
    return rows.orderBy(*_total_order(rows, _keys(spark, folder))).offset(max(0, skip_to - files[0]["offset"])).limit(size)


def stored_page(spark: SparkSession, folder: str, size: int, number: int = 0) -> DataFrame:
    """Rows ``number * size`` up to ``number * size + size - 1`` of the stored order."""
    if size <= 0 or number < 0:
        raise ValueError("size must be positive and number non-negative")
    start, end = number * size, (number + 1) * size
    found = read_directory(spark, folder).where((F.col("offset") < end) & (F.col("offset") + F.col("n_rows") > start))
    return _from_files(spark, folder, found, start, size)


def page_after(spark: SparkSession, folder: str, last: Sequence, size: int) -> DataFrame:
    """The next ``size`` rows behind those with key values ``last`` (one for each of the keys)."""
    keys = _keys(spark, folder)
    if len(last) != len(keys):
        raise ValueError(f"{len(keys)} key values are needed: {keys}")
    directory = read_directory(spark, folder)
    types = {f.name: f.dataType for f in directory.schema["last"].dataType.fields}
    seen = F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(keys, last)])
    behind = directory.where(F.struct(*[F.col(f"last.{k}").alias(k) for k in keys]) > seen)
    first = behind.agg(F.min("offset")).first()[0]
    if first is None:
        return spark.read.parquet(f"{folder}/rows").limit(0)
    # rows behind the key that the first file may lack come from the next ones
    at = F.struct(*[F.col(f"first.{k}").alias(k) for k in keys])
    whole = behind.where(at > seen).agg(F.min("offset")).first()[0]
    enough = behind.where(F.lit(True) if whole is None else F.col("offset") < whole + size)
    rows = spark.read.schema(spark.read.parquet(f"{folder}/rows").schema).parquet(*[r["file"] for r in enough.select("file").collect()])
    own = F.struct(*[F.col(k) for k in keys])
    return rows.where(own > seen).orderBy(*_total_order(rows, keys)).limit(size)


def stored_pages(spark: SparkSession, folder: str, size: int) -> DataFrame:
    """One row per page, from the directory alone: page_no, n_rows."""
    total = read_directory(spark, folder).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("t"))
    numbered = total.where("t > 0").select("t", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("t") / size) - 1)).alias("page_no"))
    return numbered.select("page_no", F.least(F.lit(size), F.col("t") - F.col("page_no") * size).cast("long").alias("n_rows"))
