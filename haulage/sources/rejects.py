"""Text tables with lines that do not parse: what parses and what does not, both kept.

``load_checked`` reads CSV or JSON lines against a schema in one pass and stores the parsed rows and
the rejected lines (file and text as it stood) side by side, so every line is in one of the two. The
manifest counts both per file.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from haulage.sources.load import CSV_READ_OPTIONS

TEXT = "_rejected_text"


@dataclass(frozen=True)
class Checked:
    """``rows`` as the schema says, ``rejects`` (file, text) and ``manifest`` (file, n_rows, n_rejects)."""
    rows: DataFrame
    rejects: DataFrame
    manifest: DataFrame


def load_checked(spark: SparkSession, path: str, schema: StructType | str, folder: str, kind: str = "csv",
                 options: Mapping[str, str] | None = None) -> Checked:
    """Read ``path`` (``csv`` or ``json``, one record a line) and store the result under ``folder``.

    A CSV line with another number of values than the schema, or any line with a value that is not
    of its column's type, is rejected as a whole; empty lines are no records. Files are split over tasks.
    """
    if kind not in ("csv", "json"):
        raise ValueError(f"unsupported kind {kind!r}")
    wanted = spark.createDataFrame([], schema).schema
    if TEXT in wanted.names or "_file" in wanted.names:
        raise ValueError(f"{TEXT} and _file are used inside")
    reader = spark.read.options(**(CSV_READ_OPTIONS if kind == "csv" else {})).options(**(options or {}))
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", TEXT)
    parsed = reader.schema(StructType([*wanted.fields, StructField(TEXT, StringType())])).format(kind).load(path)
    # one pass over the text: Spark does not offer the rejected lines alone, and two reads could differ
    (parsed.withColumn("_file", F.col("_metadata.file_path")).withColumn("_bad", F.col(TEXT).isNotNull())
     .write.mode("overwrite").partitionBy("_bad").parquet(folder))
    stored = spark.read.schema(StructType([*wanted.fields, StructField(TEXT, StringType()), StructField("_file", StringType()),
                                           StructField("_bad", BooleanType())])).parquet(folder)
    rows = stored.where("NOT _bad").select(*[f"`{c}`" for c in wanted.names])
    rejects = stored.where("_bad").select(F.col("_file").alias("file"), F.col(TEXT).alias("text"))
    manifest = stored.groupBy(F.col("_file").alias("file")).agg(
        F.count(F.when(~F.col("_bad"), 1)).alias("n_rows"), F.count(F.when(F.col("_bad"), 1)).alias("n_rejects"))
    return Checked(rows, rejects, manifest)

