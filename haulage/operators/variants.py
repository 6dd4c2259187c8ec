"""JSON of mixed shape as VARIANT columns: parsed once per row, read by path and type.

A field that is missing, null or of another type reads as null; text that is no JSON is told apart
(``malformed``), not lost. The shapes that a column holds are one aggregate.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_fields(df: DataFrame, column: str, fields: Mapping[str, tuple[str, str]], malformed: str | None = None,
                kind: str | None = None) -> DataFrame:
    """``df`` with a column per name -> (path, type) out of the JSON text in ``column``; optionally
    ``malformed`` (boolean: text that does not parse) and ``kind`` (object, array, string, ...).

    Paths are JSON paths such as ``$.a.b[0]``. The text is parsed once for all fields.
    """
    v = F.col("_variant")
    parsed = df.withColumn("_variant", F.try_parse_json(F.col(f"`{column}`")))
    out = [F.try_variant_get(v, path, type_).alias(name) for name, (path, type_) in fields.items()]
    if malformed:
        out.append((v.isNull() & F.col(f"`{column}`").isNotNull()).alias(malformed))
    if kind:
        out.append(kind_of(v).alias(kind))
    return parsed.select(*[f"`{c}`" for c in df.columns], *out)


def kind_of(variant: Column) -> Column:
    """object, array, string, number, boolean or null; null where there is no variant."""
    shape = F.schema_of_variant(variant)
    return (F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string")
            .when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").when(variant.isNotNull(), "number"))


def shape_of(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """The merged schema of the JSON texts of a column, per group: one row each, ``shape``."""
    return df.groupBy(*(by or [])).agg(F.schema_of_variant_agg(F.try_parse_json(F.col(f"`{column}`"))).alias("shape"))
