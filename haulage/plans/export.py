"""A whole export job — source, column specs, sink, manifest.

The plan has one action: the write. Reading, renaming and reordering are lazy
(one scan and one ``Project``); the row count is observed while the sink writes,
so an empty result is reported without a second pass over the data.
"""

from __future__ import annotations

import logging
import uuid
from typing import Any, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.operators.columns import apply_specs
from haulage.operators.paging import observed
from haulage.session import ensure_checkpoint_dir
from haulage.sinks.writers import manifest, normalize_format, task_path, write_table
from haulage.sources.load import load
from haulage.specs import ExportSpec

log = logging.getLogger(__name__)


def scratch_folder(spark: SparkSession, label: str = "exports") -> str:
    """A fresh folder inside the shared checkpoint folder (never a machine-local one)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/haulage-{label}/{uuid.uuid4().hex}"


def shaped(spark: SparkSession, spec: ExportSpec) -> DataFrame:
    """Source rows after the column specs: the lazy frame an export writes."""
    return apply_specs(load(spark, spec.source), spec.specs, on_conflict=spec.on_conflict)


def run_export(spark: SparkSession, spec: ExportSpec | Mapping[str, Any]) -> DataFrame:
    """Run the job and return its manifest: task_id, path, file_type, media_type, size, rows.

    ``rows`` is the number of data rows written (same value on every manifest row).
    """
    if not isinstance(spec, ExportSpec):
        spec = ExportSpec.from_dict(spec)
    fmt = normalize_format(spec.file_type)
    out = task_path(spec.root, spec.task_id)
    df, obs = observed(shaped(spark, spec), f"export_{uuid.uuid4().hex[:8]}")
    write_table(df, out, fmt, single_file=spec.single_file, entry_name=spec.task_id,
                rows_per_file=spec.rows_per_file, compresslevel=spec.compresslevel)
    n_rows = obs.get.get("n_rows", 0)
    if n_rows == 0:
        log.warning("task %s: the source returned no rows; wrote an empty %s", spec.task_id, fmt)
    files = manifest(spark, out)
    if files.isEmpty():
        raise FileNotFoundError(f"task {spec.task_id}: no output under {out}")
    return files.select(F.lit(spec.task_id).alias("task_id"), "*", F.lit(n_rows).cast("bigint").alias("rows"))
