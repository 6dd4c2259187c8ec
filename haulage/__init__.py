"""haulage: fetch, reshape and export tables as Spark jobs.

Main entry points (all return lazy DataFrames unless noted):

* sources:   ``load``, ``run_sql``, ``run_script``
* columns:   ``apply_specs``, ``rename_columns``, ``reorder_columns``, ``move_column``
* paging:    ``page``, ``with_page``, ``pages``, ``preview``
* keyed:     ``upsert``, ``upsert_counts``, ``latest``
* tasks:     ``task_events``, ``latest_status``, ``cancel_outcomes``
* export:    ``run_export`` (runs the job, returns the manifest), ``write_table``
"""

from haulage.session import ensure_checkpoint_dir, get_session, ship_package
from haulage.specs import ColumnSpec, ExportSpec, Source

__all__ = ["ColumnSpec", "ExportSpec", "Source", "ensure_checkpoint_dir", "get_session", "ship_package",
           "load", "run_sql", "run_script", "apply_specs", "rename_columns", "reorder_columns",
           "move_column", "page", "with_page", "pages", "preview", "upsert", "upsert_counts", "latest",
           "task_events", "latest_status", "cancel_outcomes", "run_export", "write_table"]


def __getattr__(name):
    """Import the operator modules only when one of their functions is asked for."""
    import importlib
    homes = {
        "haulage.sources.load": ("load", "run_sql", "run_script"),
        "haulage.operators.columns": ("apply_specs", "rename_columns", "reorder_columns", "move_column"),
        "haulage.operators.paging": ("page", "with_page", "pages", "preview"),
        "haulage.operators.keyed": ("upsert", "upsert_counts", "latest"),
        "haulage.operators.tasks": ("task_events", "latest_status", "cancel_outcomes"),
        "haulage.plans.export": ("run_export",),
        "haulage.sinks.writers": ("write_table",),
    }
    for module, names in homes.items():
        if name in names:
            return getattr(importlib.import_module(module), name)
    raise AttributeError(f"module 'haulage' has no attribute {name!r}")
