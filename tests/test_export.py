import pytest

from haulage.operators.columns import ReorderConflict
from haulage.plans.export import run_export
from haulage.sinks import archive as Z
from haulage.specs import ColumnSpec as S
from haulage.specs import ExportSpec, Source


def _spec(small, root, fmt, query="SELECT n_nationkey, n_name, n_regionkey FROM nation", **kw):
    return ExportSpec(task_id="task_1", root=root, file_type=fmt,
                      source=Source(kind="sql", query=query, tables={"nation": f"{small}/nation.parquet"}),
                      specs=(S(name="key", column=0, change_order=2),), **kw)


@pytest.mark.parametrize("fmt", [None, "csv", " JSON ", "zip", "xlsx", "parquet"])
def test_run_export_formats(spark, small, scratch, fmt):
    m = run_export(spark, _spec(small, scratch, fmt)).collect()
    assert m and all(r.task_id == "task_1" and r.rows == 25 and r.size > 0 for r in m)
    assert {r.file_type for r in m} == {(fmt or "csv").strip().lower()}


def test_run_export_zip_content(spark, small, scratch):
    run_export(spark, _spec(small, scratch, "zip", single_file=True))
    back = Z.read_zip(spark, scratch + "/task_1")
    assert back.columns == ["n_name", "n_regionkey", "key"] and back.count() == 25


def test_run_export_empty_source_and_errors(spark, small, scratch):
    m = run_export(spark, _spec(small, scratch, "csv", query="SELECT * FROM nation WHERE 1 = 0")).collect()
    assert m and m[0].rows == 0
    with pytest.raises(ValueError):
        run_export(spark, _spec(small, scratch, "xml"))
    with pytest.raises(ValueError):
        ExportSpec(task_id=" ", root=scratch, source=Source(kind="sql", query="SELECT 1"))
    bad = ExportSpec(task_id="t2", root=scratch, file_type="csv",
                     source=Source(kind="sql", query="SELECT 1 AS a, 2 AS b"),
                     specs=(S(column=0, change_order=1), S(column=1, change_order=1)))
    with pytest.raises(ReorderConflict):
        run_export(spark, bad)


def test_run_export_compresslevel(spark, small, scratch):
    fast = run_export(spark, _spec(small, scratch + "/l1", "zip", single_file=True, compresslevel=1)).first()
    best = run_export(spark, _spec(small, scratch + "/l9", "zip", single_file=True, compresslevel=9)).first()
    assert fast.rows == best.rows == 25 and fast.size >= best.size
