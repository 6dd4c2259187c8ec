"""Pages found through the directory against the plain order."""

import os

import pytest
from pyspark.sql import functions as F

from haulage.operators import paged_store as N
from haulage.operators import paging as P


def same(got, want):
    return [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


@pytest.fixture(scope="module")
def store(spark, small, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("paged"))
    rows = spark.read.parquet(f"{small}/lineitem.parquet")
    N.write_paged(rows, ["l_suppkey", "l_shipdate"], folder, rows_per_file=400)
    return folder, rows


def test_pages_equal_the_plain_order(spark, store):
    folder, rows = store
    for size, number in ((100, 0), (100, 37), (700, 3), (100, 10_000)):
        assert same(N.stored_page(spark, folder, size, number), P.page(rows, ["l_suppkey", "l_shipdate"], size, number))
    with pytest.raises(ValueError):
        N.stored_page(spark, folder, 0)


def test_a_deep_page_reads_the_files_it_lies_in(spark, store):
    folder, rows = store
    every = [f for f in os.listdir(f"{folder}/rows") if f.endswith(".parquet")]
    page = N.stored_page(spark, folder, 100, 30)
    assert len(every) > 8 and len(page.inputFiles()) <= 2
    size = lambda names: sum(os.path.getsize(n.removeprefix("file://").removeprefix("file:")) for n in names)
    assert size(page.inputFiles()) < 0.3 * size([f"{folder}/rows/{f}" for f in every])
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "TakeOrderedAndProject" in plan


def test_directory_adds_up(spark, store):
    folder, rows = store
    d = N.read_directory(spark, folder).orderBy("offset").collect()
    assert sum(r.n_rows for r in d) == rows.count() and max(r.n_rows for r in d) <= 400
    assert [r.offset for r in d] == [sum(x.n_rows for x in d[:k]) for k in range(len(d))]
    assert all(a.last <= b.first for a, b in zip(d, d[1:]))
    pages = N.stored_pages(spark, folder, 64).collect()
    assert sum(r.n_rows for r in pages) == rows.count() and {r.n_rows for r in pages[:-1]} == {64}


def test_pages_behind_a_key(spark, store):
    folder, rows = store
    last = rows.orderBy("l_suppkey", "l_shipdate").offset(2500).first()
    got = N.page_after(spark, folder, (last.l_suppkey, last.l_shipdate), 150)
    want = rows.where((F.col("l_suppkey") > last.l_suppkey) | ((F.col("l_suppkey") == last.l_suppkey) & (F.col("l_shipdate") > last.l_shipdate)))
    assert same(got, want.orderBy(*P._total_order(rows, ["l_suppkey", "l_shipdate"])).limit(150)) and len(got.inputFiles()) <= 3
    assert N.page_after(spark, folder, (10**9, last.l_shipdate), 5).count() == 0
    with pytest.raises(ValueError):
        N.page_after(spark, folder, (1,), 5)


def test_one_key_and_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(None if k % 3 == 0 else 1, k % 7, None if k % 5 else "x") for k in range(300)], "a int, b int, c string")
    N.write_paged(rows, ["a"], str(tmp_path), rows_per_file=25)
    assert same(N.stored_page(spark, str(tmp_path), 20, 9), P.page(rows, ["a"], 20, 9))
    N.write_paged(rows.limit(0), ["a"], str(tmp_path / "none"))
    assert N.stored_page(spark, str(tmp_path / "none"), 20).count() == 0 and N.stored_pages(spark, str(tmp_path / "none"), 5).count() == 0
