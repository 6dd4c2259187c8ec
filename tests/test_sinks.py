import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from haulage.plans.readback import read_sheets
from haulage.sinks import archive as Z
from haulage.sinks import writers as E

EDGE_SCHEMA = "i int, n string, e string, d double, q string"
EDGE_ROWS = [(1, None, "", 1.0, 'a"b,c\nd'), (2, "x", " y ", 1e-9, "007")]


def _edge(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)


def _local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def test_format_dispatch():
    assert E.normalize_format(None) == "csv" and E.normalize_format(" ZIP ") == "zip"
    with pytest.raises(ValueError):
        E.normalize_format("xml")


def test_csv_round_trip_keeps_text(spark, scratch):
    df = _edge(spark)
    path = E.write_csv(df, scratch + "/csv")
    from haulage.sources.load import MULTILINE_OPTIONS
    back = {r.i: r for r in spark.read.options(**MULTILINE_OPTIONS).schema(df.schema).csv(path).collect()}
    assert back[1].q == 'a"b,c\nd' and back[2].e == " y " and back[2].q == "007" and back[2].d == 1e-9
    assert back[1].n is None  # null stays null; '' is written as "" (read back by Spark as null or '')


def test_json_keeps_nulls_and_types(spark, scratch):
    ts = dt.datetime(2024, 1, 2, 3, 4, 5, 123456)
    df = spark.createDataFrame([(1, None, ts, [1, 2])], "i int, n string, t timestamp_ntz, a array<int>")
    path = E.write_json(df, scratch + "/json")
    text = spark.read.text(path).first().value
    assert '"n":null' in text and "2024-01-02T03:04:05.123456" in text
    back = spark.read.schema(df.schema).options(timestampNTZFormat=E.TS_FORMAT).json(path).first()
    assert back.t == ts and back.a == [1, 2]


def test_duplicate_names_rejected(spark, scratch):
    df = spark.createDataFrame([(1, 2)], "a int, b int").toDF("a", "A")
    with pytest.raises(ValueError):
        E.write_csv(df, scratch + "/dup")


def test_zip_sink(spark, scratch):
    df = _edge(spark).repartition(2)
    path = Z.write_zip(df, scratch + "/zip", entry_name="task_1")
    files = sorted(r.path for r in E.manifest(spark, path).collect())
    assert len(files) == 2 and all(f.endswith(".zip") for f in files)
    for f in files:
        with zipfile.ZipFile(_local(f)) as zf:
            assert len(zf.namelist()) == 1 and zf.namelist()[0].endswith(".csv")
    back = Z.read_zip(spark, path)
    assert sorted((r.i, r.q) for r in back.collect()) == [("1", 'a"b,c\nd'), ("2", "007")]
    # one file when asked; same input gives the same bytes
    one = Z.write_zip(_edge(spark), scratch + "/zip1", entry_name="task_1", single_file=True)
    two = Z.write_zip(_edge(spark), scratch + "/zip2", entry_name="task_1", single_file=True)
    names = [Z.published(p)[0] for p in (one, two)]
    assert open(names[0], "rb").read() == open(names[1], "rb").read()
    with zipfile.ZipFile(names[0]) as zf:
        assert zf.namelist()[0].startswith("task_1") and zf.namelist()[0].endswith(".csv")


def test_xlsx_sink_rolls_over(spark, scratch, small):
    nation = spark.read.parquet(f"{small}/nation.parquet").coalesce(1)
    path = Z.write_xlsx(nation, scratch + "/xlsx", rows_per_file=10)
    m = E.manifest(spark, path).collect()
    assert len(m) == 3 and {r.media_type for r in m} == {E.MEDIA_TYPES["xlsx"]}
    back = read_sheets(spark, path, nation.columns).select(F.col("n_nationkey").cast("int").alias("k"), "n_name")
    assert back.count() == 25
    assert back.exceptAll(nation.select(F.col("n_nationkey").alias("k"), "n_name")).count() == 0


def test_xlsx_keeps_every_character_and_digit(spark, scratch):
    from decimal import Decimal
    rows = [("<a & b>", "x\x01y\rz", "_x0041_", Decimal("12345678901234567890.1234567891"), 2**53 + 1, 0.5), (None, "", "_", None, None, None)]
    df = spark.createDataFrame(rows, "s string, c string, e string, d decimal(30,10), b long, f double")
    path = Z.write_xlsx(df.coalesce(1), scratch + "/esc", entry_name="task_9")
    got = sorted(map(tuple, read_sheets(spark, path, df.columns).collect()), key=repr)
    assert got == sorted([("<a & b>", "x\x01y\rz", "_x0041_", "12345678901234567890.1234567891", str(2**53 + 1), "0.5"),
                          (None, "", "_", None, None, None)], key=repr)
    assert all("/task_9" in f for f in Z.published(path))


def test_xlsx_refuses_text_that_no_cell_holds(spark, scratch):
    with pytest.raises(Exception, match="does not fit a cell"):
        Z.write_xlsx(spark.createDataFrame([("x" * 32_768,)], "s string"), scratch + "/long")


@pytest.mark.parametrize("kind", ["zip", "xlsx"])
def test_append_adds_and_overwrite_replaces(spark, scratch, kind):
    path = f"{scratch}/jobs-{kind}"
    write = Z.write_zip if kind == "zip" else Z.write_xlsx
    read = (lambda: Z.read_zip(spark, path)) if kind == "zip" else (lambda: read_sheets(spark, path, ["id"]))
    write(spark.range(10), path)
    write(spark.range(10, 20), path, mode="append")
    assert sorted(int(r.id) for r in read().collect()) == list(range(20))
    assert {f.path for f in E.manifest(spark, path).collect()} == {f"file:{p}" for p in Z.published(path)}
    write(spark.range(5), path)
    assert sorted(int(r.id) for r in read().collect()) == list(range(5))
    with pytest.raises(Exception, match="boom"):
        write(spark.range(50).select(F.when(F.col("id") == 7, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).alias("id")), path)
    assert sorted(int(r.id) for r in read().collect()) == list(range(5))  # a failed overwrite takes nothing away


def test_lone_column_keeps_its_null_rows(spark, scratch):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "c string").coalesce(1)
    from haulage.sources.load import CSV_READ_OPTIONS
    path = E.write_csv(df, scratch + "/lone")
    assert spark.read.options(**CSV_READ_OPTIONS, nullValue=E.LONE_NULL).csv(path).exceptAll(df).count() == 0
    assert spark.read.options(**CSV_READ_OPTIONS, nullValue=E.LONE_NULL).csv(path).count() == 3
    back = Z.read_zip(spark, Z.write_zip(df, scratch + "/lonezip"))
    assert sorted(r.c or "" for r in back.collect()) == ["", "a", "b"]


def test_manifest_and_media(spark, scratch):
    p = E.write_csv(spark.range(3), scratch + "/m")
    m = E.manifest(spark, p).collect()
    assert m and all(r.file_type == "csv" and r.media_type == "text/csv" and r.size > 0 for r in m)
    df = spark.createDataFrame([("a/b.JSON",), ("x.tar.gz",), ("noext",), ("d.xlsx",)], "p string")
    got = [r.m for r in df.select(E.media_type(F.col("p")).alias("m")).collect()]
    assert got == ["application/json", "application/octet-stream", "application/octet-stream",
                   E.MEDIA_TYPES["xlsx"]]


def test_records(spark):
    df = spark.createDataFrame([(1, None)], "i int, n string")
    assert E.records(df).first().record == '{"i":1,"n":null}'


def test_task_path():
    assert E.task_path("/r/", "t1") == "/r/t1"
    with pytest.raises(ValueError):
        E.task_path("/r", "../x")


def test_xlsx_non_finite_numbers_become_text(spark, scratch):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 2.5), (4, None)], "i long, d double")
    path = Z.write_xlsx(df, scratch + "/nan")
    got = {r.i: r.d for r in read_sheets(spark, path, df.columns).collect()}
    assert got == {"1": "nan", "2": "inf", "3": "2.5", "4": None}


def test_rows_per_file_for_text_sinks(spark, scratch, small):
    nation = spark.read.parquet(f"{small}/nation.parquet").coalesce(1)
    for fmt in ("csv", "json", "parquet"):
        path = E.write_table(nation, scratch + "/rpf_" + fmt, fmt, rows_per_file=10)
        assert len(E.manifest(spark, path).collect()) == 3


def test_failed_archive_write_leaves_nothing(spark, scratch):
    """A job that fails mid-write publishes no archive and removes its folder."""
    import os

    df = spark.range(100).select(
        F.when(F.col("id") == 77, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).alias("id"))
    target = scratch + "/failed"
    with pytest.raises(Exception, match="boom"):
        Z.write_zip(df.repartition(3), target)
    local = _local(target)
    assert not [f for _, _, files in os.walk(local) for f in files if f.endswith(".zip")]
    assert Z.published(target) == []


def _stream_in(spark, scratch, *ids):
    spark.createDataFrame([(i, f"text {i}, \"x\"") for i in ids], "id long, note string").coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    return spark.readStream.schema("id long, note string").parquet(f"{scratch}/in")


def test_a_restarted_stream_publishes_each_row_once(spark, scratch):
    """The query is started again; a batch whose commit was noted by the sink but not by Spark (a
    kill in between) runs again and takes the place of its first attempt."""
    import os
    out, ck = f"{scratch}/out", f"{scratch}/ck"
    ids = lambda: sorted(int(r.id) for r in Z.read_zip(spark, out).collect())
    Z.zip_stream(_stream_in(spark, scratch, 1, 2, 3), out, ck).awaitTermination()
    Z.zip_stream(_stream_in(spark, scratch, 4, 5), out, ck).awaitTermination()
    assert ids() == [1, 2, 3, 4, 5]
    for name in ("1", ".1.crc"):                       # as if killed before Spark noted batch 1
        os.remove(f"{ck}/commits/{name}".removeprefix("file:"))
    Z.zip_stream(spark.readStream.schema("id long, note string").parquet(f"{scratch}/in"), out, ck).awaitTermination()
    assert ids() == [1, 2, 3, 4, 5]
    Z.zip_stream(_stream_in(spark, scratch, 6), out, ck).awaitTermination()
    assert ids() == [1, 2, 3, 4, 5, 6]
    before = Z.remove_unpublished(out)
    assert before >= 1 and ids() == [1, 2, 3, 4, 5, 6] and Z.remove_unpublished(out) == 0


def test_a_batch_that_fails_publishes_nothing(spark, scratch):
    out, ck = f"{scratch}/out", f"{scratch}/ck"
    rows = _stream_in(spark, scratch, 1, 2)
    Z.xlsx_stream(rows, out, ck).awaitTermination()
    assert len(Z.published(out)) == 1
    long = spark.createDataFrame([(9, "x" * 40_000)], "id long, note string")
    long.coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    with pytest.raises(Exception):
        Z.xlsx_stream(spark.readStream.schema("id long, note string").parquet(f"{scratch}/in"), out, ck).awaitTermination()
    assert len(Z.published(out)) == 1


def test_two_streams_write_one_folder(spark, scratch):
    for k in (1, 2):
        Z.zip_stream(_stream_in(spark, f"{scratch}/{k}", k, k + 10), f"{scratch}/out", f"{scratch}/ck{k}").awaitTermination()
    assert sorted(int(r.id) for r in Z.read_zip(spark, f"{scratch}/out").collect()) == [1, 2, 11, 12]
