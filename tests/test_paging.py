import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from haulage.operators import paging as P
from haulage.operators.ordered import lag_by_key, with_row_number


@pytest.mark.parametrize("n, sizes", [(0, []), (1, [1]), (10, [10]), (20, [10, 10]), (23, [10, 10, 3])])
def test_page_sizes(spark, n, sizes):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = sorted((r.page_no, r.n_rows) for r in P.pages(df, ["k"], 10).collect())
    assert got == list(enumerate(sizes))
    for i, size in enumerate(sizes + [0]):
        assert P.page(df, ["k"], 10, i).count() == size
        assert P.page(df, ["k"], 10, i, method="numbered").count() == size


def test_numbering_equals_window(spark, small):
    li = spark.read.parquet(f"{small}/lineitem.parquet")
    ours = with_row_number(li, li.columns, "rn", num_partitions=7)
    ref = li.withColumn("rn", (F.row_number().over(Window.orderBy(*li.columns)) - 1).cast("bigint"))
    assert ours.exceptAll(ref).count() == 0 and ref.exceptAll(ours).count() == 0


def test_pages_partition_the_table(spark, small):
    o = spark.read.parquet(f"{small}/orders.parquet")
    wp = P.with_page(o, ["o_orderkey"], 7)
    assert wp.select("row_no").distinct().count() == o.count()
    assert wp.drop("row_no", "page_no").exceptAll(o).count() == 0


def test_topk_and_numbered_pages_agree(spark, small):
    o = spark.read.parquet(f"{small}/orders.parquet")
    a = P.page(o, ["o_orderkey"], 25, 13, method="topk")
    b = P.page(o, ["o_orderkey"], 25, 13, method="numbered")
    assert [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()]


def test_lag_by_key_with_hot_key(spark, small):
    ev = spark.read.parquet(f"{small}/events.parquet")
    hot = ev.withColumn("user_id", F.when(F.col("event_type") != "view", F.lit(1)).otherwise(F.col("user_id")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ref = hot.withColumn("prev_event_type", F.lag("event_type").over(w))
    for method in ("arrow", "window"):
        ours = lag_by_key(hot, ["user_id"], ["ts", "event_id"], ["event_type"], num_partitions=9, method=method)
        assert ours.exceptAll(ref).count() == 0 and ref.exceptAll(ours).count() == 0, method


def test_concat_frames(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(2, "y")], "k int, v string")
    assert P.concat_frames([a, b]).count() == 2
    with pytest.raises(ValueError):
        P.concat_frames([a, spark.createDataFrame([(1,)], "k long")])
    empty = P.concat_frames([], schema=a.schema, spark=spark)
    assert empty.count() == 0 and empty.schema == a.schema


def test_preview_and_counts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert P.preview(docs, ["doc_id"]).count() == 100
    total = P.total_rows(docs).first().n_rows
    assert P.preview_notice(total) == f"100 of {total} rows in view"
    assert P.preview_notice(100) is None
    out, obs = P.observed(docs.select("doc_id"))
    out.write.format("noop").mode("overwrite").save()
    assert obs.get["n_rows"] == total
    assert P.shape(docs) == (total, len(docs.columns))


def test_numbering_survives_adaptive_coalescing(spark, small):
    """Many tiny range partitions merged by AQE at run time must keep the global order."""
    li = spark.read.parquet(f"{small}/lineitem.parquet")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        ours = with_row_number(li, li.columns, "rn")
        ref = li.withColumn("rn", (F.row_number().over(Window.orderBy(*li.columns)) - 1).cast("bigint"))
        assert ours.exceptAll(ref).count() == 0 and ref.exceptAll(ours).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_hot_leading_key_is_split_across_partitions(spark, small):
    """One value of the first key holds a third of the rows; range partitions stay balanced."""
    from haulage.operators.ordered import ranged

    li = spark.read.parquet(f"{small}/lineitem.parquet")
    hot = li.withColumn("k", F.when(F.col("l_linenumber") <= 3, F.lit(7)).otherwise(F.col("l_orderkey")))
    share = hot.filter(F.col("k") == 7).count() / hot.count()
    assert share > 0.3
    tagged, offsets = ranged(hot, ["k"] + li.columns, num_partitions=8)
    sizes = [r["count"] for r in tagged.groupBy("_pid").count().collect()]
    hot_parts = tagged.filter(F.col("k") == 7).select("_pid").distinct().count()
    assert hot_parts >= 2                              # the hot key spans several tasks
    assert max(sizes) <= 2.5 * sum(sizes) / 8          # no partition near a third of the rows
    assert offsets.count() == len(sizes)
