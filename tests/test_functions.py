from pyspark.sql import functions as F

from haulage.functions import scalars as I


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("  SELECT 1 ;; ", "?&a=1&b", "pg://u:pw@pw/db", "pw", 17)],
                               "q string, p string, dsn string, s string, n int")
    r = df.select(I.clean_sql("q").alias("q"), I.strip_prefix_chars("p").alias("p"),
                  I.head("dsn", 4).alias("h"), I.clamp("n", 0, 9).alias("c"),
                  I.masked("dsn", "s").alias("m"), I.masked("dsn", F.lit("")).alias("m0"),
                  I.task_id_from_time().alias("t")).first()
    assert (r.q, r.p, r.h, r.c) == ("SELECT 1", "a=1&b", "pg:/", 9)
    assert r.m == "pg://u:*****@*****/db" and r.m0 == "pg://u:pw@pw/db" and r.t.startswith("task-")


def test_suffix_and_media(spark):
    df = spark.createDataFrame([("/a/b.ZIP",), ("/a.b/c",), ("x.csv",)], "p string")
    got = [(r.s, r.m) for r in df.select(I.file_suffix("p").alias("s"), I.media_type("p").alias("m")).collect()]
    assert got == [("zip", "application/zip"), ("", I.DEFAULT_MEDIA_TYPE), ("csv", "text/csv")]
