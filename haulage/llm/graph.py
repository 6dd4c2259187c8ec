"""Connected components by alternating star contraction, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the undirected ``edges`` (a, b); comp is the smallest node.

    Each round points every node at the smallest node it can see (large star, then small star)
    until nothing changes. Minima are combined before the shuffle, so a hub costs its edges once.
    """
    def state(e):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        return r["n"], r["s"]

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (both.join(low, F.col("a") == F.col("u")).where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        joined = large.join(low, F.col("a") == F.col("u"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = cut(small.where("a <> b").distinct(), "edges")
        now = state(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
