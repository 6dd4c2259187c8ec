"""Sketches merged from stored batches against exact counts."""

from pyspark.sql import functions as F

from haulage.operators import sketches as K


def test_estimates_of_merged_batches_are_close(spark, scratch):
    rows = spark.range(400_000).select((F.col("id") % 3).cast("int").alias("g"), F.pmod(F.xxhash64("id"), F.lit(150_000)).alias("u"),
                                       F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10**6)).cast("double").alias("v"), F.floor(F.col("id") / 100_000).alias("day"))
    for day in range(4):
        part = rows.where(F.col("day") == day)
        K.write_batch(K.sketches(part, ["g"], distinct={"u": "u"}, quantiles={"v": "v"}), scratch + "/s", day)
        K.write_batch(K.sketches(part, ["g"], distinct={"u": "u"}, quantiles={"v": "v"}), scratch + "/s", day)   # a repeated attempt
    stored = K.read_batches(spark, scratch + "/s")
    for groups in (["g"], []):
        found = K.merged(stored, groups).select(*groups, "n_rows", K.distinct_estimate("u").alias("d"), *[K.quantile_estimate("v", q).alias(f"q{k}") for k, q in enumerate((0.1, 0.5, 0.99))])
        exact = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.countDistinct("u").alias("x"))
        for r in found.collect():
            x = [e for e in exact.collect() if not groups or e.g == r.g][0]
            own = rows if not groups else rows.where(F.col("g") == r.g)
            assert r.n_rows == x.n and abs(r.d - x.x) <= 0.03 * x.x
            ranks = own.select(*[F.avg((F.col("v") <= r[f"q{k}"]).cast("double")) for k in range(3)]).first()
            assert all(abs(a - b) < 0.01 for a, b in zip(ranks, (0.1, 0.5, 0.99)))


def test_merging_needs_the_sketches_alone(spark, scratch):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("b", None, None), (None, 3, 4.0)], "g string, u int, v double")
    K.write_batch(K.sketches(rows, ["g"], distinct={"u": "u"}, quantiles={"v": "v"}), scratch + "/s", 0)
    K.write_batch(K.sketches(rows.limit(0), ["g"], distinct={"u": "u"}, quantiles={"v": "v"}), scratch + "/s", 1)
    found = K.merged(K.read_batches(spark, scratch + "/s"), ["g"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "hll_u" in plan
    got = sorted(((r.g, r.n_rows, r.d, r.q) for r in found.select("g", "n_rows", K.distinct_estimate("u").alias("d"), K.quantile_estimate("v", 0.5).alias("q")).collect()), key=repr)
    assert got == sorted([("a", 2, 2, 1.0), ("b", 1, 0, None), (None, 1, 1, 4.0)], key=repr)


def test_other_column_kinds(spark):
    rows = spark.sql("SELECT explode(array(DATE '2024-01-01', DATE '2024-01-02', DATE '2024-01-02')) AS d")
    assert K.sketches(rows, [], distinct={"d": "d"}).select(K.distinct_estimate("d")).first()[0] == 2


def test_several_batches_in_one_pass(spark, scratch):
    rows = spark.createDataFrame([(1, "a", 7), (1, "a", 8), (2, "a", 8), (None, "b", 9)], "day int, g string, u int")
    K.write_batches(K.sketches(rows, ["day", "g"], distinct={"u": "u"}), scratch + "/s", "day")
    K.write_batch(K.sketches(rows.where("day = 2"), ["g"], distinct={"u": "u"}), scratch + "/s", 2)      # one of them again
    stored = K.read_batches(spark, scratch + "/s")
    assert {str(r.batch) for r in stored.select("batch").collect()} == {"1", "2", "none"}
    assert {(r.g, r.n_rows, r.d) for r in K.merged(stored, ["g"]).select("g", "n_rows", K.distinct_estimate("u").alias("d")).collect()} == {("a", 3, 2), ("b", 1, 1)}
