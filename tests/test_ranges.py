"""Cell joins against plain comparisons of all pairs."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from haulage.operators import ranges as R
from haulage.plans import catalog


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def drawn(seed, n, span, longest, keys=(1, 2)):
    r = random.Random(seed)
    none = lambda x: None if r.random() < 0.05 else x
    points = [(k, none(r.choice(keys)), none(r.randrange(span))) for k in range(n)]
    spans = []
    for k in range(n):
        a = r.randrange(span)
        spans.append((k, none(r.choice(keys)), none(a), none(a + int(longest * r.random() ** 4) - (r.random() < 0.05))))
    return points, spans


def frames(spark, data):
    return (spark.createDataFrame(data[0], "p int, pk int, at long").repartition(3),
            spark.createDataFrame(data[1], "v int, vk int, lo long, hi long").repartition(2))


def plain(data, keyed, closed=False, after=False):
    return sorted(((*p, *v) for p in data[0] for v in data[1]
                   if None not in (p[2], v[2], v[3]) and (p[2] > v[2] if after else p[2] >= v[2]) and (p[2] <= v[3] if closed else p[2] < v[3])
                   and v[2] <= v[3] and (not keyed or (p[1] is not None and p[1] == v[1]))), key=repr)


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("cell_rows", [5, 10**6])
def test_equals_all_pairs(spark, keyed, cell_rows):
    data = drawn(3, 150, 1000, 400)
    keys = [("pk", "vk")] if keyed else []
    for how in ({}, {"closed": True}, {"after": True}, {"base": 3}):
        got = R.range_join(*frames(spark, data), "at", "lo", "hi", keys, cell_rows=cell_rows, **how)
        assert got.columns == ["p", "pk", "at", "v", "vk", "lo", "hi"]
        assert rows(got) == plain(data, keyed, **{k: x for k, x in how.items() if k != "base"})


def test_one_instant_holds_all(spark):
    """All points and intervals in one cell: dealt out as a grid."""
    data = [(k, 1, 500) for k in range(60)], [(k, 1, 500 - k % 3, 501) for k in range(50)]
    got = R.range_join(*frames(spark, data), "at", "lo", "hi", cell_rows=7)
    assert rows(got) == plain(data, False)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 2**20), span=st.sampled_from([10, 300, 10**6]), longest=st.sampled_from([1, 50, 10**6]))
def test_any_lengths(spark, seed, span, longest):
    data = drawn(seed, 60, span, longest)
    assert rows(R.range_join(*frames(spark, data), "at", "lo", "hi", cell_rows=9)) == plain(data, False)


def test_overlaps_come_once(spark):
    _, a = drawn(5, 90, 600, 200)
    _, b = drawn(6, 90, 600, 200)
    left = spark.createDataFrame(a, "x int, xk int, xlo long, xhi long")
    right = spark.createDataFrame(b, "y int, yk int, ylo long, yhi long")
    got = R.overlap_join(left, right, "xlo", "xhi", "ylo", "yhi", [("xk", "yk")], cell_rows=6)
    assert rows(got) == sorted(((*p, *q) for p in a for q in b if None not in p and None not in q and p[1] == q[1]
                                and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and q[2] < p[3]), key=repr)


def test_kinds_of_axes(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-31 02:30:00.25' AS n, DATE '1969-12-31' AS d, TIMESTAMP '2024-01-01 00:00:01' AS t, 2.5D AS f, 'x' AS s")
    got = df.select(*[R.axis(df, c).alias(c) for c in "ndtf"]).first()
    assert (got.n, got.d, got.t, got.f) == (1711852200250000, -86400000000, 1704067201000000, 2.5)
    with pytest.raises(TypeError):
        R.axis(df, "s")
    with pytest.raises(ValueError):
        R.range_join(df, df, "n", "n", "t")


def test_doubles_and_empty_sides(spark):
    p = spark.range(100).select(F.col("id").alias("p"), (F.col("id") / 7).alias("at"))
    v = spark.range(40).select(F.col("id").alias("v"), (F.col("id") / 3).alias("lo"), (F.col("id") / 3 + 0.5).alias("hi"))
    want = p.crossJoin(v).where("at >= lo AND at < hi")
    assert rows(R.range_join(p, v, "at", "lo", "hi")) == rows(want)
    assert R.range_join(p, v.limit(0), "at", "lo", "hi").count() == 0 and R.range_join(p.limit(0), v, "at", "lo", "hi").count() == 0


def test_intervals_of_no_length(spark):
    p = spark.range(50).select(F.col("id").alias("p"), (F.col("id") * 1e12 / 3).alias("at"))
    v = p.select(F.col("p").alias("v"), F.col("at").alias("lo"), F.col("at").alias("hi"))
    assert R.range_join(p, v, "at", "lo", "hi").count() == 0
    assert rows(R.range_join(p, v, "at", "lo", "hi", closed=True)) == rows(p.join(v, F.col("p") == F.col("v")))


def test_no_nested_loop(spark, small):
    for name in ("h5_range_join", "h5_overlap_join"):
        plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


COUNTED = {"n": R.Count(), "least": R.Min("v"), "most": R.Max("v"), "total": R.Sum("v")}


@pytest.mark.parametrize("how, cell_rows, longest", [({}, 3, 3000), ({}, 10**6, 400), ({"closed": True}, 40, 3), ({"after": True}, 3, 400),
                                                      ({"closed": True, "after": True}, 3, 400)])
def test_totals_equal_those_of_all_pairs(spark, cell_rows, longest, how):
    for seed in (3,):
        data = drawn(seed, 150, 1000, longest)
        # rows that come twice, values that are null and lie anywhere
        data = data[0] + data[0][:20], [(None if k % 7 == 0 else (k * 37) % 101 - 50, *r) for k, (_, *r) in enumerate(data[1] + data[1][:20])]
        points, spans = frames(spark, data)
        pairs = [(p, v) for p in data[0] for v in data[1] if plain(([p], [v]), False, **how)]
        got = R.range_join(points, spans, "at", "lo", "hi", per=["pk", "p"], totals=COUNTED, cell_rows=cell_rows, **how)
        want = {}
        for p, v in pairs:
            want.setdefault((p[1], p[0]), []).append(v[0])
        known = {k: [x for x in vs if x is not None] for k, vs in want.items()}
        assert got.columns == ["pk", "p", "n", "least", "most", "total"]
        assert rows(got) == sorted(((*k, len(vs), min(known[k], default=None), max(known[k], default=None), sum(known[k]) if known[k] else None)
                                    for k, vs in want.items()), key=repr)
        scored = points.withColumn("w", F.expr("CASE WHEN p % 5 > 0 THEN CAST(p / 4 AS DECIMAL(18,2)) END"))
        got = R.range_join(scored, spans, "at", "lo", "hi", per=["v", "vk"], totals={"n": R.Count(), "w": R.Sum("w")}, cell_rows=cell_rows, **how)
        want = {}
        for p, v in pairs:
            want.setdefault((v[0], v[1]), []).append(None if p[0] % 5 == 0 else p[0] / 4)
        assert sorted(((r.v, r.vk, r.n, None if r.w is None else float(r.w)) for r in got.collect()), key=repr) == sorted(
            ((*k, len(ws), sum(w for w in ws if w is not None) if any(w is not None for w in ws) else None) for k, ws in want.items()), key=repr)


def test_totals_make_no_pairs(spark):
    """300,000 intervals around as many points at one instant: 9e10 pairs."""
    many = spark.range(300_000)
    p, v = many.select((F.col("id") % 3).alias("p"), F.lit(5).alias("at")), many.select(F.col("id").alias("v"), F.lit(0).alias("lo"), F.lit(9).alias("hi"))
    got = R.range_join(p, v, "at", "lo", "hi", per=["p"], totals=COUNTED)
    assert rows(got) == [(k, 10**5 * 300_000, 0, 299_999, 10**5 * (299_999 * 150_000)) for k in range(3)]
    got = R.range_join(p.withColumnRenamed("p", "w"), v.withColumn("v", F.col("v") % 2), "at", "lo", "hi", per=["v"], totals={"n": R.Count(), "w": R.Sum("w")})
    assert rows(got) == [(k, 45 * 10**9, 150_000 * 300_000) for k in (0, 1)]


def test_totals_are_exact_or_refused(spark):
    p = spark.createDataFrame([(1, 5, 1.5)], "p int, at int, f double")
    v = spark.createDataFrame([(2**62, 0, 9), (2**62, 6, 9), (-(2**62), 0, 6)], "v long, lo int, hi int")
    assert rows(R.range_join(p, v, "at", "lo", "hi", per=["p"], totals=COUNTED)) == [(1, 2, -(2**62), 2**62, 0)]
    assert R.range_join(p, v.limit(0), "at", "lo", "hi", per=["p"], totals=COUNTED).count() == 0
    assert R.range_join(p.limit(0), v, "at", "lo", "hi", per=["p"], totals=COUNTED).count() == 0
    for bad, per in (({"s": R.Sum("f")}, "v"), ({"s": R.Min("f")}, "v")):
        with pytest.raises(TypeError):
            R.range_join(p, v, "at", "lo", "hi", per=[per], totals=bad)
    with pytest.raises(ValueError):
        R.range_join(p, v, "at", "lo", "hi", per=["p", "v"], totals=COUNTED)
    with pytest.raises(ValueError):
        R.range_join(p, v, "at", "lo", "hi", [("p", "v")], per=["p"], totals=COUNTED)
