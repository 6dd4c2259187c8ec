import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T

from haulage.llm import pivot_codes as V
from awkward import ident, result

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("x", T.LongType()),
                       T.StructField("roots", T.LongType())])


def plain(rows, rounds=4):
    """The rounds with every entry evaluated, in Python's integers."""
    good = [(ident(i), [math.floor(1024 * x) for x in np.array(v, np.float32).tolist()], lab) for i, v, lab in rows
            if v and len(v) % 4 == 0 and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: r[:2])
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    if not good:
        return []
    w = len(good[0][1]) // 4
    cut = [[tuple(v[k * w:k * w + w]) for k in range(4)] for _, v, _ in good]
    books = [[c[k] for c in cut[:256]] for k in range(4)]

    def at(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for k in range(4):
            own = {}
            for c in cut:
                own.setdefault(at(c[k], books[k])[1], []).append(c[k])
            books[k] = [tuple(sum(x) // len(own[j]) for x in zip(*own[j])) if j in own else e for j, e in enumerate(books[k])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for (i, _, lab), c in zip(good, cut):
        found = [at(c[k], books[k]) for k in range(4)]
        out.append((i, lab, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    total = {}
    for _, lab, _, e in out:
        total[lab] = total.get(lab, 0) + e
    return sorted(((None if i == 2**63 - 1 else i, code, e, total[lab], digest) for i, lab, code, e in out), key=repr)


COLUMNS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "clash", 1, 2) for i, v, lab in rows], SCHEMA)


def awkward(n=330, width=8):
    r = random.Random(5)
    rows = [(k * 2, [r.gauss(0, 0.3) for _ in range(width)], None if k % 5 == 0 else (1 if k % 3 else k % 7)) for k in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(1, None, 1), (3, [], 1), (5, [nan] * width, 1), (7, [inf] + [0.0] * (width - 1), 1), (9, [None] + [0.0] * (width - 1), 2),
             (11, [0.0] * (width - 1), 2), (13, [0.5] * (width + 4), 2), (None, [0.25] * width, 3), (None, [-0.25] * width, None),
             (15, [0.0] * width, 1), (17, [0.0] * width, 1), (17, [-0.0001] * width, 1), (17, [-0.0001] * width, 1), (19, [9000.0] * width, 4)]
    return rows


def test_equals_brute_force(spark):
    rows = awkward()
    out = V.vector_codes(frame(spark, rows).repartition(4))
    assert out.columns == list(COLUMNS)
    assert result(out, *COLUMNS) == plain(rows)


def test_few_rows_and_equal_rows(spark):
    rows = [(4, [1.0, -1.0, 0.5, 0.25], None), (2, [1.0, -1.0, 0.5, 0.25], None), (9, [0.0, 0.1, 0.2, -3.0], 1)]
    assert result(V.vector_codes(frame(spark, rows)), *COLUMNS) == plain(rows)


def test_no_rows_to_keep(spark):
    for rows in ([], [(1, None, 1), (2, [1.0, 2.0], 2)]):
        out = V.vector_codes(frame(spark, rows))
        assert out.collect() == [] and out.columns == list(COLUMNS)


def test_large_components_saturate(spark):
    rows = [(k, [3e38 if k % 2 else -3e38] * 8, 1) for k in range(4)]
    out = V.vector_codes(frame(spark, rows)).collect()
    assert len(out) == 4 and all(r["error"] >= 0 for r in out)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 60), st.integers(1, 40), st.sampled_from([1, 3, 50, 10**6]))
def test_pruned_search_is_exact(seed, n, k, spread):
    r = np.random.default_rng(seed)
    parts, entries = r.integers(-spread, spread + 1, (n, 4)), r.integers(-spread, spread + 1, (k, 4))
    pivots = V.far_apart(entries, 3)
    roots = [V.floor_root(V.squared(x, pivots)) for x in (parts, entries)]
    at, d, _ = V.nearest(parts, roots[0], entries, roots[1])
    full = V.squared(parts, entries)
    assert (at == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()


def test_pivots_save_evaluations():
    r = np.random.default_rng(1)
    entries = r.integers(-400, 400, (256, 16))
    parts = entries[r.integers(0, 256, 3000)] + r.integers(-60, 60, (3000, 16))
    pivots = V.far_apart(entries, V.PIVOTS)
    made = V.nearest(parts, V.floor_root(V.squared(parts, pivots)), entries, V.floor_root(V.squared(entries, pivots)))[2]
    assert made < 0.5 * 256 * len(parts)


@given(st.integers(0, 2**60 - 1))
def test_floor_root(d):
    assert V.floor_root(np.array([d]))[0] == math.isqrt(d)
