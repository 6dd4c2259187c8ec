import hashlib
import math
import re
from fractions import Fraction

from awkward import DOC_SCHEMA, doc_rows, documents, empty_documents, ident, prose, result
from haulage.llm import source_mix as M
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("doc_id", "size", "source_size", "target", "taken")


def targets(sizes):
    """Share by weight, stop sources at 3 times their size, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, fixed = Fraction(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / w for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: Fraction(3 * sizes[s]) for s in over}


def weight_of(text):
    if not text:
        return 1.0
    return max(0.25, 1.0 - 5.0 * float(sum(c in "#*$%&|<>" for c in text)) / len(text))


def brute(rows, weight=None):
    docs = []
    for doc_id, text, _, source, *_ in rows:
        name = doc_id if doc_id is not None else "null" if text is None else hashlib.md5(text.encode()).hexdigest()
        u = (int(hashlib.md5(f"mix:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        w = weight_of(text) if weight is None else weight(doc_id)
        key = 1e300 * (1 + -math.log(u)) if w is None else -math.log(u) / w
        docs.append((source, key, ident(doc_id), len(WORD.findall(text or "")), doc_id))
    sizes = {}
    for d in docs:
        sizes[d[0]] = sizes.get(d[0], 0) + d[3]
    want = targets(sizes)
    out, before = [], dict.fromkeys(sizes, 0)
    for source, _, _, size, doc_id in sorted(docs, key=lambda d: d[1:4]):
        epochs = want[source] // sizes[source] if sizes[source] else 0
        budget = want[source] - epochs * sizes[source]
        more = before[source] < budget and 2 * (budget - before[source]) >= size
        before[source] += size
        out.append((doc_id, size, sizes[source], round(float(want[source]), 6), size * (int(epochs) + more)))
    return sorted(out, key=repr)


def rounded(df):
    return sorted(((*r[:3], round(r[3], 6), r[4]) for r in result(df, *COLUMNS)), key=repr)


def lopsided():
    rows = []
    for k in range(300):
        source = "big" if k % 3 else (None if k % 5 == 0 else f"s{k % 7}")
        rows.append((k, prose(k, 1 + (k * 37) % 60), "en", source, 1, None, None, None, None, None))
    return rows


def test_plan_equals_brute_force(spark):
    assert rounded(M.mix_plan(documents(spark))) == brute(doc_rows())
    for buckets in (1, 16, 1024):
        assert rounded(M.mix_plan(documents(spark, lopsided()), buckets=buckets)) == brute(lopsided())


def test_end_buckets_are_cut_until_small(spark):
    for buckets, end_rows in ((2, 1), (3, 5), (1024, 1)):
        assert rounded(M.mix_plan(documents(spark, lopsided()), buckets=buckets, end_rows=end_rows)) == brute(lopsided())
    assert rounded(M.mix_plan(documents(spark), end_rows=1)) == brute(doc_rows())


def test_any_weight_is_defined(spark, monkeypatch):
    """Tiny weights spread over buckets, and rows without a weight come last."""
    rows = lopsided()
    weight = F.when(F.col("doc_id") % 4 == 0, 0.0).when(F.col("doc_id") % 4 == 1, F.lit(None)).when(F.col("doc_id") % 8 == 2, 0.001).otherwise(1e-9)
    of = lambda d: {0: None, 1: None}.get(d % 4, 0.001 if d % 8 == 2 else 1e-9)
    want = brute(rows, of)
    for end_rows in (2, 10**6):
        assert rounded(M.mix_plan(documents(spark, rows), weight=weight, end_rows=end_rows)) == want
    for odd in (-1.0, float("nan")):
        assert rounded(M.mix_plan(documents(spark, rows), weight=F.lit(odd), end_rows=20)) == brute(rows, lambda d: None)


def test_no_document_above_three_epochs_and_sources_near_their_targets(spark):
    plan = M.mix_plan(documents(spark, lopsided())).toPandas()
    assert (plan.taken <= 3 * plan["size"]).all()
    got = plan.groupby(["target", "source_size"]).agg(taken=("taken", "sum"), most=("size", "max")).reset_index()
    assert len(got) == 9 and ((got.taken - got.target).abs() <= got.most).all()
    assert abs(sum(got.taken) - plan["size"].sum()) <= got.most.sum()


def test_target_rule_is_the_iterated_rule(spark):
    cases = [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 5, None: 7}, {"a": 0, "b": 9}, {"only": 4},
             {f"s{k:02d}": (k * k * 7919) % 1000 for k in range(17)}, {"a": 1, "b": 1, "c": 1, "d": 10**9}]
    for sizes in cases:
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in M.source_targets(rows).collect()}
        want = targets(sizes)
        assert all(abs(got[s] - float(want[s])) <= 1e-6 * max(1, float(want[s])) for s in sizes), sizes


def test_heavier_documents_come_first(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    half = rows.unionByName(rows.select((F.col("doc_id") + 4000).alias("doc_id"), "text", F.lit("t").alias("source")))
    plan = M.mix_plan(half, weight=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).toPandas()
    part = plan[(plan.taken == 0) | (plan.taken == 2)]
    part = part[part.groupby("target").taken.transform("sum") < part.groupby("target")["size"].transform("sum")]
    taken = part[part.taken > 0]
    assert (taken.doc_id % 2 == 0).mean() > 0.6


def test_mixed_rows_follow_the_plan(spark):
    docs = documents(spark)
    out = M.mixed(docs)
    assert out.columns == [f.name for f in DOC_SCHEMA]
    plan = {}
    for r in M.mix_plan(docs).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["copies"]
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in plan.items() if v}


def test_empty_table(spark):
    assert M.mix_plan(empty_documents(spark)).count() == 0 and M.mixed(empty_documents(spark)).count() == 0
