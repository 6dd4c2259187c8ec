import hashlib
import random

import numpy as np
from awkward import doc_rows, documents, empty_documents, ident, prose, result
from haulage.llm import lpf_dedup as D
from hypothesis import given, settings
from hypothesis import strategies as st

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows):
    first = {}
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - 49):
            s = raw[k:k + 50]
            first[s] = min(first.get(s, 2**63), ident(doc_id))
    out = []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k:k + 50]] < ident(doc_id):
                gone[k:k + 50] = b"\x01" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((doc_id, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows):
    assert result(D.remove_copies(documents(spark, rows)), *COLUMNS) == brute(rows)


def spliced(seed, n):
    """Documents put together from a few long strings at random cuts, and runs of one letter."""
    r = random.Random(seed)
    pool = [prose(seed * 50 + k, 60) for k in range(6)] + ["ab" * 80, "q" * 170]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(r.randrange(1, 5)):
            t = r.choice(pool)
            a = r.randrange(len(t) - 20)
            parts.append(t[a:a + r.randrange(20, 220)])
        rows.append((r.randrange(1000) * 1000 + k, r.choice(["", " ", "-"]).join(parts)) + (None,) * 8)
    return rows


def test_awkward_rows_equal_brute_force(spark):
    check(spark, doc_rows())


def test_spliced_documents(spark):
    check(spark, spliced(1, 60))


def test_hot_anchors_are_dealt_over_shards(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_CONTEXTS", 3)
    monkeypatch.setattr(D, "SHARD_BYTES", 500)
    check(spark, spliced(2, 60))


def test_empty_table_and_text(spark):
    assert D.remove_copies(empty_documents(spark)).count() == 0
    for r in D.remove_copies(documents(spark), with_text=True).collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=60))
def test_nearest_smaller(values):
    got = D.nearest_smaller(np.array(values, np.int64)).tolist()
    assert got == [max((j for j in range(k) if values[j] < v), default=-1) for k, v in enumerate(values)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.text("ab", min_size=1, max_size=20)), min_size=1, max_size=8))
def test_previous_factors(docs):
    text = np.array([c for _, t in docs for c in [*t.encode(), 256]], np.int64)
    begin = np.cumsum([0] + [len(t) + 1 for _, t in docs])[:-1]
    starts = np.concatenate([np.arange(len(t)) + b for b, (_, t) in zip(begin, docs)])
    owner = np.concatenate([np.full(len(t), d) for d, t in docs])
    raw = text.tolist()

    def common(a, b):
        n = 0
        while max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        return n

    got = D.previous_factors(text, starts, owner, 112)
    for s, d, f in zip(starts.tolist(), owner.tolist(), got.tolist()):
        assert f == max((common(s, t) for t, e in zip(starts.tolist(), owner.tolist()) if e < d), default=0)


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=60, max_size=200), st.integers(0, 9), st.text("abc", max_size=30), st.text("abc", max_size=30))
def test_equal_strings_have_equal_anchors(common, cut, left, right):
    one, two = common.encode(), (left + common[cut:] + right).encode()
    a, b = (dict(zip(x[2].tolist(), x[0].tolist())) for x in (D.anchors(one), D.anchors(two)))
    for k in range(len(one) - 49):
        at = two.find(one[k:k + 50])
        if at >= 0:
            own = {(p - k, g) for p, g in a.items() if k <= p <= k + D.REACH}
            assert own and any((p - at, g) in own for p, g in b.items() if at <= p <= at + D.REACH)
