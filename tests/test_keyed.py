import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from haulage.operators import keyed as D

SCHEMA = "name string, v int, seq long"


def test_bulk_upsert_golden(spark):
    base = D.upsert(None, spark.createDataFrame([("a", 1, 0), ("b", 2, 1)], SCHEMA), ["name"], "seq")
    changes = spark.createDataFrame([("c", 10, 2), ("a", 11, 3), ("c", 12, 4), (None, 13, 5)], SCHEMA)
    out = D.upsert(base, changes, ["name"], "seq", null_key="skip").orderBy("first_seq").collect()
    assert [(r.name, r.v) for r in out] == [("a", 11), ("b", 2), ("c", 12)]
    counts = D.upsert_counts(base, changes, ["name"], "seq").first()
    assert (counts.added, counts.updated, counts.skipped) == (1, 2, 1)


def test_empty_batch_and_null_key_errors(spark):
    base = spark.createDataFrame([("a", 1, 0)], SCHEMA)
    with pytest.raises(ValueError):
        D.upsert_counts(base, spark.createDataFrame([], SCHEMA), ["name"], "seq")
    null = spark.createDataFrame([(None, 1, 1)], SCHEMA)
    with pytest.raises(PySparkException, match="null key in changes"):  # raised while the rows stream
        D.upsert(base, null, ["name"], "seq").collect()
    with pytest.raises(PySparkException, match="null key in base"):
        D.upsert(null, base, ["name"], "seq").collect()


def test_upsert_twice_equals_once(spark, small):
    ev = spark.read.parquet(f"{small}/events.parquet")
    once = D.upsert(None, ev, ["user_id"], "event_id")
    twice = D.upsert(once, ev, ["user_id"], "event_id")
    assert twice.exceptAll(once).count() == 0 and once.exceptAll(twice).count() == 0


def test_rows_do_not_depend_on_the_batch_size(spark):
    """A base that repeats keys, met by batches of 1 row and of many: one row per key each time."""
    base = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 2), ("b", 4, 3)], SCHEMA)
    for size in (1, 50, 5000):
        changes = spark.createDataFrame([("a", 100 + k, 10 + k) for k in range(size)], SCHEMA)
        got = sorted((r.name, r.v, r.first_seq) for r in D.upsert(base, changes, ["name"], "seq").collect())
        assert got == [("a", 99 + size, 0), ("b", 4, 2)]
        assert tuple(D.upsert_counts(base, changes, ["name"], "seq").first()) == (0, size, 0)


def test_latest_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 2, 5), ("c", 3, 2)], SCHEMA)
    assert D.latest(df, "seq").first().name == "b"
    empty = D.latest(df.filter(F.lit(False)), "seq").collect()
    assert len(empty) == 1 and empty[0].name is None


def test_kinds_and_clear(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    b = spark.createDataFrame([(3,)], "id int")
    both = D.with_kind({"x": a, "y": b})
    totals = {r.kind: r.n_rows for r in D.kind_totals(both).collect()}
    assert totals == {"x": 2, "y": 1, None: 3}
    assert D.clear(both, "x").count() == 1 and D.clear(both).count() == 0


@pytest.mark.parametrize("text, secret, expected", [
    ("pg://u:pw@h/db", "zz", "pg://u:pw@h/db"),
    ("pg://u:pw@h/db", "", "pg://u:pw@h/db"),
    ("pg://u:pw@h/db", "pw", "pg://u:*****@h/db"),
    ("pg://u:pw@pw/db", "pw", "pg://u:*****@*****/db"),
    ("pg://u:ho@host/db", "ho", "pg://u:*****@*****st/db"),
])
def test_masking(spark, text, secret, expected):
    df = spark.createDataFrame([(text, secret)], "t string, s string")
    assert D.mask_value(df, "t", "s").first().t == expected
    assert D.mask_text(text, secret) == expected


def test_upsert_rejects_mismatched_columns(spark):
    base = spark.createDataFrame([("a", 1, 0, "x")], "name string, v int, seq long, extra string")
    changes = spark.createDataFrame([("a", 2, 1)], SCHEMA)
    with pytest.raises(ValueError, match="differ"):
        D.upsert(base, changes, ["name"], "seq")


_names = st.one_of(st.none(), st.sampled_from(["a", "b", "c", "d"]))


@settings(max_examples=12, deadline=None)
@given(base_keys=st.lists(st.sampled_from(["a", "b", "c", "d"]), unique=True, max_size=3),
       batch=st.lists(st.tuples(_names, st.integers(0, 9)), min_size=1, max_size=6))
def test_upsert_properties(spark, base_keys, batch):
    """Keys are the union; a key's value is its last one, its place the first; counts add up."""
    base = spark.createDataFrame([(k, 100 + i, i) for i, k in enumerate(base_keys)], SCHEMA)
    changes = spark.createDataFrame([(k, v, 10 + i) for i, (k, v) in enumerate(batch)], SCHEMA)
    got = [(r.name, r.v) for r in D.upsert(base, changes, ["name"], "seq", null_key="skip").orderBy("first_seq").collect()]
    named = [k for k, _ in batch if k is not None]
    assert [k for k, _ in got] == list(dict.fromkeys(base_keys + named))
    last = {k: 100 + i for i, k in enumerate(base_keys)} | {k: v for k, v in batch if k is not None}
    assert dict(got) == last
    c = D.upsert_counts(base, changes, ["name"], "seq").first()
    assert c.added == len(set(named) - set(base_keys)) and c.added + c.updated == len(named) and c.skipped == len(batch) - len(named)
