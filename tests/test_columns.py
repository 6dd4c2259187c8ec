import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from haulage.operators import columns as B
from haulage.specs import ColumnSpec as S

ABCD = ["a", "b", "c", "d"]


def names(order, cols=ABCD):
    return [cols[i] for i in order]


@pytest.mark.parametrize("specs, drop, expected", [
    ([(3, 0)], None, "dabc"),
    ([(0, 3)], None, "bcda"),
    ([(0, 9)], None, "bcda"),
    ([(1, -5)], None, "bacd"),
    ([(0, 2), (2, 0)], None, "cbad"),
    ([(7, 0)], None, "abcd"),
    ([(-1, 0)], None, "abcd"),
    ([(0, 1), (0, 3)], None, "bcda"),
    ([(0, 1), (1, 1)], "drop", "cbd"),
    ([(0, 2), (1, 2)], "drop", "cdb"),
    ([(0, 2), (1, 1), (0, 1)], "drop", "cbd"),
    ([(i, i) for i in range(4)], None, "abcd"),
])
def test_reorder_golden(specs, drop, expected):
    specs = [S(column=c, change_order=t) for c, t in specs]
    assert "".join(names(B.plan_order(4, specs, on_conflict=drop or "error"))) == expected


@pytest.mark.parametrize("specs", [[(0, 1), (1, 1)], [(0, 2), (1, 2)], [(0, 2), (1, 1), (0, 1)]])
def test_reorder_collision_raises_by_default(specs):
    with pytest.raises(B.ReorderConflict):
        B.plan_order(4, [S(column=c, change_order=t) for c, t in specs])


def _frame(spark, cols):
    return spark.createDataFrame([tuple(range(len(cols)))], ", ".join(f"`{c}` int" for c in cols))


def test_rename_golden(spark):
    df = _frame(spark, ["a", "b", "c"])
    assert B.rename_columns(df, [S(name="b", column=0), S(name="a", column=1)]).columns == ["b", "a", "c"]
    assert B.rename_columns(df, [S(name="x", column=0), S(name="y", column=0)]).columns == ["y", "b", "c"]
    skipped = [S(name="x", column=5), S(name="x", column=-1), S(name="", column=0), S(column=1), S(name="z")]
    assert B.rename_columns(df, skipped).columns == ["a", "b", "c"]
    with pytest.raises(ValueError, match="duplicate"):
        B.rename_columns(df, [S(name="b", column=0)])
    with pytest.raises(ValueError, match="duplicate"):
        B.rename_columns(df, [S(name="B", column=0)])


def test_reorder_on_data_keeps_values(spark):
    df = _frame(spark, ABCD)
    out = B.reorder_columns(df, [S(column=3, change_order=0)])
    assert out.columns == list("dabc") and tuple(out.first()) == (3, 0, 1, 2)
    dropped = B.reorder_columns(df, [S(column=0, change_order=1), S(column=1, change_order=1)], "drop")
    assert dropped.columns == list("cbd") and tuple(dropped.first()) == (2, 1, 3)


def test_apply_specs_positions_refer_to_input(spark):
    df = _frame(spark, ABCD)
    out = B.apply_specs(df, [S(name="x", column=0, change_order=3), S(name="y", column=3)])
    assert out.columns == ["b", "c", "y", "x"] and tuple(out.first()) == (1, 2, 3, 0)


def test_move_sequence_differs_from_reorder(spark):
    df = _frame(spark, ABCD)
    assert B.move_column(B.move_column(df, 0, 2), 1, 3).columns == list("badc")
    specs = [S(column=0, change_order=2), S(column=1, change_order=3)]
    assert B.reorder_columns(df, specs).columns == list("cdab")


def test_rename_display(spark):
    df = _frame(spark, ["a", "b"])
    assert B.rename_display(df, 1, "  New  ").columns == ["a", "New"]
    assert B.rename_display(df, 1, None).columns == ["a", "b"]
    assert B.rename_display(df, 1, "b").columns == ["a", "b"]
    with pytest.raises(ValueError):
        B.rename_display(df, 0, "   ")


def test_duplicate_input_names_resolve_by_position(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a", "a", "c")
    out = B.apply_specs(df, [S(name="first", column=0), S(column=2, change_order=0)])
    assert out.columns == ["c", "first", "a"] and tuple(out.first()) == (3, 1, 2)


def test_text_rows(spark):
    df = spark.createDataFrame([(1, None, [1, 2])], "i int, n string, arr array<int>")
    out = B.text_rows(df, [("n", "name"), ("i", "id"), ("missing", "m"), ("arr", "arr")])
    assert out.columns == ["name", "id", "m", "arr"]
    assert tuple(out.first()) == (None, "1", "", "[1,2]")


def test_identity_specs_roundtrip(spark, small):
    df = spark.read.parquet(f"{small}/customer.parquet")
    out = B.apply_specs(df, B.identity_specs(df))
    assert out.columns == df.columns and out.exceptAll(df).count() == 0


def _model(n, specs, drop):
    """Plain model: fill slots one spec at a time, then fill gaps left to right."""
    last_target, first_seen = {}, []
    for c, t in specs:
        if c is None or t is None or not 0 <= c < n:
            continue
        if c not in last_target:
            first_seen.append(c)
        last_target[c] = min(max(t, 0), n - 1)
    if not last_target:
        return list(range(n))
    slots = [None] * n
    for c in first_seen:
        if slots[last_target[c]] is not None and not drop:
            return "conflict"
        slots[last_target[c]] = c
    rest = iter([c for c in range(n) if c not in last_target])
    for i in range(n):
        if slots[i] is None:
            slots[i] = next(rest, None)
    return [c for c in slots if c is not None]


spec_lists = st.lists(st.tuples(st.one_of(st.none(), st.integers(-2, 7)),
                                st.one_of(st.none(), st.integers(-3, 9))), max_size=6)


@settings(max_examples=400, deadline=None)
@given(n=st.integers(1, 6), specs=spec_lists, drop=st.booleans())
def test_plan_order_matches_model(n, specs, drop):
    model = _model(n, specs, drop)
    objs = [S(column=c, change_order=t) for c, t in specs]
    if model == "conflict":
        with pytest.raises(B.ReorderConflict):
            B.plan_order(n, objs)
    else:
        got = B.plan_order(n, objs, on_conflict="drop" if drop else "error")
        assert got == model
        if len(got) == n:
            assert sorted(got) == list(range(n))


def test_awkward_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a.b", "x`y", "with space")
    out = B.apply_specs(df, [S(name="p.q", column=1, change_order=0), S(name="r`s", column=0)])
    assert out.columns == ["p.q", "r`s", "with space"] and tuple(out.first()) == (2, 1, 3)
    assert B.move_column(df, 2, 0).columns == ["with space", "a.b", "x`y"]
    assert B.select_names(df, ["with space", "a.b"]).columns == ["with space", "a.b"]
