"""Hierarchies against a walk up, JSON of mixed shape against the json module, script and value binding."""

import random

import pytest
from pyspark.sql import functions as F

from haulage.operators import hierarchy as Y
from haulage.operators import variants as V
from haulage.sources.load import load, run_script, run_sql
from haulage.specs import Source


def climbed(rows):
    up = dict(rows)
    out = set()
    for n in up:
        at, depth = n, 0
        while up[at] is not None and up[at] in up and up[at] != at:
            at, depth = up[at], depth + 1
        out.add((n, at, depth))
    return out


def test_roots_and_depths(spark):
    r = random.Random(1)
    rows = [(0, None)] + [(k, r.randrange(k)) for k in range(1, 150)]              # a tree
    rows += [(1000 + k, 1000 + k - 1) for k in range(1, 70)]                       # a chain; its top's parent is unknown
    rows += [(2000 + k, 2000) for k in range(120)] + [(5000, 77777)]               # one parent of many, that is its own; an orphan
    got = Y.descend(spark.createDataFrame(rows, "c int, p int").repartition(3), "c", "p")
    assert {tuple(x) for x in got.collect()} == climbed(rows) and got.columns == ["node", "root", "depth"]
    assert Y.descend(spark.createDataFrame([], "c int, p int"), "c", "p").count() == 0


def test_a_cycle_is_an_error(spark):
    for n in (2, 3, 5):
        rows = [(k, (k + 1) % n) for k in range(n)] + [(10, 0), (11, None)]
        with pytest.raises(ValueError, match="cycle"):
            Y.descend(spark.createDataFrame(rows, "c int, p int"), "c", "p")


def test_fields_of_mixed_shapes(spark):
    texts = ['{"a": 1, "b": {"c": [1, "x"]}}', '[1, {"a": 2}]', '"text"', "12.5", "true", "null", '{"a": "not a number"}', "{broken", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, j string")
    got = V.with_fields(df, "j", {"a": ("$.a", "int"), "c": ("$.b.c[1]", "string")}, malformed="bad", kind="kind")
    assert [tuple(r)[2:] for r in got.orderBy("id").collect()] == [
        (1, "x", False, "object"), (None, None, False, "array"), (None, None, False, "string"), (None, None, False, "number"),
        (None, None, False, "boolean"), (None, None, False, "null"), (None, None, False, "object"), (None, None, True, None),
        (None, None, True, None), (None, None, False, None)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") == 1


def test_shape_of_a_column(spark):
    df = spark.createDataFrame([("x", '{"a": 1}'), ("x", '{"a": 2.5, "b": "t"}'), ("y", "[1, 2]")], "g string, j string")
    shapes = {r.g: r.shape for r in V.shape_of(df, "j", ["g"]).collect()}
    assert shapes["y"] == "ARRAY<BIGINT>" and shapes["x"].startswith("OBJECT<a: D") and shapes["x"].endswith("b: STRING>")


def test_values_are_never_part_of_the_text(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x' OR '1'='1")], "k int, name string")
    evil = "x' OR '1'='1"
    for sql, args in (("SELECT k FROM t WHERE name = :n", {"n": evil}), ("SELECT k FROM t WHERE name = ?", [evil])):
        assert [r.k for r in run_sql(spark, sql, {"t": rows}, args).collect()] == [3]
    assert load(spark, Source(kind="sql", query="SELECT COUNT(*) AS n FROM t WHERE name = :n", tables={"t": rows}, args={"n": "'; DROP VIEW t; --"})).first().n == 0
    assert spark.table("t").count() == 3
    with pytest.raises(Exception):
        run_sql(spark, "SELECT k FROM t WHERE name = :n", {"t": rows}).collect()


def test_script_with_variables_and_values(spark, scratch):
    script = f"""DECLARE k INT DEFAULT 0;
        CREATE TABLE haulage_loop_t (k INT, label STRING) USING parquet LOCATION '{scratch}/t';
        WHILE k < :upto DO
          IF k % 2 = 0 THEN INSERT INTO haulage_loop_t SELECT k, :label; END IF;
          SET k = k + 1;
        END WHILE"""
    try:
        rows = run_script(spark, script, "SELECT k, label FROM haulage_loop_t WHERE k < :upto ORDER BY k", args={"upto": 5, "label": "it's; --"}).collect()
        assert [(r.k, r.label) for r in rows] == [(0, "it's; --"), (2, "it's; --"), (4, "it's; --")]
        with pytest.raises(ValueError):
            run_script(spark, script, "SELECT 1", args=[1])
    finally:
        spark.sql("DROP TABLE IF EXISTS haulage_loop_t")
