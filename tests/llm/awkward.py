"""Small tables with everything that can go wrong, and helpers to compare results."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside or return
    T.StructField("n_words", T.StringType()), T.StructField("key", T.LongType()), T.StructField("score", T.StringType()),
    T.StructField("rep", T.LongType()), T.StructField("target", T.StringType())])

WORDS = ("stone river cloud amber field quiet lantern märz été niño harbor window copper seven meadow orchard "
         "signal thunder velvet walnut anchor basket candle dragon ember forest garden hollow island jungle").split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) + r.choice(["", "", "", "s", "ing", "ed", str(r.randrange(50))]) for _ in range(n)]
    lines = [" ".join(words[k:k + 9]) for k in range(0, n, 9)]
    return ".\n".join(lines)


def doc_rows():
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join(words[:40] + ["changed"] + words[41:])
    far = " ".join(w if k % 3 else "other" + str(k) for k, w in enumerate(words))
    passage = prose(2, 60)
    texts = [base, base, near, far, None, "", "   \n\t ", "word", "one two three", "one two three", "ONE two three",
             prose(3, 80) + "\n" + passage, passage + "\n" + prose(4, 90), "x" * 49, "y" * 50, "y" * 50, "y" * 120,
             "the same line of text\n  The SAME line of text \nanother\r\nthe same line of text",
             "the same line of text\nshort\nshort", "ünïcödé línë wíth àccents ñ ß 漢字 🎉 " * 6, "a b c  d　e\n\n f <|endoftext|> g",
             "### $$$ %%% &&& *** <b> | " * 20, "same same same same same same same same same same same same",
             prose(5, 4000), "🎉" * 300, prose(6, 30) + " " + prose(6, 30), "\x00\x01 odd \x7f bytes", " ".join(["lorem"] * 9)]
    rows = [(k * 3 + 1, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"src{k % 3}", None if t is None else len(t),
             "clash", k, None, 7, "t") for k, t in enumerate(texts)]
    rows.append(rows[0])                                                     # a repeated row
    rows.append((None, base, "en", "src1", 1, None, None, None, None, None))  # no id
    rows.append((None, prose(9, 25), None, None, None, None, None, None, None, None))
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(doc_rows() if rows is None else rows, DOC_SCHEMA).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def result(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def ident(doc_id):
    """Order of ids: null last."""
    return 2**63 - 1 if doc_id is None else doc_id
