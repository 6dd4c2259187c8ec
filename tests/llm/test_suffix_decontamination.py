import hashlib
import random
import re

import numpy as np
from awkward import doc_rows, documents, empty_documents, prose, result
from haulage.llm.suffix_decontamination import contamination_report, decontaminate, longest_matches, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
ITEMS = [(1, prose(2, 60)), (2, "ONE Two, three"), (3, None), (4, ""), (5, "nothing that any document holds at all, surely"),
         (None, "word"), (6, "y" * 50), (7, " ".join(prose(1, 120).split(" ")[30:45])), (7, "unheard"), (10, "word"), (11, "lorem lorem lorem")]


def words(text):
    return WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def brute(rows, items):
    out = []
    for doc_id, text, *_ in rows:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            iw = words(t)
            n = min(10, len(iw))
            if item is None or not n:
                continue
            windows = {tuple(iw[k:k + n]) for k in range(len(iw) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def bench(spark, items=ITEMS):
    return spark.createDataFrame([(a, b, "x", 1) for a, b in items], "item_id long, text string, doc_id string, n_words int")


def test_report_equals_brute_force_in_one_block_and_in_many(spark):
    want = brute(doc_rows(), ITEMS)
    assert result(contamination_report(documents(spark), bench(spark)), *COLUMNS) == want
    small = contamination_report(documents(spark), bench(spark), block_bytes=60, shard_bytes=2000)
    assert result(small, *COLUMNS) == want


def test_empty_tables(spark):
    assert contamination_report(empty_documents(spark), bench(spark)).count() == 0
    out = contamination_report(documents(spark), bench(spark, []) if False else bench(spark).limit(0))
    assert out.where("contaminated OR n_items > 0").count() == 0 and out.count() == len(doc_rows())


def test_decontaminate_keeps_columns_and_clean_rows(spark):
    docs = documents(spark)
    bad = {r[0] for r in brute(doc_rows(), ITEMS) if r[5]}
    left = decontaminate(docs, bench(spark))
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == sorted((r[0] or -1) for r in doc_rows() if r[0] not in bad)


def test_longest_match_and_its_place(spark):
    docs = spark.createDataFrame([(4, "zero one two three four five six seven eight nine ten eleven"),
                                  (2, "aa one two three four five six seven eight nine ten bb")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "x y one two three four five six seven eight nine ten z")], "item_id string, text string")
    assert [tuple(r) for r in longest_matches(docs, items).collect()] == [("q", 10, 2, 2, 1)]


def test_suffix_array_order():
    r = random.Random(5)
    for n, k in ((0, 2), (1, 1), (200, 2), (300, 3), (500, 40)):
        ids = np.array([r.randrange(k) for _ in range(n)], np.int64)
        depth = 25
        got = [tuple(ids[p:p + depth].tolist()) for p in suffix_array(ids, depth)]
        assert got == sorted(tuple(ids[p:p + depth].tolist()) for p in range(n))
