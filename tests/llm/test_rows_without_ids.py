from collections import Counter

import corpus_pipeline
from awkward import doc_rows, documents, empty_documents, ident, prose, result
from haulage.llm import chunk_dedup, lpf_dedup, ngram_join, suffix_decontamination
from test_chunk_dedup import COLUMNS as chunk_columns
from test_chunk_dedup import brute as chunk_brute
from test_lpf_dedup import COLUMNS as lpf_columns
from test_lpf_dedup import brute as lpf_brute
from test_ngram_join import shingles
from test_suffix_decontamination import ITEMS, bench
from test_suffix_decontamination import brute as brute_contamination
from xxhash import xxh64_intdigest

NONE = (None,) * 8


def id_rows():
    """Rows without an id and with repeated ids, some near copies of others, some clean."""
    base, other = prose(21, 80), prose(22, 80)
    near = " ".join(base.split(" ")[:-1])
    texts = [(None, near), (None, " ".join(other.split(" ")[1:])), (None, prose(23, 40)), (None, prose(23, 40)), (None, prose(24, 30)),
             (5, base), (9, other), (7, prose(25, 50)), (7, prose(26, 50)), (7, prose(26, 50)), (7, near), (8, ""), (8, ""),
             (None, ""), (None, None)]
    return [t + NONE for t in texts]


def one_per_component(rows):
    """The (id, text) that stay, how often: every distinct (id, text) is a node."""
    nodes = sorted({(ident(r[0]), r[1] or "") for r in rows})
    sets = [shingles(t) for _, t in nodes]
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in enumerate(sets):
        for b, t in enumerate(sets):
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    copies = Counter((ident(r[0]), r[1] or "") for r in rows)
    return {n: 1 if sets[k] or n[0] != ident(None) else copies[n] for k, n in enumerate(nodes) if root(k) == k}


def shown(df):
    return Counter((ident(r["doc_id"]), r["text"] or "") for r in df.collect())


def test_near_duplicates_go_row_by_row(spark):
    for rows in (id_rows(), doc_rows()):
        docs = documents(spark, rows)
        for left in (ngram_join.keep_rows(docs), corpus_pipeline.near_duplicates(spark, docs, None)):
            assert left.columns == docs.columns and shown(left) == one_per_component(rows)
    left = shown(ngram_join.keep_rows(documents(spark, id_rows())))
    # two rows without an id link to 5 and 9: both of these stay, and so do clean rows without an id
    assert {(5, prose(21, 80)), (9, prose(22, 80)), (ident(None), prose(24, 30))} <= set(left)
    assert ngram_join.keep_rows(empty_documents(spark)).count() == 0


def test_contaminated_rows_go_row_by_row(spark):
    item = " ".join(prose(24, 30).split()[3:20])
    for rows, items in ((id_rows(), [(1, item)]), (doc_rows(), ITEMS)):
        docs = documents(spark, rows)
        want = Counter((ident(r[0]), r[1] or "") for r in rows if not brute_contamination([r], items)[0][5])
        for options in ({}, {"block_bytes": 60, "shard_bytes": 2000}):
            left = suffix_decontamination.clean_rows(docs, bench(spark, items), **options)
            assert left.columns == docs.columns and shown(left) == want
    assert (ident(None), prose(9, 25)) in want


def low_bits_collision():
    """Two texts of over 50 bytes whose XXH64 agree in the low 31 bits."""
    seen = {}
    for n in range(1_000_000):
        text = f"report {n} of the harbor office, filed under {n * 7919 % 100003} and kept in the north tower"
        low = xxh64_intdigest(text.encode(), 42) & (2**31 - 1)
        if low in seen:
            return seen[low], text
        seen[low] = text
    raise AssertionError("no collision found")


def test_rows_of_one_id_are_told_apart_by_whole_digests(spark):
    a, b = low_bits_collision()
    rows = [t + NONE for t in [(1, a + "\n" + prose(31, 30)), (None, a), (None, b), (None, prose(32, 90) + a), (4, "short"), (None, "short")]]
    assert result(lpf_dedup.remove_copies(documents(spark, rows)), *lpf_columns) == lpf_brute(rows)
    assert result(chunk_dedup.dedup_chunks(documents(spark, rows)), *chunk_columns) == chunk_brute(rows)


def test_a_third_of_the_rows_has_no_id(spark):
    passages = [prose(60 + k, 40) for k in range(4)]
    rows = [((None if k % 3 == 0 else k // 2), prose(200 + k, 20) + " " + passages[k % 4] + " " + prose(300 + k % 7, 15)) + NONE for k in range(60)]
    assert result(lpf_dedup.remove_copies(documents(spark, rows)), *lpf_columns) == lpf_brute(rows)
    assert result(chunk_dedup.dedup_chunks(documents(spark, rows)), *chunk_columns) == chunk_brute(rows)
