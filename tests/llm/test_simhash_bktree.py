import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from xxhash import xxh64_intdigest

from haulage.llm import simhash_bktree as S
from awkward import DOC_SCHEMA, doc_rows, documents, empty_documents, ident, prose, result


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def plain_components(values, radius=3):
    """Smallest position each reaches, by brute force."""
    parent = list(range(len(values)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return [top(k) for k in range(len(values))]


def expected(rows):
    rows = [(r[0], plain_fingerprint(r[1])) for r in rows]
    comp = plain_components([f for _, f in rows])
    least = {}
    for k, (doc, _) in zip(comp, rows):
        least[k] = min(least.get(k, 2**63), ident(doc))
    return sorted(((doc, f"{f:016x}", None if least[k] == 2**63 - 1 else least[k]) for k, (doc, f) in zip(comp, rows)), key=repr)


def near_rows():
    """Long texts with few words changed, whose fingerprints differ in a few bits."""
    r, rows = random.Random(3), []
    for g in range(4):
        base = prose(50 + g, 900).split(" ")
        for k in range(12):
            words = list(base)
            for _ in range(k % 4):
                words[r.randrange(len(words))] = f"new{r.randrange(99)}"
            rows.append((1000 - 20 * g - k, " ".join(words), None, None, None, None, None, None, None, None))
    rows.append((7, prose(91, 20000), *[None] * 8))
    return rows


def test_equals_brute_force(spark):
    rows = doc_rows() + near_rows()
    out = S.near_duplicates(documents(spark, rows))
    assert result(out, "doc_id", "fingerprint", "component_id") == expected(rows)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]


def test_small_trees_give_the_same(spark):
    rows = doc_rows() + near_rows()
    out = S.near_duplicates(documents(spark, rows), tree_size=2)
    assert result(out, "doc_id", "fingerprint", "component_id") == expected(rows)


def test_empty_table(spark):
    assert S.near_duplicates(empty_documents(spark)).collect() == []


def test_documents_without_text_link(spark):
    rows = [(k, t, *[None] * 8) for k, t in ((5, None), (3, ""), (None, " \n"), (9, "some words that differ from none"))]
    out = S.near_duplicates(spark.createDataFrame(rows, DOC_SCHEMA))
    assert result(out, "doc_id", "component_id") == sorted([(5, 3), (3, 3), (None, 3), (9, 9)], key=repr)


@pytest.mark.parametrize("radius,depth", [(3, 1), (3, 2), (3, 3), (1, 2), (5, 1), (0, 1)])
def test_linked_fingerprints_share_a_mask(radius, depth):
    r, masks = random.Random(radius * 10 + depth), S._masks(radius, depth)
    for _ in range(500):
        differ = sum(1 << b for b in r.sample(range(64), radius))
        assert any(differ & m == 0 for m in masks)


def test_deeper_pieces_give_the_same(spark, monkeypatch):
    r = random.Random(8)
    centres = [r.getrandbits(64) for _ in range(12)]
    values = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for c in centres for _ in range(25)})
    nodes = spark.createDataFrame([(S._signed(v), k) for k, v in enumerate(values)], "fp long, least long")
    want = plain_components(values)
    for shard_rows in (1024, 1e-3, 1e-9):
        monkeypatch.setattr(S, "SHARD_ROWS", shard_rows)
        edges = S.links(nodes, tree_size=5).collect()
        label = np.arange(len(values))
        at = {S._signed(v): k for k, v in enumerate(values)}
        if edges:
            S.merge(label, np.array([at[e["a"]] for e in edges]), np.array([at[e["b"]] for e in edges]))
        assert label.tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 2**14)), max_size=80), st.integers(0, 4))
def test_tree_search_equals_comparing_all(rows, radius):
    rows = sorted(set(rows))
    tile, role, fp = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    fp = fp.astype(np.uint64)
    a, b = S._tile_edges(tile, role, fp, radius) if len(rows) else ([], [])
    # rows joined by edges, against all pairs of a searching row and a tree row of the same tile
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def group(pairs):
        parent.clear()
        for x, y in pairs:
            parent[max(top(x), top(y))] = min(top(x), top(y))
        return {v: top(v) for v in sorted({r[2] for r in rows})}

    plain = [(x[2], y[2]) for x in rows for y in rows
             if x[0] == y[0] and x[1] != 0 and y[1] != 1 and (x[2] ^ y[2]).bit_count() <= radius]
    assert group(zip(map(int, a), map(int, b))) == group(plain)
