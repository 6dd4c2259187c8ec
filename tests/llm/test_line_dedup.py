import hashlib

import numpy as np
from awkward import doc_rows, documents, empty_documents, ident, prose, result
from haulage.llm import line_dedup as L
from haulage.llm.cuckoo import CuckooFilter

COLUMNS = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def key(line):
    k = line.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    return k if len(k) >= 10 else None


def brute(rows):
    holders = {}
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(ident(doc_id))
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) is None or min(holders[key(x)]) == ident(doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def state(index):
    counts = sorted((bytes(r["key"]), r["refs"], r["keeper"]) for r in index.counts.collect())
    return counts, sorted((bytes(r["key"]), r["doc_id"]) for r in index.postings.collect())


def test_report_equals_brute_force(spark, monkeypatch):
    docs = documents(spark)
    index = L.LineIndex.build(docs)
    assert result(L.drop_lines(docs, index), *COLUMNS) == brute(doc_rows())
    monkeypatch.setattr("haulage.llm.cuckoo.BROADCAST_BYTES", 0)  # the way without filters
    assert result(L.drop_lines(docs, L.LineIndex.build(docs)), *COLUMNS) == brute(doc_rows())


def test_kept_text(spark):
    docs = documents(spark)
    for r in L.drop_lines(docs, L.LineIndex.build(docs), with_text=True).collect():
        assert (r["kept"] is not None) == (r["n_dropped"] > 0)
        assert r["kept"] is None or hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


def test_insert_and_delete_are_reversible(spark):
    rows = [r for r in doc_rows()[:-3]]
    part, rest = rows[::2], rows[1::2]
    small, whole = L.LineIndex.build(documents(spark, part)), L.LineIndex.build(documents(spark, rows))
    grown = small.insert(documents(spark, rest))
    assert state(grown) == state(whole)
    docs = documents(spark, rows)
    assert result(L.drop_lines(docs, grown), *COLUMNS) == brute(rows)
    back = grown.delete(documents(spark, rest))
    assert state(back) == state(small)
    assert result(L.drop_lines(documents(spark, part), back), *COLUMNS) == brute(part)
    gone = back.delete(documents(spark, part))
    assert state(gone) == ([], [])


def test_held_and_unknown_documents_change_nothing(spark):
    rows = doc_rows()[:14]
    index = L.LineIndex.build(documents(spark, rows))
    before = state(index)
    assert state(index.insert(documents(spark, rows[::3]))) == before
    unknown = [(900 + k, r[1]) + r[2:] for k, r in enumerate(rows[:5])]
    assert state(index.delete(documents(spark, unknown))) == before


def test_empty_table(spark):
    empty = empty_documents(spark)
    assert L.drop_lines(empty, L.LineIndex.build(empty)).count() == 0
    assert L.LineIndex.build(empty).counts.count() == 0


def test_cuckoo_filter_inserts_deletes_and_round_trips():
    r = np.random.default_rng(1)
    keys = r.integers(0, 2**63, (50_000, 2), dtype=np.int64).astype("<u8")
    made = CuckooFilter.of(keys)
    assert made.contains(keys).all()
    assert CuckooFilter.from_bytes(made.to_bytes()).contains(keys).all()
    others = r.integers(0, 2**63, (50_000, 2), dtype=np.int64).astype("<u8")
    assert made.contains(others).mean() < 0.001
    made.delete(keys[:20_000])
    assert made.contains(keys[20_000:]).all() and made.contains(keys[:20_000]).mean() < 0.001
    assert made.insert(keys[:20_000]) and made.contains(keys).all()
    full = CuckooFilter(8)
    assert not full.insert(keys[:100])  # too small: it says so, nothing is dropped silently


def test_long_and_repeated_lines(spark):
    rows = [(k, "\n".join([prose(1, 9), "  " + prose(1, 9).upper() + "\t", f"own line number {k}", "tiny"] * 3), None, None, None,
             None, None, None, None, None) for k in range(40)]
    docs = documents(spark, rows)
    assert result(L.drop_lines(docs, L.LineIndex.build(docs)), *COLUMNS) == brute(rows)
