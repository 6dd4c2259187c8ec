import hashlib

from awkward import doc_rows, documents, empty_documents, ident, prose, result
from haulage.llm.chunk_dedup import GEAR, MASK, MAX_CHUNK, MIN_CHUNK, chunk_ends, dedup_chunks
from hypothesis import given, settings
from hypothesis import strategies as st

COLUMNS = ("doc_id", "n_bytes", "n_chunks", "n_removed_chunks", "n_removed", "first_docs", "kept_sha256")


def rolled(text):
    """Byte by byte: the gear hash of the last 16 bytes, a cut where its mask bits are zero."""
    ends, last = [], 0
    for k in range(len(text)):
        h = sum(int(GEAR[text[k - j]]) << j for j in range(16) if k - j >= 0) % 2**32
        if k + 1 - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if not h & MASK and k + 1 - last >= MIN_CHUNK:
            ends.append(k + 1)
            last = k + 1
    if last < len(text):
        ends.append(len(text))
    return ends


def brute(rows):
    first, cut = {}, []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        ends = rolled(raw) if len(raw) < 5000 else chunk_ends(raw)
        pieces = [raw[a:b] for a, b in zip([0, *ends], ends)]
        if pieces and len(pieces[-1]) < MIN_CHUNK:      # told together with the chunk before it
            pieces[-1] = (b"".join(pieces[-2:-1]), pieces[-1])
        cut.append(pieces)
        for k, c in enumerate(pieces):
            first[c] = min(first.get(c, (2**63, 0)), (ident(doc_id), k))
    out = []
    for (doc_id, text, *_), chunks in zip(rows, cut):
        gone = [k for k, c in enumerate(chunks) if first[c] != (ident(doc_id), k)]
        own = [c[1] if isinstance(c, tuple) else c for c in chunks]
        kept = b"".join(c for k, c in enumerate(own) if k not in set(gone))
        n = sum(map(len, own))
        out.append((doc_id, n, len(chunks), len(gone), n - len(kept), sorted({first[chunks[k]][0] for k in gone}),
                    hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_report_equals_brute_force(spark, monkeypatch):
    assert result(dedup_chunks(documents(spark)), *COLUMNS) == brute(doc_rows())
    monkeypatch.setattr("haulage.llm.cuckoo.BROADCAST_BYTES", 0)
    assert result(dedup_chunks(documents(spark)), *COLUMNS) == brute(doc_rows())


def test_passages_are_caught_wherever_they_stand_and_clean_text_stays(spark):
    passage = prose(77, 70)
    rows = [(k, prose(1000 + k, 20 + k) + " " + passage + " " + prose(2000 + k, 30)) for k in range(30)]
    rows += [(100 + k, prose(3000 + k, 100)) for k in range(30)]
    got = {r["doc_id"]: r for r in dedup_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_removed"] == 0
    for k in range(1, 30):
        assert got[k]["n_removed"] > 0.5 * len(passage.encode()) and 0 in got[k]["first_docs"], got[k]
    assert all(got[100 + k]["n_removed"] == 0 for k in range(30))


def test_exact_copies_go_whole_and_common_endings_stay(spark):
    ends = " The end."
    rows = [(k, prose(500 + k, 60) + ends) for k in range(8)] + [(20 + k, prose(500 + k, 60) + ends) for k in range(4)]
    rows += [(40, "short"), (41, "short"), (42, "Short"), (43, "x" * 39), (44, "x" * 39)]
    got = {r["doc_id"]: r for r in dedup_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k]["n_removed"] == 0 for k in (*range(8), 40, 42, 43))
    assert all(got[k]["n_removed"] == got[k]["n_bytes"] > 0 for k in (*range(20, 24), 41, 44))


def test_kept_text_and_empty_table(spark):
    for r in dedup_chunks(documents(spark), with_text=True).collect():
        assert (r["kept"] is not None) == (r["n_removed"] > 0)
    assert dedup_chunks(empty_documents(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1500) | st.integers(0, 2500).map(lambda n: b"z" * n))
def test_vectorised_ends_equal_the_rolling_hash(text):
    assert chunk_ends(text) == rolled(text)
