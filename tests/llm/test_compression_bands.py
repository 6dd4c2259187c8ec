import re

import zstandard
from awkward import doc_rows, documents, empty_documents, result
from haulage.llm.compression_bands import CompressionRules, base_counts, compression_bands
from hypothesis import given, settings
from hypothesis import strategies as st

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    hit = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in range(k, k + 5)} if len(words) < 1000 else None
    if hit is None:
        where = {}
        for k, w in enumerate(windows):
            where.setdefault(w, []).append(k)
        hit = {p for ks in where.values() if len(ks) > 1 for k in ks for p in range(k, k + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(line in lines[:k] for k, line in enumerate(lines)), len(hit))


def test_counts_and_verdict_equal_brute_force(spark):
    out = compression_bands(documents(spark))
    assert result(out, *COUNTS) == sorted(((r[0], *brute(r[1])) for r in doc_rows()), key=repr)
    rules, z = CompressionRules(), zstandard.ZstdCompressor(level=3)
    texts = {r[0]: (r[1] or "").encode() for r in doc_rows() if r[0] is not None}
    for r in out.where("doc_id IS NOT NULL").collect():
        text = texts[r["doc_id"]]
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
        whole = len(z.compress(text)) / len(text) if text else None
        band = [b for b in rules.bands if len(text) >= b.min_bytes]
        fine = not band or band[-1].low <= whole <= band[-1].high
        chunks = [text[k:k + 4096] for k in range(0, len(text), 4096)] if len(text) > 4096 else []
        chunks = [len(z.compress(c)) / len(c) for c in chunks if len(c) >= 2048]
        bad = sum(not 0.26 <= c <= 0.74 for c in chunks)
        assert r["kept"] == (not failed and fine and bad <= 0.2 * len(chunks))


def test_bands_reject_repetitive_and_incompressible_text(spark):
    import base64
    import random
    r = random.Random(3)
    noise = " ".join(base64.b64encode(r.randbytes(24)).decode() for _ in range(300))
    pieces = ["alpha beta gamma delta", "beta gamma alpha delta", "delta alpha gamma beta", "gamma delta beta alpha"]
    dull = " ".join(r.choice(pieces) + str(k % 10) for k in range(400))
    rows = [(1, noise), (2, dull)] + [(k, t) for k, t, *_ in doc_rows() if k == 70]
    got = {x["doc_id"]: x["kept"] for x in compression_bands(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: False, 2: False, 70: True}


def test_empty_table(spark):
    assert compression_bands(empty_documents(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "\n", " ", "é", "#", "\t"]), max_size=120).map("".join))
def test_counts_property(text):
    assert base_counts(text.encode()) == brute(text)
