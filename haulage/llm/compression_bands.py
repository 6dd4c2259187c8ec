"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

Repetitive text compresses far better than prose, noise far worse. How well prose compresses
depends on its length, so the limits do too: a band of lengths has a lowest and a highest
ratio (compressed bytes / bytes) for the whole text. Long texts are also cut into fixed chunks,
which all have one length and so share one pair of limits; a text is rejected when too many of
its chunks lie outside them, which finds a junk stretch that a long clean text hides.

Defined cases: null or empty text has no words and fails the base rules; texts shorter than the
first band have no ratio verdict; rows are judged one by one, so repeated rows and null ids give
repeated rows and null ids; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from haulage.llm.common import id_text, prepare, shown_id, slices, text_bytes, window_keys, word_ids

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 5


@dataclass(frozen=True)
class Band:
    """Limits of the ratio for texts of at least ``min_bytes`` bytes."""
    min_bytes: int
    low: float
    high: float


@dataclass(frozen=True)
class CompressionRules:
    bands: tuple[Band, ...] = (Band(128, 0.30, 1.10), Band(256, 0.36, 0.90), Band(512, 0.36, 0.82),
                               Band(1024, 0.34, 0.76), Band(4096, 0.30, 0.70), Band(16384, 0.26, 0.66))
    level: int = 3
    chunk_bytes: int = 4096
    min_chunk_bytes: int = 2048          # a shorter last chunk is left to the whole-text ratio
    chunk_low: float = 0.26
    chunk_high: float = 0.74
    max_bad_chunk_share: float = 0.2
    min_words: int = 10
    max_repeat_percent: int = 20


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one UTF-8 text."""
    words = text.split()
    joined = np.frombuffer(b"".join(words), np.uint8)
    word_chars = int(np.count_nonzero((joined & 0xC0) != 0x80))
    n_symbols = sum(text.count(s) for s in SYMBOLS)
    lines = [line for line in text.split(b"\n") if line.strip()]
    n_dup_lines = len(lines) - len(set(lines))
    ids, n_ids = word_ids(words)
    keys = window_keys(ids, n_ids, REPEAT_WINDOW)
    n_repeat = 0
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        if same.any():
            again = np.zeros(len(keys), bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            covered = np.zeros(len(ids), bool)
            for j in range(REPEAT_WINDOW):
                covered[j:j + len(keys)] |= again
            n_repeat = int(covered.sum())
    return len(words), word_chars, n_symbols, n_dup_lines, n_repeat


def ratios(text: bytes, rules: CompressionRules, compressor) -> tuple[float | None, int, int]:
    """Ratio of the whole text, number of chunks, number of chunks outside the limits."""
    if not text:
        return None, 0, 0
    whole = len(compressor.compress(text)) / len(text)
    n = bad = 0
    if len(text) > rules.chunk_bytes:
        for k in range(0, len(text), rules.chunk_bytes):
            chunk = text[k:k + rules.chunk_bytes]
            if len(chunk) >= rules.min_chunk_bytes:
                n += 1
                bad += not rules.chunk_low <= len(compressor.compress(chunk)) / len(chunk) <= rules.chunk_high
    return whole, n, bad


def in_band(n_bytes: int, whole: float | None, chunks: int, bad: int, rules: CompressionRules) -> bool:
    band = next((b for b in reversed(rules.bands) if n_bytes >= b.min_bytes), None)
    if band is not None and not band.low <= whole <= band.high:
        return False
    return bad <= rules.max_bad_chunk_share * chunks


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_bytes long, ratio double, n_chunks long, n_bad_chunks long")


def compression_bands(docs: DataFrame, rules: CompressionRules = CompressionRules(),
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, ratios and the verdict ``kept``. No shuffle."""
    prepare(docs.sparkSession)

    def judge(batches):
        import zstandard
        compressor = zstandard.ZstdCompressor(level=rules.level)
        for batch in slices(batches, 8 << 20):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                counts = base_counts(text)
                n_words, n_repeat = counts[0], counts[4]
                failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
                whole, chunks, bad = ratios(text, rules, compressor)
                kept = not failed and in_band(len(text), whole, chunks, bad, rules)
                out.append((doc_id, *counts, failed, kept, len(text), whole, chunks, bad))
            types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                             names=[c.split()[0] for c in SCHEMA.split(", ")])

    scored = id_text(docs, id_col, text_col).mapInArrow(judge, SCHEMA)
    return scored.select(shown_id(), *scored.columns[1:])
