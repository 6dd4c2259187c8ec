"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes; a chunk ends where the hash of the last 16 bytes has five
zero bits, at least ``MIN_CHUNK`` and at most ``MAX_CHUNK`` bytes after the last end. Ends depend
on the text around them alone, so a passage that moves or stands among other words is cut the
same way after its first common end. Chunks of the same digest are one chunk: the copy with the
smallest (doc_id, ordinal) stays, all others are removed.

Digests are combined before they are shuffled (minimum and count per digest), so a passage that
many documents share is one row there. A cuckoo filter of the repeated digests prunes what is
joined afterwards, and text is shuffled only for documents that may lose a chunk.

A last chunk under ``MIN_CHUNK`` bytes says little by itself (many texts end in the same few words),
so its digest is that of the chunk before it and itself: it goes where an earlier document ends in
both. A text under ``MIN_CHUNK`` bytes is one chunk and goes as a whole.

Defined cases: null or empty text has no chunks; rows that share a doc_id are cut one by one, and of equal rows each loses the same chunks; a
null doc_id sorts last and stays null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import cut, id_text, prepare, release, same_row, shown_id, slices, tagged, tags_of, text_bytes
from haulage.llm.cuckoo import ShardedFilters, broadcast_filters, build_filters, n_shards

MIN_CHUNK = 40
MAX_CHUNK = 1024
SHORT_SEED = 1  # keeps the digests of short last chunks apart from those of whole chunks
MASK = 0xF800  # five bits that depend on all of the last 16 bytes


def _gear() -> np.ndarray:
    """256 spread 32-bit numbers, by a rule (a 64-bit mixer of the byte value)."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def chunk_ends(text: bytes) -> list[int]:
    """Ends of the chunks of one text; the last one is its length."""
    n = len(text)
    if not n:
        return []
    h = GEAR[np.frombuffer(text, np.uint8)]
    for step in (1, 2, 4, 8):  # h[i] = sum of gear[byte i - j] << j over 16 bytes
        h[step:] = h[step:] + (h[:-step] << np.uint32(step)) if n > step else h[step:]
    ends, last = [], 0
    for end in (np.flatnonzero((h & np.uint32(MASK)) == 0) + 1).tolist():
        while end - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if end - last >= MIN_CHUNK:
            ends.append(end)
            last = end
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunk_keys(text: bytes, ends: list[int]) -> list[bytes]:
    """16-byte digest of each chunk; a short last one is told together with the one before it."""
    from xxhash import xxh3_128_digest
    starts = [0, *ends[:-1]]
    keys = [xxh3_128_digest(text[a:b]) for a, b in zip(starts, ends)]
    if ends and ends[-1] - starts[-1] < MIN_CHUNK:
        keys[-1] = xxh3_128_digest(b"%d:" % (ends[-1] - starts[-1]) + text[starts[-2] if len(ends) > 1 else 0:], SHORT_SEED)
    return keys


def _chunks(docs: DataFrame) -> DataFrame:
    def chunks(batches):
        for batch in slices(batches, 2 << 20):
            keys, owner, ordinal = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                own = chunk_keys(text, chunk_ends(text))
                keys += own
                owner += [doc_id] * len(own)
                ordinal += range(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(owner, pa.int64()),
                                              pa.array(ordinal, pa.int32())], names=["key", "doc_id", "ordinal"])

    return docs.mapInArrow(chunks, "key binary, doc_id long, ordinal int")


def _candidates(rows: DataFrame, shared) -> DataFrame:
    """Per row of ``rows`` (doc_id, text, tags): sizes, the chunks that may be shared, and the text where there are any."""
    tags = tags_of(rows)

    def look(batches):
        filters = None if shared is None else ShardedFilters(*shared.value)
        piece = pa.struct([("key", pa.binary()), ("ordinal", pa.int32())])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(piece)] + [pa.int64()] * len(tags)
        for batch in slices(batches, 2 << 20):
            out = []
            own_tags = [batch.column(k).to_pylist() for k in range(2, batch.num_columns)]
            for doc_id, text, *tag in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), *own_tags):
                ends = chunk_ends(text)
                own = [(key, k) for k, key in enumerate(chunk_keys(text, ends))]
                if filters is not None and own:
                    own = [p for p, hit in zip(own, filters.contains([key for key, _ in own]).tolist()) if hit]
                out.append((doc_id, len(text), len(ends), text if own else None,
                            None if own else hashlib.sha256(text).hexdigest(),
                            [{"key": key, "ordinal": k} for key, k in own], *tag))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                             names=["doc_id", "n_bytes", "n_chunks", "text", "kept_sha256", "pieces", *tags])

    return rows.mapInArrow(look, ", ".join(["doc_id long, n_bytes long, n_chunks long, text binary, kept_sha256 string, "
                                            "pieces array<struct<key:binary,ordinal:int>>", *(f"{t} long" for t in tags)]))


REPORT = ("doc_id long, n_bytes long, n_chunks long, n_removed_chunks long, n_removed long, "
          "first_docs array<long>, kept_sha256 string, kept binary")


def dedup_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: sizes, what was removed, ``first_docs`` (the documents whose copies stay) and the
    digest of the rest; with ``with_text`` the rest itself (null where nothing was removed)."""
    spark = prepare(docs.sparkSession)
    rows = id_text(docs, id_col, text_col)
    first = (_chunks(rows).groupBy("key").agg(F.min(F.struct("doc_id", "ordinal")).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("key", F.col("first.doc_id").alias("first_doc"), F.col("first.ordinal").alias("first_ordinal")))
    first = cut(first, "chunk-first")
    release(spark)
    shards = n_shards(first.count())
    looked = _candidates(tagged(rows), broadcast_filters(build_filters(first.select("key"), shards), shards))
    own = ["doc_id", *tags_of(looked)]
    pieces = looked.select(*own, F.inline("pieces"))
    later = (pieces.join(first, "key").where("doc_id <> first_doc OR ordinal <> first_ordinal")
             .groupBy(*[F.col(c).alias(f"d_{c}") for c in own])
             .agg(F.collect_set("ordinal").alias("drops"), F.array_sort(F.collect_set("first_doc")).alias("first_docs")))

    def rewrite(batches):
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.string(), pa.binary()]
        for batch in slices(batches, 2 << 20):
            out = []
            for doc_id, size, n, text, digest, drops, firsts in zip(*(c.to_pylist() for c in batch.columns)):
                if not drops:
                    out.append((doc_id, size, n, 0, 0, [], digest or hashlib.sha256(text).hexdigest(), None))
                    continue
                ends, gone = chunk_ends(text), set(drops)
                kept = b"".join(text[a:b] for k, (a, b) in enumerate(zip([0, *ends], ends)) if k not in gone)
                out.append((doc_id, size, n, len(gone), size - len(kept), firsts,
                            hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                             names=[c.split()[0] for c in REPORT.split(", ")])

    out = (looked.drop("pieces").join(later, same_row(looked, {c: f"d_{c}" for c in own}), "left")
           .select("doc_id", "n_bytes", "n_chunks", "text", "kept_sha256", "drops", "first_docs").mapInArrow(rewrite, REPORT))
    return out.select(shown_id(), *(c for c in out.columns[1:] if with_text or c != "kept"))
