"""Line dedup with sharded cuckoo filters over exact reference counts.

The exact state is two tables: ``counts`` (key, refs, keeper), one row per line key with the
number of documents that hold it and the smallest of them, and ``postings`` (key, doc_id) of the
keys held by two documents or more. The filters hold the shared keys, sharded by key: a line that
its filter does not know is kept without a look at the tables, so only lines that are very likely
shared travel. Inserting documents adds references, deleting takes them back; a key that is no
longer shared leaves its filter, so the index after a deletion is the index that never saw the
document.

A key is the 128-bit hash of the line, stripped of ASCII white space and A-Z lower-cased; lines
of under ``MIN_POINTS`` code points have none. A hot line is one row per document in the postings
and one row in the counts (combined before the shuffle). The postings are joined with written
tables of unique keys only, so adaptive execution splits a hot line's rows over tasks.

Defined cases: null or empty text is one empty line; rows that share a doc_id are one document
for counting and are each rewritten; a null doc_id sorts after all others and stays null; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import cut, id_text, prepare, release, shown_id, slices, text_bytes
from haulage.llm.cuckoo import (CuckooFilter, ShardedFilters, broadcast_filters, build_filters, key_array, n_shards,
                                shard_of)

MIN_POINTS = 10


def line_keys(lines: list[bytes]) -> list[bytes | None]:
    """16-byte key of each line, None where the line is too short to have one."""
    from xxhash import xxh3_128_digest
    out: list[bytes | None] = []
    for line in lines:
        key = line.strip().lower()
        long_enough = len(key) >= MIN_POINTS and (key.isascii() or len(key.decode("utf-8", "replace")) >= MIN_POINTS)
        out.append(xxh3_128_digest(key) if long_enough else None)
    return out


def _doc_keys(docs: DataFrame) -> DataFrame:
    """(key, doc_id), each key once per row."""
    def keys(batches):
        for batch in slices(batches, 4 << 20):
            found, owner = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                own = set(line_keys(text.split(b"\n"))) - {None}
                found += own
                owner += [doc_id] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(owner, pa.int64())], names=["key", "doc_id"])

    return docs.mapInArrow(keys, "key binary, doc_id long")


def _candidates(docs: DataFrame, shared) -> DataFrame:
    """Per row: its lines if any of them may be shared, else its digest right away."""
    def look(batches):
        filters = None if shared is None else ShardedFilters(*shared.value)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.binary())]
        for batch in slices(batches, 4 << 20):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                lines = text.split(b"\n")
                own = list(set(line_keys(lines)) - {None})
                if filters is not None and own:
                    own = [k for k, hit in zip(own, filters.contains(own).tolist()) if hit]
                out.append((doc_id, len(lines), text if own else None,
                            None if own else hashlib.sha256(text).hexdigest(), own))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                             names=["doc_id", "n_lines", "text", "kept_sha256", "keys"])

    return docs.mapInArrow(look, "doc_id long, n_lines long, text binary, kept_sha256 string, keys array<binary>")


@dataclass(frozen=True)
class LineIndex:
    counts: DataFrame      # key, refs, keeper
    postings: DataFrame    # key, doc_id of the keys with refs >= 2
    filters: DataFrame     # shard, filter: the keys with refs >= 2
    shards: int

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        prepare(docs.sparkSession)
        rows = id_text(docs, id_col, text_col)
        ends = _doc_keys(rows).groupBy("key").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
        ends = cut(ends, "line-ends")
        release(docs.sparkSession)
        shared = ends.where("keeper <> last").select("key")
        shards = n_shards(shared.count())
        filters = cut(build_filters(shared, shards), "line-filters")
        near = _candidates(rows, broadcast_filters(filters, shards)).select(F.explode("keys").alias("key"), "doc_id")
        postings = cut(near.join(shared, "key", "left_semi").distinct(), "line-postings")
        refs = postings.groupBy("key").agg(F.count("*").alias("refs"))
        counts = (ends.join(refs, "key", "left")
                  .select("key", F.coalesce("refs", F.lit(1)).alias("refs"), "keeper"))
        return cls(counts, postings, filters, shards)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with more documents. Lines that it holds for an id already change nothing."""
        new = cut(_doc_keys(id_text(docs, id_col, text_col)).distinct().join(self._held(), ["key", "doc_id"], "left_anti"), "line-new")
        counts = cut(self.counts.unionByName(new.groupBy("key").agg(F.count("*").alias("refs"), F.min("doc_id").alias("keeper")))
                     .groupBy("key").agg(F.sum("refs").alias("refs"), F.min("keeper").alias("keeper")), "line-counts")
        shared = counts.where("refs > 1").select("key")
        # documents that were the only holder of a key until now
        alone = self.counts.where("refs = 1").select("key", F.col("keeper").alias("doc_id"))
        postings = cut(self.postings.unionByName(new.unionByName(alone).join(shared, "key", "left_semi")), "line-postings")
        gained = shared.join(self.counts.where("refs > 1").select("key"), "key", "left_anti")
        return LineIndex(counts, postings, self._filters(gained, None, shared), self.shards)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index without these documents' lines. Lines that it does not hold for an id change nothing."""
        gone = cut(_doc_keys(id_text(docs, id_col, text_col)).distinct().join(self._held(), ["key", "doc_id"], "left_semi"), "line-gone")
        left = self.postings.join(gone, ["key", "doc_id"], "left_anti")
        keepers = left.groupBy("key").agg(F.min("doc_id").alias("left_keeper"))
        fewer = gone.groupBy("key").agg(F.count("*").alias("fewer"))
        counts = cut(self.counts.join(fewer, "key", "left").join(keepers, "key", "left")
                     .select("key", (F.col("refs") - F.coalesce("fewer", F.lit(0))).alias("refs"),
                             F.coalesce("left_keeper", "keeper").alias("keeper")).where("refs > 0"), "line-counts")
        shared = counts.where("refs > 1").select("key")
        lost = self.counts.where("refs > 1").select("key").join(shared, "key", "left_anti")
        return LineIndex(counts, cut(left.join(shared, "key", "left_semi"), "line-postings"),
                         self._filters(None, lost, shared), self.shards)

    def _held(self) -> DataFrame:
        """(key, doc_id) of all keys."""
        return self.postings.unionByName(self.counts.where("refs = 1").select("key", F.col("keeper").alias("doc_id")))

    def _filters(self, gained: DataFrame | None, lost: DataFrame | None, shared: DataFrame) -> DataFrame:
        """Filters after inserting or deleting keys shard by shard; a shard that overflows is
        built anew from the exact table."""
        changed = (gained if gained is not None else lost).select(shard_of("key", self.shards).alias("shard"), "key")
        adding = gained is not None

        def change(old: pa.Table, keys: pa.Table) -> pa.Table:
            shard = (old if old.num_rows else keys).column("shard")[0].as_py()
            own = key_array(keys.column("key").to_pylist())
            image, full = None, False
            if old.num_rows:
                held = CuckooFilter.from_bytes(old.column("filter")[0].as_py())
                if adding:
                    full = not held.insert(own)
                elif len(own):
                    held.delete(own)
                image = held.to_bytes()
            else:
                image = CuckooFilter.of(own).to_bytes()
            return pa.table({"shard": pa.array([shard], pa.int32()),
                             "filter": pa.array([None if full else image], pa.binary())})

        done = cut(self.filters.groupBy("shard").cogroup(changed.groupBy("shard"))
                   .applyInArrow(change, "shard int, filter binary"), "line-filters")
        if not adding:
            return done
        anew = build_filters(shared, self.shards).join(done.where("filter IS NULL").select("shard"), "shard", "left_semi")
        return cut(done.where("filter IS NOT NULL").unionByName(anew), "line-filters")


REPORT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept binary"


def drop_lines(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text",
               with_text: bool = False) -> DataFrame:
    """Per row: n_lines, n_dropped, kept_sha256 and, with ``with_text``, what is kept (null where
    nothing was dropped).

    The text is shuffled only for documents with a line that may be shared; the others are done
    where they are read.
    """
    prepare(docs.sparkSession)
    rows = _candidates(id_text(docs, id_col, text_col), broadcast_filters(index.filters, index.shards))
    keepers = cut(index.counts.where("refs > 1").select("key", "keeper"), "line-keepers")
    drops = (index.postings.join(keepers, "key").where("doc_id <> keeper")
             .groupBy(F.col("doc_id").alias("d_doc")).agg(F.collect_list("key").alias("drops")))

    def rewrite(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in slices(batches, 4 << 20):
            out = []
            for doc_id, n, text, digest, drop in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None:
                    out.append((doc_id, n, 0, digest, None))
                    continue
                lines = text.split(b"\n")
                drop = set(drop or ())
                kept = [line for line, key in zip(lines, line_keys(lines)) if key not in drop] if drop else lines
                whole = b"\n".join(kept)
                out.append((doc_id, n, n - len(kept), hashlib.sha256(whole).hexdigest(),
                            whole if with_text and drop else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                             names=[c.split()[0] for c in REPORT.split(", ")])

    out = (rows.join(drops, F.col("doc_id") == F.col("d_doc"), "left")
           .select("doc_id", "n_lines", "text", "kept_sha256", "drops").mapInArrow(rewrite, REPORT))
    return out.select(shown_id(), *(c for c in out.columns[1:] if with_text or c != "kept"))
