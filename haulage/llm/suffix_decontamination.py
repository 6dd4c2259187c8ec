"""Benchmark decontamination with suffix arrays over the training text.

Training documents are taken in shards of bounded size. A shard's words become exact integer
ids and a suffix array over them, sorted as deep as the longest benchmark text can match. Every
suffix of every benchmark item is binary-searched in every shard, one word deeper at a time and
all suffixes at once, which gives its longest verbatim match and where it lies; at the depth of
a window (10 words, or the whole of a shorter item) the interval lists all places the window
occurs, and those words are hit. Shards live inside tasks: nothing is shuffled.

The benchmark is taken in blocks of bounded bytes, one broadcast each; a benchmark of one block
is one pass over the documents, a larger one adds a pass per block: the report merges the hits of
rows that were numbered and written once, ``clean_rows`` filters what the block before left.

Defined cases: null or empty text has no words and is clean; items without words match nothing;
items without an id are ignored; repeated documents each get their row; a null doc_id stays null;
extra columns are ignored by the report and kept by ``decontaminate``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import NULL_ID, cut, id_text, lean, prepare, shown_id, slices, text_bytes, word_ids

WINDOW = 10
SHARD_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20

_WORD = bytearray(b" " * 256)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _WORD[_b] = _b
for _b in range(0x41, 0x5B):
    _WORD[_b] = _b + 32
_WORD = bytes(_WORD)


def match_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of 0-9, a-z and characters from U+0080 on."""
    return text.translate(_WORD).split()


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``ids`` in order of their first ``depth`` ids (a suffix that ends sorts first).

    Prefix doubling; after the first sort only suffixes that still tie with another are sorted
    again, so text without repeats costs one sort.
    """
    n = len(ids)
    if n == 0:
        return np.empty(0, np.int64)
    shift = int(ids.max()) + 2
    reach, key = 1, ids + 1
    while reach < 3 and shift ** (reach + 1) < 2**62:
        tail = np.zeros(n, np.int64)
        tail[:n - reach] = ids[reach:] + 1
        key = key * shift + tail
        reach += 1
    sa = np.argsort(key)
    starts = np.concatenate(([True], key[sa[1:]] != key[sa[:-1]]))
    rank = np.empty(n + 1, np.int64)
    while True:
        group = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        rank[sa] = group + 1
        rank[n] = 0
        if reach >= depth:
            return sa
        alone = starts & np.concatenate((starts[1:], [True]))
        at = np.flatnonzero(~alone)
        if not len(at):
            return sa
        suffix = sa[at]
        behind = rank[np.minimum(suffix + reach, n)]
        order = np.lexsort((behind, group[at]))
        sa[at] = suffix[order]
        g, b = group[at][order], behind[order]
        starts[at] = np.concatenate(([True], (g[1:] != g[:-1]) | (b[1:] != b[:-1])))
        reach *= 2


class ItemBlock:
    """Benchmark items of one block as words, with every suffix of every item."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.keys = [k for k, _ in items]
        words = [match_words(t) for _, t in items]
        self.vocabulary: dict[bytes, int] = {}
        self.words = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary)) for ws in words for w in ws), np.int64)
        lengths = np.array([len(ws) for ws in words], np.int64)
        self.longest = int(lengths.max()) if len(lengths) else 0
        item = np.repeat(np.arange(len(items)), lengths)
        start = np.arange(len(self.words))
        end = np.repeat(np.cumsum(lengths), lengths)
        # words of a window, shorter items count whole; a suffix under that never reaches it, but it
        # can hold the item's longest match
        self.item, self.start, self.end, self.need = item, start, end, np.minimum(lengths, window)[item]


def search_shard(ids: np.ndarray, vocabulary: dict, block: ItemBlock):
    """Binary-search every item suffix in one shard.

    Returns the suffix array, per suffix the depth of its longest match and the interval of that
    match, and the interval at window depth (empty where no window matches).
    """
    n, m = len(ids), len(block.item)
    translate = np.array([vocabulary.get(w, -1) for w in block.vocabulary], np.int64)
    query = translate[block.words] if len(block.words) else np.empty(0, np.int64)
    sa = suffix_array(ids, block.longest)
    low, high = np.zeros(m, np.int64), np.full(m, n, np.int64)
    depth = np.zeros(m, np.int64)
    w_low, w_high = np.zeros(m, np.int64), np.zeros(m, np.int64)
    live = np.flatnonzero(query[block.start] >= 0) if m and n else np.empty(0, np.int64)
    padded = np.concatenate((ids, [-1]))

    def bound(lo, hi, at, want, after):
        """First place in [lo, hi) whose word at depth ``at`` is not below (``after``: above) want."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            word = padded[np.minimum(sa[mid] + at[open_], n)]
            right = word <= want[open_] if after else word < want[open_]
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]

    while len(live):
        at, want = depth[live], query[block.start[live] + depth[live]]
        lo = bound(low[live], high[live], at, want, False)
        hi = bound(lo, high[live], at, want, True)
        found = (lo < hi) & (want >= 0)
        live, lo, hi = live[found], lo[found], hi[found]
        low[live], high[live] = lo, hi
        depth[live] += 1
        full = live[depth[live] == block.need[live]]
        w_low[full], w_high[full] = low[full], high[full]
        live = live[block.start[live] + depth[live] < block.end[live]]
    return sa, depth, low, high, w_low, w_high


def _shard_report(doc_ids, texts, block: ItemBlock):
    """Per document of a shard: n_words, hit spans, items; and the longest match of each item."""
    words = [match_words(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    # one id between documents that no item has: no match crosses it
    separator = b" "
    vocabulary = _Vocabulary()
    ids, _ = word_ids([w for ws in words for w in (*ws, separator)], vocabulary)
    first = np.cumsum(lengths + 1) - lengths - 1
    sa, depth, low, high, w_low, w_high = search_shard(ids, vocabulary, block)
    covered = np.zeros(len(ids) + 1, np.int64)
    items: list[set] = [set() for _ in texts]
    for q in np.flatnonzero(w_high > w_low):
        places = sa[w_low[q]:w_high[q]]
        np.add.at(covered, places, 1)
        np.add.at(covered, places + block.need[q], -1)
        for d in np.unique(np.searchsorted(first, places, "right") - 1).tolist():
            items[d].add(int(block.item[q]))
    hit = np.cumsum(covered[:-1]) > 0
    longest = {}
    for q in np.flatnonzero(depth > 0).tolist():
        best = longest.get(i := int(block.item[q]))
        if best is None or depth[q] > best[0]:
            place = int(sa[low[q]])
            d = int(np.searchsorted(first, place, "right")) - 1
            longest[i] = (int(depth[q]), int(q), doc_ids[d], place - int(first[d]), int(high[q] - low[q]))
    return lengths, first, hit, items, longest


class _Vocabulary(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int):
    """The benchmark in blocks of at most ``block_bytes`` bytes (or one item), in key order."""
    items = (benchmark.select(F.col(f"`{item_id}`").cast("string").alias("key"),
                              F.col(f"`{item_text}`").cast("string").alias("text"))
             .where("key IS NOT NULL AND text IS NOT NULL"))
    block, size = [], 0
    for row in items.toLocalIterator():
        text = row["text"].encode()
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["key"], text))
        size += len(text)
    yield block


HIT_SCHEMA = "row_id long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _block_hits(docs: DataFrame, shared, shard_bytes: int) -> DataFrame:
    def search(batches):
        block = shared.value
        struct = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in slices(batches, shard_bytes):
            ids = batch.column(1).to_pylist()
            lengths, first, hit, items, _ = _shard_report(ids, text_bytes(batch.column(2)), block)
            spans = []
            for f, n in zip(first.tolist(), lengths.tolist()):
                own = np.flatnonzero(np.diff(np.concatenate(([0], hit[f:f + n].view(np.int8), [0]))))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(own[::2], own[1::2])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array(spans, pa.list_(struct)),
                 pa.array([sorted({block.keys[i] for i in found}) for found in items], pa.list_(pa.string()))],
                names=["row_id", "doc_id", "n_words", "spans", "items"])

    return docs.mapInArrow(search, HIT_SCHEMA)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                   shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, merged hit ``spans`` (in words), ``items`` (sorted keys)."""
    spark = prepare(docs.sparkSession)
    rows = id_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    hits, before = None, None
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        if before is not None:  # more than one: each pass must see the same row_id, and one block is held at a time
            if hits is None:
                rows = cut(rows, "numbered-documents")
            own = cut(_block_hits(rows, before, shard_bytes), "block-hits")
            hits = own if hits is None else hits.unionByName(own)
            before.unpersist()
        before = spark.sparkContext.broadcast(ItemBlock(block, window))
    last = _block_hits(rows, before, shard_bytes)
    if hits is None:
        return last.drop("row_id")
    hits = (hits.unionByName(last).groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    return hits.drop("row_id")


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                    shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per item the longest verbatim match in the training text: item, n_words, item_start, doc_id,
    doc_start (word offsets; of several the one with the smallest doc_id and place)."""
    spark = prepare(docs.sparkSession)
    rows = id_text(docs, id_col, text_col)
    schema = "item string, n_words long, item_start long, doc_id long, doc_start long"
    found = None
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(ItemBlock(block, window))

        def search(batches, shared=shared):
            block = shared.value
            first_word = {}
            for q, i in enumerate(block.item.tolist()):
                first_word.setdefault(i, int(block.start[q]))
            for batch in slices(batches, shard_bytes):
                longest = _shard_report(batch.column(0).to_pylist(), text_bytes(batch.column(1)), block)[4]
                out = [(block.keys[i], n, int(block.start[q]) - first_word[i], d, p)
                       for i, (n, q, d, p, _) in longest.items()]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), [pa.string()] + [pa.int64()] * 4)],
                        names=["item", "n_words", "item_start", "doc_id", "doc_start"])

        part = rows.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    best = F.min_by(F.struct("n_words", "item_start", "doc_id", "doc_start"),
                    F.struct(-F.col("n_words"), "doc_id", "doc_start", "item_start"))
    return found.groupBy("item").agg(best.alias("b")).select("item", "b.n_words", "b.item_start", shown_id("b.doc_id").alias("doc_id"), "b.doc_start")


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: n_words, n_hit (words in any occurrence of a window), n_items, items_sha256."""
    hits = benchmark_hits(docs, benchmark, **options)

    def digest(batches):
        for batch in batches:
            hit = []
            for spans in batch.column(2).to_pylist():
                total, upto = 0, 0
                for s in sorted((s["start"], s["end"]) for s in spans):
                    total += max(0, s[1] - max(upto, s[0]))
                    upto = max(upto, s[1])
                hit.append(total)
            items = batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(map(len, items), pa.int64()),
                 pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]),
                 pa.array([h > 0 for h in hit])],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    out = hits.mapInArrow(digest, REPORT)
    return out.select(shown_id(), *out.columns[1:])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without a hit, with all their columns. Rows of a contaminated id go together;
    ``clean_rows`` decides per row."""
    hits = benchmark_hits(docs, benchmark, id_col=id_col, **options)
    bad = hits.where(F.size("spans") > 0).select(F.col("doc_id").alias("_llm_bad")).distinct()
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID))
    return docs.join(bad, key == F.col("_llm_bad"), "left_anti")


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
               window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows without a hit, with all their columns. A row goes only for its own text, also where
    it has no id or shares it; it is decided in the task that reads it, so no text is shuffled."""
    spark = prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def clean(shared):
        def run(batches):
            for batch in slices(batches, shard_bytes):
                texts = text_bytes(batch.column(at))
                _, first, hit, _, _ = _shard_report(range(len(texts)), texts, shared.value)
                upto = np.concatenate(([0], np.cumsum(hit)))
                ends = np.append(first[1:], len(hit))
                yield batch.filter(pa.array(upto[ends] == upto[first]))
        return run

    kept, before = docs, False
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        kept = (cut(kept, "clean-rows") if before else kept).mapInArrow(lean(clean(spark.sparkContext.broadcast(ItemBlock(block, window)))), docs.schema)
        before = True
    return kept
