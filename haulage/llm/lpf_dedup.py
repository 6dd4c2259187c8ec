"""Suffix-array dedup with longest-previous-factor arrays.

Removed is every byte covered by a ``SPAN``-byte string that also starts in a document with a
smaller id. Suffixes that can match that far are brought together by anchors:

1. Winnowing: among the ``GRAM``-byte grams of any SPAN-byte string the one with the smallest hash
   is an anchor, so two equal strings have an equal anchor at the same place in them. Each anchor
   goes out as its hash and a hash of its context (all SPAN-byte strings that hold it), 48 bits
   each, its document and its place.
2. Sorted by anchor, context and document, an anchor whose context also stands in a smaller
   document is a later copy in full. What is left are the first documents of each context of an
   anchor with several contexts: the ends of copies, where texts part.
3. Their contexts are read from the texts, and shards of them (whole anchors) get a suffix array
   over the bytes and, from the previous and next smaller document in suffix order, the longest
   previous factor of every suffix; a suffix with a factor of SPAN bytes or more is a later copy.
   An anchor with very many contexts is dealt over several shards by the string that starts.
4. Copied runs are merged per document and cut out of the bytes.

Defined cases: null or empty text has no bytes; texts under SPAN bytes lose nothing; rows that
share a doc_id do not copy each other (no id is smaller) and are cut one by one; a null doc_id sorts last and stays null; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import cut, id_text, prepare, release, runs_of, same_row, shown_id, slices, tagged, tags_of, text_bytes

SPAN = 50
GRAM = 20
REACH = SPAN - GRAM         # an anchor's strings start at most this far before it
PART_CONTEXTS = 20_000      # contexts of one anchor in one shard
SHARD_BYTES = 4 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two strings side by side from their hashes."""
    x = a * _M1 + b
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


_BYTE_HASH = _join(np.arange(1, 257, dtype=np.uint64), np.arange(7, 263, dtype=np.uint64))


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, context hash, place) of the anchors of one text."""
    n = len(text)
    if n < SPAN:
        none = np.empty(0, np.uint64)
        return none, none, np.empty(0, np.int64)
    h1 = _BYTE_HASH[np.frombuffer(text, np.uint8)]
    h2 = _join(h1[:-1], h1[1:])
    h4 = _join(h2[:-2], h2[2:])
    h8 = _join(h4[:-4], h4[4:])
    h16 = _join(h8[:-8], h8[8:])
    gram = _join(h16[:n - GRAM + 1], h4[16:16 + n - GRAM + 1])
    h32 = _join(h16[:-16], h16[16:])
    h48 = _join(h32[:n - 47], h16[32:32 + n - 47])
    span = _join(h48[:n - SPAN + 1], h2[48:48 + n - SPAN + 1])
    # smallest gram of each string, then the largest of these over the strings that hold a gram:
    # a gram is an anchor when that is itself
    w = REACH + 1
    least = _sliding(gram, w, np.minimum)
    padded = np.concatenate((np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)))
    at = np.flatnonzero(_sliding(padded, w, np.maximum)[:len(gram)] == gram)
    # context: bytes [at - REACH, at + SPAN) inside the text, as far as strings that hold the gram reach
    low, high = np.maximum(at - REACH, 0), np.minimum(at, n - SPAN)
    context = _join(_join(span[low], span[high]), ((at - low) * 64 + (at - high)).astype(np.uint64))
    return gram[at], context, at


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every window of w, by doubling."""
    size = 1
    while size * 2 <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[:len(x) - (w - size)], x[w - size:]) if size < w else x


def _anchor_rows(rows: DataFrame) -> DataFrame:
    names = ["key", "low", "place", "doc_id", *tags_of(rows)]

    def find(batches):
        for batch in slices(batches, 1 << 20):
            keys, lows, places, owner = [], [], [], []
            for k, text in enumerate(text_bytes(batch.column(1))):
                gram, context, at = anchors(text)
                if len(at):
                    keys.append((gram & _GRAM_BITS) | (context >> np.uint64(48)))
                    lows.append(context.astype(np.uint32))
                    places.append(at)
                    owner.append(np.full(len(at), k))
            if keys:
                owner = np.concatenate(owner)
                rows_of = [batch.column(c).to_numpy()[owner] for c in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(lows).view(np.int32)),
                     pa.array(np.concatenate(places)), *map(pa.array, rows_of)], names=names)

    return rows.mapInArrow(find, _schema("key long, low int, place long, doc_id long", rows))


def _schema(fields: str, rows: DataFrame) -> str:
    """With the columns that keep rows of one id apart, last."""
    return ", ".join([fields, *(f"{t} long" for t in tags_of(rows))])


# key: 48 bits of the gram's hash, 16 of the context's; low: 32 more of the context's
_GRAM_BITS = np.uint64(2**64 - 2**16)


def _settle(found: DataFrame) -> DataFrame:
    """Rows (doc_id, place, gram, parts, tags): parts 0 for later copies in full, else the number of
    shards the anchor's contexts go to. Anchors that no other document has are dropped."""
    names = ["place", "gram", "parts", "doc_id", *tags_of(found)]

    def settle(batches):
        def decided(key, low, place, doc, *tags):
            """Whole anchors, sorted by (gram, context, doc)."""
            gram = key >> 16
            new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
            new_context = np.concatenate(([True], (key[1:] != key[:-1]) | (low[1:] != low[:-1])))
            g, c = np.cumsum(new_gram) - 1, np.cumsum(new_context) - 1
            first_doc = doc[new_context][c]                        # sorted: the first is the smallest
            g_starts = np.flatnonzero(new_gram)
            least, most = np.minimum.reduceat(doc, g_starts)[g], np.maximum.reduceat(doc, g_starts)[g]
            contexts = np.add.reduceat(new_context.astype(np.int64), g_starts)[g]
            later = doc > first_doc
            ends = ~later & (contexts > 1) & (least < most)
            parts = np.where(later, 0, 1 + contexts // PART_CONTEXTS).astype(np.int32)
            told = later | ends
            return pa.RecordBatch.from_arrays([pa.array(c[told]) for c in (place, np.where(later, 0, gram), parts, doc, *tags)], names=names)

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            own = own if held is None else [np.concatenate(p) for p in zip(held, own)]
            last = int(np.searchsorted(own[0], own[0][-1] >> 16 << 16, "left"))  # the last anchor may go on
            if last:
                yield decided(*(c[:last] for c in own))
            held = [c[last:] for c in own]
        if held is not None:
            yield decided(*held)

    return (found.repartition(F.shiftright("key", 16)).sortWithinPartitions("key", "low", "doc_id")
            .mapInArrow(settle, _schema("place long, gram long, parts int, doc_id long", found)))


CONTEXT = "gram long, part int, parts int, low long, off int, bytes binary, doc_id long"


def _contexts(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """The bytes around undecided anchors, one row per shard that needs them: ``low`` is where they
    begin in the text, ``off`` where the anchor begins in them."""
    tags = tags_of(rows)
    names = [c.split()[0] for c in CONTEXT.split(", ")] + tags
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()] + [pa.int64()] * (1 + len(tags))

    def read(batches):
        for batch in slices(batches, 2 << 20):
            out = []
            places, grams, counts, *owners = (batch.column(k).to_pylist() for k in range(1, batch.num_columns))
            for text, ats, own_grams, own_counts, *owner in zip(text_bytes(batch.column(0)), places, grams, counts, *owners):
                for at, gram, parts in zip(ats, own_grams, own_counts):
                    low = max(0, at - REACH)
                    piece = text[low:at + SPAN]
                    wanted = (0,) if parts == 1 else sorted({_part(piece[k:k + SPAN], parts) for k in range(len(piece) - SPAN + 1)})
                    out += [(gram, part, parts, low, at - low, piece, *owner) for part in wanted]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    own = ["doc_id", *tags]
    marks = ends.groupBy(*[F.col(c).alias(f"m_{c}") for c in own]).agg(F.collect_list(F.struct("place", "gram", "parts")).alias("marks"))
    return (rows.join(marks, same_row(rows, {c: f"m_{c}" for c in own}))
            .select("text", F.col("marks.place"), F.col("marks.gram"), F.col("marks.parts"), *own)
            .mapInArrow(read, _schema(CONTEXT, rows)))


def _part(string: bytes, parts: int) -> int:
    from xxhash import xxh3_64_intdigest
    return xxh3_64_intdigest(string) % parts


def suffix_ranks(text: np.ndarray, depth: int) -> list[tuple[int, int, np.ndarray]]:
    """Ranks of all suffixes of ``text`` (integers under 500) by their first 1, 3, 7, 14 ... places
    up to at least ``depth``: (length, how often lengths below the next hold it, rank of every
    place); equal ranks, equal strings of that length."""
    n = len(text)
    padded = np.concatenate((text.astype(np.int64) + 1, np.zeros(8, np.int64)))
    key, out = np.zeros(n, np.int64), []
    for j in range(7):
        key = (key << 9) | padded[j:j + n]
        if j in (0, 2):
            out.append((j + 1, 2, key))
    length = 7
    while True:
        _, rank = np.unique(key, return_inverse=True)
        rank = rank.astype(np.int64)
        out.append((length, 1, rank))
        if length >= depth:
            return out
        behind = np.zeros(n, np.int64)
        behind[:max(0, n - length)] = rank[length:] + 1
        key = rank * (n + 2) + behind
        length *= 2


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier place with a smaller value, or -1 (pointer jumping)."""
    n = len(values)
    to = np.arange(-1, n - 1)
    open_ = np.flatnonzero((to >= 0) & (values[np.maximum(to, 0)] >= values))
    while len(open_):
        # the candidate's own candidate: everything between is no smaller than the candidate
        to[open_] = to[to[open_]]
        open_ = open_[(to[open_] >= 0) & (values[np.maximum(to[open_], 0)] >= values[open_])]
    return to


def previous_factors(text: np.ndarray, starts: np.ndarray, owner: np.ndarray, depth: int) -> np.ndarray:
    """Longest previous factor, up to at least ``depth``, of the suffixes at ``starts``: the longest
    prefix that also starts in a smaller ``owner`` (the document of each start)."""
    levels = suffix_ranks(text, depth)
    order = np.argsort(levels[-1][2][starts], kind="stable")     # the suffix array, restricted to starts
    sa, doc = starts[order], owner[order]
    n = len(text)

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix, by the ranks from long to short."""
        length = np.zeros(len(a), np.int64)
        for step, times, rank in reversed(levels):
            for _ in range(times):
                x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
                same = (rank[x] == rank[y]) & (a + length < n) & (b + length < n)
                length[same] += step
        return length

    factor = np.zeros(len(sa), np.int64)
    back = nearest_smaller(doc)
    ahead = len(doc) - 1 - nearest_smaller(doc[::-1])[::-1]      # len(doc) where there is none
    for near, there in ((back, back >= 0), (ahead, ahead < len(doc))):
        at = np.flatnonzero(there)
        factor[at] = np.maximum(factor[at], common(sa[at], sa[near[at]]))
    out = np.empty(len(sa), np.int64)
    out[order] = factor
    return out


def _shared(strings: np.ndarray, gram: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per row of small integers the longest prefix it shares with a row of the same gram and
    another document, -1 where there is none: neighbours in sorted order have it."""
    keys = []
    for at in range(0, strings.shape[1], 7):
        key = np.zeros(len(strings), np.int64)
        for j in range(at, min(at + 7, strings.shape[1])):
            key = (key << 9) | strings[:, j]
        keys.append(key)
    order = np.lexsort((doc, *reversed(keys), gram))
    s, g, d = strings[order], gram[order], doc[order]
    n = len(order)
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
    starts = np.append(np.flatnonzero(new), n)
    run = np.cumsum(new) - 1
    best = np.full(n, -1, np.int64)
    for near in (starts[run] - 1, starts[run + 1]):
        at = np.flatnonzero((near >= 0) & (near < n))
        at = at[g[near[at]] == g[at]]
        best[at] = np.maximum(best[at], np.logical_and.accumulate(s[at] == s[near[at]], axis=1).sum(axis=1))
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def _candidates(text: np.ndarray, begin: np.ndarray, sizes: np.ndarray, off: np.ndarray, gram: np.ndarray, doc: np.ndarray):
    """First and last start of the strings of each context that another document may have: they reach
    no further to the left and right of the gram than what some other document shares there."""
    steps = np.arange(REACH)
    left = np.where(steps < off[:, None], text[np.maximum(begin[:, None] + off[:, None] - 1 - steps, 0)] + 1, 0)
    after = off[:, None] + GRAM + steps
    right = np.where(after < sizes[:, None], text[np.minimum(begin[:, None] + after, len(text) - 1)] + 1, 0)
    a, b = _shared(left, gram, doc), _shared(right, gram, doc)
    return np.maximum(0, off - a), np.where((a < 0) | (b < 0), -1, np.minimum(sizes, off + GRAM + b) - SPAN)


def _copied(contexts: DataFrame) -> DataFrame:
    """Runs (start, end, doc_id, tags) of starts of strings that a smaller document has, from whole shards."""
    names = [c.split()[0] for c in CONTEXT.split(", ")] + tags_of(contexts)

    def pieces(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes back to back, and the size of each value."""
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        return data, np.diff(offsets).astype(np.int64)

    def laid_out(data, sizes, fill):
        """Each value followed by one place of ``fill``; where each begins."""
        text = np.full(len(data) + len(sizes), fill, np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        inside = np.ones(len(text), bool)
        inside[begin + sizes] = False
        text[inside] = data
        return text, begin

    def shard(rows: pa.RecordBatch):
        gram, part, parts, low, off = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        doc, *tags = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(6, rows.num_columns))
        data, sizes = pieces(rows.column(5))
        begin = np.cumsum(sizes) - sizes
        lo, hi = _candidates(data.astype(np.int64), begin, sizes, off.astype(np.int64), gram, doc)
        keep = hi >= lo
        if not keep.any():
            return None
        # of each context that is left, the bytes of its candidates
        part, parts, doc, tags = part[keep], parts[keep], doc[keep], [t[keep] for t in tags]
        low, begin, sizes = low[keep] + lo[keep], begin[keep] + lo[keep], (hi - lo)[keep] + SPAN
        places = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
        # a separator that is no byte ends each context; matches with it never reach SPAN
        text, begin = laid_out(data[places], sizes, 256)
        counts = sizes - SPAN + 1
        own = np.repeat(np.arange(len(sizes)), counts)
        offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        first = np.cumsum(counts) - counts
        for k in np.flatnonzero(parts > 1).tolist():  # strings of other shards are not judged here
            piece = text[begin[k]:begin[k] + sizes[k]].astype(np.uint8).tobytes()
            other = [_part(piece[o:o + SPAN], int(parts[k])) != part[k] for o in range(int(counts[k]))]
            offset[first[k]:first[k] + counts[k]][np.array(other, bool)] = -1
        own, offset = own[offset >= 0], offset[offset >= 0]
        hit = previous_factors(text, begin[own] + offset, doc[own], SPAN) >= SPAN
        owner, at = [c[own[hit]] for c in (doc, *tags)], low[own[hit]] + offset[hit]
        if not len(at):
            return None
        order = np.lexsort((at, *reversed(owner)))
        owner, at = [c[order] for c in owner], at[order]
        new = np.concatenate(([True], at[1:] > at[:-1] + 1))
        for c in owner:
            new[1:] |= c[1:] != c[:-1]
        last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(at) - 1]))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (at[new], at[last] + SPAN, *(c[new] for c in owner))],
                                          names=["start", "end", *names[6:]])

    def judge(batches):
        held: list[pa.RecordBatch] = []
        for batch in slices(batches, SHARD_BYTES):
            held.append(batch)
            if sum(b.nbytes for b in held) < SHARD_BYTES:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            gram, part = (rows.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            same = (gram == gram[-1]) & (part == part[-1])      # sorted: the last anchor's rows end the table
            whole = int(np.argmax(same))
            if whole:
                if (out := shard(rows.slice(0, whole))) is not None:
                    yield out
                rows = pa.Table.from_batches([rows.slice(whole)]).combine_chunks().to_batches()[0]
            held = [rows]
        if held:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if (out := shard(rows)) is not None:
                yield out

    return (contexts.select(names).repartition("gram", "part").sortWithinPartitions("gram", "part", "doc_id")
            .mapInArrow(judge, _schema("start long, end long, doc_id long", contexts)))


def copied_spans(rows: DataFrame) -> DataFrame:
    """Spans of (doc_id, text, tags) rows, in bytes; they may overlap. The columns that name the row
    begin with ``s_``. Texts without later copies have no row."""
    spark = rows.sparkSession
    standing = cut(_settle(_anchor_rows(rows)), "anchors")
    release(spark)
    own = ["doc_id", *tags_of(rows)]
    # a later copy in full covers all strings that hold the anchor; the text's end is met when cutting
    full = standing.where("parts = 0").select(F.greatest(F.col("place") - REACH, F.lit(0)).alias("start"), (F.col("place") + SPAN).alias("end"), *own)
    ends = cut(_copied(_contexts(rows, standing.where("parts > 0"))), "copied-ends")
    release(spark)
    return (full.unionByName(ends).groupBy(*[F.col(c).alias(f"s_{c}") for c in own])
            .agg(F.collect_list(F.struct("start", "end")).alias("spans")))


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans, kept_sha256 and, with ``with_text``, the kept bytes."""
    prepare(docs.sparkSession)
    rows = tagged(id_text(docs, id_col, text_col))
    spans = copied_spans(rows)

    def remove(batches):
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        for batch in slices(batches, 2 << 20):
            out = []
            starts, ends = (batch.column(k).to_pylist() for k in (2, 3))
            for doc_id, text, low, high in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), starts, ends):
                n = len(text)
                if low:
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, np.minimum(low, n), 1)
                    np.add.at(step, np.minimum(high, n), -1)
                    gone = np.cumsum(step[:-1]) > 0
                    n_spans = len(runs_of(gone)[0])
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                else:
                    n_spans, kept = 0, text
                out.append((doc_id, n, n - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                             names=[c.split()[0] for c in REPORT.split(", ")])

    joined = rows.join(spans, same_row(rows, {c: f"s_{c}" for c in rows.columns}), "left")
    out = joined.select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends")).mapInArrow(remove, REPORT)
    return out.select(shown_id(), *(c for c in out.columns[1:] if with_text or c != "kept"))
