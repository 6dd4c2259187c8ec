"""SimHash near duplicates found with BK-trees.

A text's fingerprint has a bit set where over half of its shingle hashes have it. Fingerprints
link at ``radius`` or fewer differing bits; a document's component is what links reach.

* Fingerprints are made where the rows are read; only (id, fingerprint) leaves the texts. Equal
  fingerprints are one node from then on, combined map-side, so copies are never paired.
* Shards: ``radius`` differing bits cannot touch all of ``radius`` + 1 pieces of a fingerprint, so
  linked fingerprints agree on one whole piece and meet in the shard of its value. Where the
  number of distinct fingerprints makes shards of one piece large, the remaining bits are cut
  again in the same way (``_masks``): no link is lost at any depth.
* A shard is a BK-tree: a child hangs on the edge numbered by its Hamming distance to the parent,
  and a search with a fingerprint at distance d of a node follows only the edges d - radius ..
  d + radius. All trees that a task holds are built and searched level by level as flat arrays.
* A shard over ``tree_size`` is cut into trees of that size at most; every tree is sent to every
  slice of the shard's fingerprints, one task group each, so a hot shard spreads over the cluster.
* A tree gives at most one edge per fingerprint (a spanning forest of its links), never all
  pairs. Star contraction on tables joins the edges of all shards.

Defined cases: null text, and text without words, has fingerprint zero, which links like any
other; with fewer words than a shingle the whole sequence is one. Repeated ids keep their rows, a
null id sorts last and is shown as null. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from haulage.llm.common import cut, id_text, prepare, release, shown_id, slices, text_bytes
from haulage.llm.graph import components

SHINGLE_WORDS, SEED, BITS, RADIUS = 3, 42, 64, 3
TREE_SIZE = 4096          # fingerprints of one BK-tree
SHARD_ROWS = 1024         # mean size from which shards are cut by further pieces
FOREST_ROWS = 1 << 16     # fingerprints whose trees a task searches at once
FRONTIER = 1 << 20        # (fingerprint, node) pairs compared at once
HASH_RUN = 1 << 16        # shingle hashes counted at once

_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS):
    """XXH64 of the text's shingles, repeats included, in runs of bounded length."""
    found = text.translate(_LOWER).split()      # exactly the bytes 0x20 and 0x09-0x0D part words
    if not found:
        return
    line = b" ".join(found)
    if len(found) <= words:
        yield np.array([xxh64_intdigest(line, SEED)], np.uint64)
        return
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[:len(found) - words + 1], ends[words - 1:]
    for k in range(0, len(starts), HASH_RUN):
        run = [line[a:b] for a, b in zip(starts[k:k + HASH_RUN].tolist(), ends[k:k + HASH_RUN].tolist())]
        yield np.fromiter(map(xxh64_intdigest, run, repeat(SEED)), np.uint64, len(run))


def fingerprints(texts: list[bytes], words: int = SHINGLE_WORDS) -> np.ndarray:
    """Unsigned 64-bit fingerprint of every text."""
    out = np.zeros(len(texts), np.uint64)
    runs, owner, held = [], [], 0
    counts, total = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)

    def add_up():
        nonlocal runs, owner, held
        if not runs:
            return
        bits = np.unpackbits(np.concatenate(runs).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sizes = np.array([len(r) for r in runs])
        sums = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int32)
        np.add.at(counts, owner, sums)
        np.add.at(total, owner, sizes)
        runs, owner, held = [], [], 0

    for k, text in enumerate(texts):
        for run in shingle_hashes(text, words):
            runs.append(run)
            owner.append(k)
            held += len(run)
            if held >= HASH_RUN:
                add_up()
    add_up()
    over = (2 * counts > total[:, None]).astype(np.uint64)
    for j in range(BITS):
        out |= over[:, j] << np.uint64(j)
    return out


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long."""
    def make(batches):
        for batch in slices(batches, 4 << 20):
            fp = fingerprints(text_bytes(batch.column(1)), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    prepare(docs.sparkSession)
    return id_text(docs, id_col, text_col).mapInArrow(make, "doc_id long, fp long")


def _masks(radius: int, depth: int, bits: list[int] | None = None) -> list[int]:
    """Bit masks of which fingerprints within ``radius`` agree on at least one: at every depth
    the bits left are cut into ``radius`` + 1 pieces, one of which cannot differ."""
    left = list(range(BITS)) if bits is None else bits
    if depth == 0 or len(left) <= radius:
        return [0]
    out = []
    for piece in np.array_split(np.array(left), radius + 1):
        own = sum(1 << int(b) for b in piece)
        rest = [b for b in left if not own >> b & 1]
        out += [own | more for more in _masks(radius, depth - 1, rest)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _depth(n: int, radius: int) -> int:
    """Pieces that make a shard's mean size small: known from the number of fingerprints alone."""
    for depth in (1, 2, 3):
        if n / 2.0 ** min(m.bit_count() for m in _masks(radius, depth)) <= SHARD_ROWS:
            return depth
    return 3


class Forest:
    """BK-trees as flat arrays, one tree per run of equal ``tree``; built level by level.

    The first row of a group is its node, the others go on to the group of their distance to it:
    the tree that inserting the rows one by one gives. A level's nodes lie in order of (parent,
    edge), so the children of a node between two edges are one range."""

    def __init__(self, tree: np.ndarray, fp: np.ndarray, rows: np.ndarray):
        self.levels = []                                    # (rows, sorted parent * 65 + edge)
        group = np.concatenate(([0], np.cumsum(tree[rows][1:] != tree[rows][:-1]))) if len(rows) else np.empty(0, np.int64)
        key = np.unique(group)
        while len(rows):
            first = np.concatenate(([True], group[1:] != group[:-1]))
            nodes = rows[first]
            self.levels.append((nodes, key))
            place = np.cumsum(first) - 1
            rest = ~first
            edge = np.bitwise_count(fp[rows[rest]] ^ fp[nodes[place[rest]]]).astype(np.int64)
            below = place[rest] * (BITS + 1) + edge
            order = np.argsort(below, kind="stable")
            rows, group = rows[rest][order], below[order]
            key = np.unique(group)

    def search(self, fp: np.ndarray, queries: np.ndarray, root: np.ndarray, radius: int):
        """Pairs (query row, tree row) within ``radius``, in bounded pieces; ``root`` is the
        number of each query's tree."""
        todo = [(0, queries, root)]
        while todo:
            level, q, at = todo.pop()
            if len(q) > FRONTIER:
                todo += [(level, q[k:k + FRONTIER], at[k:k + FRONTIER]) for k in range(0, len(q), FRONTIER)]
                continue
            nodes = self.levels[level][0][at]
            far = np.bitwise_count(fp[q] ^ fp[nodes]).astype(np.int64)
            near = (far <= radius) & (q != nodes)
            if near.any():
                yield q[near], nodes[near]
            if level + 1 == len(self.levels):
                continue
            key = self.levels[level + 1][1]
            low = np.searchsorted(key, at * (BITS + 1) + np.maximum(far - radius, 0), "left")
            high = np.searchsorted(key, at * (BITS + 1) + np.minimum(far + radius, BITS), "right")
            some = high > low
            q, low, width = q[some], low[some], (high - low)[some]
            for k0, k1 in _cuts(width, FRONTIER):
                w = width[k0:k1]
                if len(w):
                    step = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                    todo.append((level + 1, np.repeat(q[k0:k1], w), np.repeat(low[k0:k1], w) + step))


def _cuts(width: np.ndarray, most: int):
    """Ranges of rows whose widths add up to about ``most`` (a single one may exceed it)."""
    total = np.cumsum(width)
    start = 0
    while start < len(width):
        upto = int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right"))
        upto = max(upto, start + 1)
        yield start, upto
        start = upto


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of rows ``a`` and ``b`` in place: ``label`` names every row's smallest known partner."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def _tile_edges(tile: np.ndarray, role: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of whole tiles, rows in tile order. Roles: 0 in the tree, 1 searching, 2 both."""
    rows = np.flatnonzero(role != 1)
    forest = Forest(tile, fp, rows)
    label = np.arange(len(fp))
    if len(rows):
        queries = np.flatnonzero(role != 0)
        trees = tile[forest.levels[0][0]]
        root = np.minimum(np.searchsorted(trees, tile[queries]), len(trees) - 1)
        has = trees[root] == tile[queries]
        for a, b in forest.search(fp, queries[has], root[has], radius):
            merge(label, a, b)
    joined = np.flatnonzero(label != np.arange(len(fp)))
    return fp[joined], fp[label[joined]]


def _edges(radius: int):
    """mapInArrow over rows (tile, role, fp) in tile order: edges (a, b), at most one per row."""
    def edges(batches):
        held: list[np.ndarray] = []
        n = 0

        def settle(rows):
            a, b = _tile_edges(rows[0], rows[1], rows[2].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]))
            n += batch.num_rows
            if n < FOREST_ROWS:
                continue
            rows = np.concatenate(held, axis=1)
            last = int(np.searchsorted(rows[0], rows[0][-1], "left"))   # the last tile may go on
            held, n = [rows[:, last:]], rows.shape[1] - last
            if last:
                yield settle(rows[:, :last])
        if n:
            yield settle(np.concatenate(held, axis=1))

    return edges


def links(nodes: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` of ``nodes`` that connect all that lie
    within ``radius`` of each other, directly or along other edges."""
    spark = nodes.sparkSession
    masks = _masks(radius, _depth(nodes.count(), radius))
    shards = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)])
    placed = nodes.select("fp", F.explode(shards).alias("shard"))
    large = cut(placed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > tree_size)
                .select("shard", F.ceil(F.col("n") / tree_size).cast("int").alias("parts")), "large-shards")
    if large.isEmpty():
        tiles = placed.select(F.col("shard").alias("tile"), F.lit(2).alias("role"), "fp")
    else:  # tile (x, y), x <= y: the tree of slice x, searched with slice y
        own = placed.join(large, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = own.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        own = own.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        role = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        tiles = own.select(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), role.alias("role"), "fp")
    dealt = tiles.repartition("tile").sortWithinPartitions("tile", "fp")
    found = cut(dealt.mapInArrow(_edges(radius), "a long, b long"), "fp-edges")
    release(spark)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                    radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Per document row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id
    that links reach, its own included)."""
    rows = cut(fingerprint_rows(docs, id_col, text_col, words), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-nodes")
    comps = cut(components(links(nodes, radius, tree_size)), "fp-comps")
    named = nodes.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    # components of one fingerprint, nearly all of them, need no further shuffle
    alone = named.where("comp = fp").join(comps.select(F.col("comp").alias("c")).distinct(), F.col("comp") == F.col("c"), "left_anti")
    grouped = nodes.join(comps, F.col("fp") == F.col("node")).select("fp", "comp", "least")
    least = grouped.groupBy(F.col("comp").alias("c")).agg(F.min("least").alias("component_id"))
    by_fp = cut(grouped.join(least, F.col("comp") == F.col("c")).select(F.col("fp").alias("f"), "component_id")
                .unionByName(alone.select(F.col("fp").alias("f"), F.col("least").alias("component_id"))), "fp-components")
    return rows.join(by_fp, F.col("fp") == F.col("f")).select(
        shown_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), shown_id("component_id"))
