"""Vector code compression: integer codebooks, with entries found through LAESA pivots.

Vectors become integers floor(1024 * x), cut into four equal parts; each part position has a
codebook of up to 256 entries that starts as the parts of the smallest ids and is refined by
rounds of assigning and averaging. All arithmetic that decides is integer.

* Pivots: each part position has a few fixed pivots, far apart from each other. The distance of
  every part to its pivots is computed once and stored with the integer vectors; a round only
  computes those of its 256 entries. By the triangle inequality the largest difference of the two
  is a lower bound of the part's distance to an entry.
* A part takes the entries in the order of their bounds, eight at a time, evaluates them exactly
  and stops at the first bound that the best distance so far does not exceed. Square roots are
  rounded down and the bounds are one less for it, so no entry that could win, or tie, is skipped.
* The vectors are read once a round where they lie; tasks send sums and counts of entries, a fixed
  size (4 x 256 rows of integers) that is added up in two levels. Codebooks go to the tasks as a
  broadcast of fixed size. Nothing else is shuffled but the errors by label, combined map-side.

Defined cases: rows whose vector is null, empty, holds a null, NaN or infinity, or has a length
that four does not divide are dropped, and so are those of another length than the smallest id's
vector. Integers saturate where squared sums would leave 60 bits (131072 for 64 components). A
null id sorts last and is shown as null; rows that share an id are ordered by their vectors and
each gets its row. Fewer than 256 rows make as many entries. Other columns are ignored; a table
without rows to keep gives none.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import NULL_ID, cut, packed, prepare, shown_id, slices, sum_blocks

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
PIVOTS, WAVE = 8, 8
SLICE_BYTES = 1 << 20
BITS = 60                    # squared sums stay below 2 ** BITS


def floor_root(d: np.ndarray) -> np.ndarray:
    """Largest integers whose squares do not exceed ``d``."""
    s = np.sqrt(d.astype(np.float64)).astype(np.int64)
    s -= s * s > d
    s += (s + 1) * (s + 1) <= d
    return s


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``a`` to every row of ``b``, exact integers."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the points: the first, then always the one farthest from those taken."""
    taken = [0]
    near = squared(points, points[:1])[:, 0]
    while len(taken) < min(n, len(points)) and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, squared(points, points[taken[-1:]])[:, 0])
    return points[taken]


def nearest(parts: np.ndarray, part_roots: np.ndarray, entries: np.ndarray, entry_roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Per part the nearest entry (ties to the lower index), its squared distance, and the number
    of exact evaluations made. Roots are the rounded-down distances to the pivots."""
    n, k = len(parts), len(entries)
    bound = np.zeros((n, k), np.int32)
    for p in range(part_roots.shape[1]):
        np.maximum(bound, np.abs(part_roots[:, p, None] - entry_roots[None, :, p]), out=bound)
    bound -= 1        # of distances: the exact one lies above it, also where it is zero
    order = np.argsort(bound, axis=1).astype(np.int32)
    best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, k, np.int64)
    live, made = np.arange(n), 0
    for start in range(0, k, WAVE):
        if start:
            least = bound[live, order[live, start]].astype(np.int64)
            live = live[(least < 0) | (least * least < best[live])]
        if not len(live):
            break
        tried = order[live, start:start + WAVE].astype(np.int64)
        d = ((parts[live, None, :] - entries[tried]) ** 2).sum(axis=2)
        made += d.size
        low = d.min(axis=1)
        at = np.where(d == low[:, None], tried, k).min(axis=1)
        better = (low < best[live]) | ((low == best[live]) & (at < index[live]))
        best[live[better]], index[live[better]] = low[better], at[better]
    return index, best, made


@dataclass(frozen=True)
class Codebooks:
    """Entries (part, entry, component) and the fixed pivots of every part position."""
    entries: np.ndarray
    pivots: tuple[np.ndarray, ...]

    def roots(self, k: int, points: np.ndarray) -> np.ndarray:
        return floor_root(squared(points, self.pivots[k])).astype(np.int32)

    def assign(self, vectors: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes (n, parts) and squared distances (n, parts) of whole vectors."""
        found = []
        first = np.cumsum([0] + [len(p) for p in self.pivots])
        for k, part in enumerate(np.split(vectors, PARTS, axis=1)):
            found.append(nearest(part, roots[:, first[k]:first[k + 1]], self.entries[k], self.roots(k, self.entries[k]))[:2])
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def moved(self, totals: np.ndarray) -> Codebooks:
        """Entries as rounded-down means; ``totals`` has sums and, last, the count of each."""
        sums, count = totals[..., :-1], totals[..., -1:]
        return Codebooks(np.where(count > 0, sums // np.maximum(count, 1), self.entries), self.pivots)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _limit(width: int) -> int:
    """Largest power of two to which integers may go."""
    return 1 << (BITS - 2 - (width - 1).bit_length()) // 2


def _kept(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, x array<double>) of rows that can be cut in parts."""
    rows = vectors.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("vec_id"),
                          F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("x"))
    odd = F.exists("x", lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)))
    return rows.where(F.col("x").isNotNull() & ~odd & (F.size("x") > 0) & (F.size("x") % PARTS == 0))


def _unpacked(column, dtype) -> np.ndarray:
    """Rows of equally long little-endian integers, one binary value each."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 rounds: int = ROUNDS) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    spark = prepare(vectors.sparkSession)
    kept = _kept(vectors, id_col, vec_col, label_col)
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    head = kept.orderBy("vec_id", "x").limit(1).select(F.size("x")).collect()
    if not head:
        return spark.createDataFrame([], schema)
    width = head[0][0]
    limit = float(_limit(width))
    whole = F.transform("x", lambda v: F.least(F.greatest(F.floor(F.least(F.greatest(v * SCALE, F.lit(-limit)), F.lit(limit))), F.lit(-int(limit))), F.lit(int(limit))))
    kept = kept.where(F.size("x") == width).select("vec_id", "label", whole.alias("x"))
    first = np.array([r["x"] for r in kept.orderBy("vec_id", "x").limit(ENTRIES).select("x").collect()], np.int64)
    entries = np.stack(np.split(first, PARTS, axis=1))
    book = Codebooks(entries, tuple(far_apart(e, PIVOTS) for e in entries))

    def measure(batches, book=book):
        for batch in slices(batches, SLICE_BYTES):
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, width)
            roots = np.concatenate([book.roots(k, part) for k, part in enumerate(np.split(x, PARTS, axis=1))], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()),
                 pa.array([r.tobytes() for r in roots.astype("<i4")], pa.binary())], names=["vec_id", "label", "x", "roots"])

    label = kept.schema["label"].dataType.simpleString()
    table = cut(kept.mapInArrow(measure, f"vec_id long, label {label}, x binary, roots binary"), "vectors")

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(book)

        def add(batches, shared=shared):
            book = shared.value
            n = book.entries.shape[1]
            totals = np.zeros((PARTS, n, width // PARTS + 1), np.int64)
            for batch in slices(batches, SLICE_BYTES):
                x = _unpacked(batch.column(0), "<i4").astype(np.int64)
                at, _ = book.assign(x, _unpacked(batch.column(1), "<i4"))
                for k, part in enumerate(np.split(x, PARTS, axis=1)):
                    np.add.at(totals[k, :, :-1], at[:, k], part)
                    totals[k, :, -1] += np.bincount(at[:, k], minlength=n)
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([packed(t) for t in totals], pa.binary())],
                                             names=["block", "counts"])

        totals = sum_blocks(table.select("x", "roots").mapInArrow(add, "block int, counts binary"), PARTS)
        book = book.moved(totals.reshape(PARTS, -1, width // PARTS + 1))

    shared = spark.sparkContext.broadcast(book)

    def encode(batches):
        book = shared.value
        for batch in slices(batches, SLICE_BYTES):
            at, d = book.assign(_unpacked(batch.column(2), "<i4").astype(np.int64), _unpacked(batch.column(3), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes().hex() for r in at.astype(np.uint8)]),
                 pa.array(d.sum(axis=1), pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = cut(table.mapInArrow(encode, f"vec_id long, label {label}, code string, error long"), "codes")
    # a table of its own: joined by its measured size, and a hot label's rows can be split
    by_label = cut(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select(
        shown_id("vec_id"), "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))
