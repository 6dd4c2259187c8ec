"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Word vectors come from all documents. Every token falls into one of ``BUCKETS`` buckets by hash;
each bucket has a sparse ternary index vector, drawn by seed, and its context vector is the sum
of the index vectors of the tokens next to its own tokens, over the corpus. Tasks add up integer
tables of fixed size, so neither the shuffle per task nor what is sent out again grows with the
vocabulary.

A document's features pool the vectors of its tokens (mean over all tokens, mean over different
tokens, spread) with a few counts. The network learns from at most ``TRAIN_ROWS`` labelled rows
(chosen by hash, none of them held out), and a temperature fitted on rows it did not learn from
calibrates its probabilities.

Defined cases: null or empty text has all-zero features and gets the score these have; labels
other than 0 and 1 are ignored, of several labels of one id the smallest counts; with labels of
one class or none the score is (ones + 1) / (labels + 1) for all; a null doc_id is not held out
and stays null; repeated rows score alike; extra columns are ignored by ``score`` and kept by
``keep_quality``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import id_text, lean, packed, prepare, shown_id, slices, sum_blocks, text_bytes

BUCKETS = 1 << 14
DIMS = 32
NONZERO = 4
REACH = 2
TABLE_BLOCKS = 8
SEED = 20240601
TRAIN_ROWS = 20_000
CALIBRATION_SHARE = 5     # every fifth training row calibrates
HIDDEN = 32
EPOCHS = 40
THRESHOLD = 0.7
HELD_OUT_MOD, HELD_OUT = 4, 2
MEMO_TOKENS = 400_000

_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\x00-\x20A-Za-z0-9\x80-\xff]+")


class _Buckets(dict):
    def __missing__(self, token):
        from xxhash import xxh3_64_intdigest
        if len(self) > MEMO_TOKENS:
            self.clear()
        self[token] = b = xxh3_64_intdigest(token) % BUCKETS
        return b


def tokens(text: bytes, memo: _Buckets) -> np.ndarray:
    found = _TOKEN.findall(text)
    return np.fromiter(map(memo.__getitem__, found), np.int64, len(found))


def index_vectors(seed: int = SEED) -> np.ndarray:
    """Sparse ternary vectors, one per bucket; the row after the last is zero (no neighbour)."""
    rng = np.random.default_rng(seed)
    table = np.zeros((BUCKETS + 1, DIMS), np.int16)
    for sign in (1, -1):
        at = rng.integers(0, DIMS, (BUCKETS, NONZERO // 2))
        np.add.at(table, (np.arange(BUCKETS)[:, None], at), sign)
    return table


def add_contexts(table: np.ndarray, ids: np.ndarray, index: np.ndarray, step: int = 50_000) -> None:
    """Add to ``table`` the neighbours' index vectors of every token (BUCKETS marks a gap between
    texts), in pieces of bounded work space that still see their neighbours; the last column of
    the table counts tokens. Integer sums: the result does not depend on how texts are dealt."""
    padded = np.concatenate((np.full(REACH, BUCKETS), ids, np.full(REACH, BUCKETS)))
    for at in range(0, len(ids), step):
        part = ids[at:at + step]
        context = np.zeros((len(part), DIMS + 1), np.int32)
        for shift in range(2 * REACH + 1):
            if shift != REACH:
                context[:, :DIMS] += index[padded[at + shift:at + shift + len(part)]]
        context[:, DIMS] = 1
        order = np.argsort(part, kind="stable")
        own = part[order]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        sums = np.add.reduceat(context[order], starts, axis=0)
        real = own[starts] < BUCKETS
        table[own[starts[real]]] += sums[real]


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(BUCKETS, DIMS) vectors of the corpus: mean context of each bucket, centred and scaled."""
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def learn(batches):
        memo, index = _Buckets(), index_vectors()
        table, seen = np.zeros((BUCKETS, DIMS + 1), np.int64), False
        for batch in slices(batches, 1 << 20):
            gap = np.full(REACH, BUCKETS, np.int64)
            ids = np.concatenate([x for text in text_bytes(batch.column(0)) for x in (tokens(text, memo), gap)])
            seen = True
            add_contexts(table, ids, index)
        if seen:
            for block, part in enumerate(np.split(table.reshape(-1), TABLE_BLOCKS)):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed(part)], pa.binary())],
                                                 names=["block", "counts"])

    total = sum_blocks(rows.mapInArrow(lean(learn), "block int, counts binary"), TABLE_BLOCKS)
    if not len(total):
        return np.zeros((BUCKETS, DIMS), np.float32)
    total = total.reshape(BUCKETS, DIMS + 1).astype(np.float64)
    count = total[:, DIMS:]
    mean = total[:, :DIMS] / np.maximum(count, 1)
    centre = (mean * count).sum(axis=0) / max(1.0, count.sum())
    mean = np.where(count > 0, mean - centre, 0.0)
    return (mean / max(1e-9, mean.std())).astype(np.float32)


N_FEATURES = 3 * DIMS + 6


def features(ids: np.ndarray, text: bytes, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros(N_FEATURES, np.float32)
    n = len(ids)
    if not n:
        return out
    own = vectors[ids]
    different = np.unique(ids)
    out[:DIMS] = own.mean(axis=0)
    out[DIMS:2 * DIMS] = vectors[different].mean(axis=0)
    out[2 * DIMS:3 * DIMS] = own.std(axis=0)
    most = np.bincount(ids).max()
    # different tokens fall behind their number as texts grow; the logs' ratio hardly depends on length
    out[3 * DIMS:] = (np.log1p(n), np.log1p(len(different)) / np.log1p(n), most / n,
                      np.count_nonzero(ids[1:] == ids[:-1]) / n, np.log1p(len(text) / n), len(set(text.split(b"\n"))) / (text.count(b"\n") + 1))
    return out


@dataclass(frozen=True)
class Network:
    """Standardised features, one hidden layer of tanh units, a logit and its temperature."""
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Adam on log loss with weight decay; then the temperature with the least log loss on the
    calibration rows."""
    nothing = np.zeros(0)
    if len(y) == 0 or y.min() == y.max():
        return Network(nothing, nothing, nothing, nothing, nothing, 0.0, 1.0, float((y.sum() + 1) / (len(y) + 1)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cal, fit = order[::CALIBRATION_SHARE], np.setdiff1d(order, order[::CALIBRATION_SHARE])
    if len(fit) == 0 or y[fit].min() == y[fit].max():
        fit = order
    x = x.astype(np.float64)
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    z = (x[fit] - mean) / scale
    t = y[fit].astype(np.float64)
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(len(t))
        for k in range(0, len(t), 256):
            b = mixed[k:k + 256]
            hidden = np.tanh(z[b] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -40, 40))) - t[b]) / len(b)
            back = np.outer(error, p[2]) * (1 - hidden**2)
            grads = [z[b].T @ back + 1e-4 * p[0], back.sum(axis=0), hidden.T @ error + 1e-4 * p[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if len(cal):
        logits, c = net.logits(x[cal]), y[cal]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.logaddexp(0, np.where(c > 0, -logits, logits) / g).mean() for g in grid]
        net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), float(grid[int(np.argmin(loss))]))
    return net


def held_out(id_col: str = "doc_id"):
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return F.crc32(name) % HELD_OUT_MOD == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, vectors, id_col: str, text_col: str, label_id: str, label_col: str,
          train_rows: int) -> Network:
    known = (labels.select(F.col(f"`{label_id}`").cast("long").alias("l_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
             .where("l_id IS NOT NULL AND label IN (0, 1)").where(~held_out("l_id"))
             .groupBy("l_id").agg(F.min("label").alias("label"))
             .orderBy(F.xxhash64("l_id"), "l_id").limit(train_rows))
    # at most train_rows rows of two numbers
    rows = id_text(docs, id_col, text_col).join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).select("doc_id", "label", "text")

    def make(batches):
        memo, table = _Buckets(), vectors.value
        for batch in slices(batches, 4 << 20):
            x = [features(tokens(t, memo), t, table).tobytes() for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["doc_id", "label", "x"])

    # repeated ids of one label could exceed the bound: one row per id
    made = (rows.mapInArrow(lean(make), "doc_id long, label int, x binary")
            .groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id"))
    x = np.frombuffer(b"".join(bytes(b) for b in made["x"]), np.float32).reshape(-1, N_FEATURES)
    return fit_network(x, made["label"].to_numpy(np.int64))


@dataclass(frozen=True)
class QualityModel:
    """Word vectors and network as broadcasts of fixed size."""
    vectors: object
    network: object

    def scores(self, texts: list[bytes], memo: _Buckets) -> np.ndarray:
        x = np.zeros((len(texts), N_FEATURES), np.float32)
        for k, text in enumerate(texts):
            x[k] = features(tokens(text, memo), text, self.vectors.value)
        return self.network.value.scores(x)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
        label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> QualityModel:
    context = prepare(docs.sparkSession).sparkContext
    vectors = context.broadcast(word_vectors(docs, text_col))
    return QualityModel(vectors, context.broadcast(
        train(docs, labels, vectors, id_col, text_col, label_id, label_col, train_rows)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col, **options)

    def judge(batches):
        memo = _Buckets()
        for batch in slices(batches, 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(text_bytes(batch.column(1)), memo), pa.float64())],
                                             names=["doc_id", "score"])

    scored = id_text(docs, id_col, text_col).mapInArrow(lean(judge), "doc_id long, score double")
    return (scored.withColumn("doc_id", shown_id())
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that are not rejected, with all their columns; each row by its own text."""
    model = fit(docs, labels, id_col, text_col, **options)

    at = docs.columns.index(text_col)

    def keep(batches):
        memo = _Buckets()
        for batch in slices(batches, 4 << 20):
            yield batch.filter(pa.array(model.scores(text_bytes(batch.column(at)), memo) >= threshold))

    return docs.mapInArrow(lean(keep), docs.schema)
