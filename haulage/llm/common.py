"""Helpers shared by the training-data operators.

Ids: every operator takes integer ids. A null id is one more id that sorts after all others
(inside the jobs it is ``NULL_ID``); results show it as null again. Null text is empty text.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import time
import uuid
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.session import ensure_checkpoint_dir, ship_package

NULL_ID = 2**63 - 1


# what goes to a Python worker at once; Spark's own default keeps 64 MB on both sides of the pipe. An executor's
# buffers double past this size, and what they leave in its native heap stays there through all later stages
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))


def prepare(spark: SparkSession) -> SparkSession:
    """Checkpoint folder known, package importable in the Python workers, batches of texts bounded
    (where the cluster does not say otherwise)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if not spark.sparkContext.getConf().contains(BATCH_BYTES[0]):
        spark.conf.set(*BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/haulage-llm/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so work that
    follows survives lost executors without repeating what came before."""
    spark = df.sparkSession
    path = work_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> None:
    """Delete all tables that :func:`cut` wrote under the checkpoint folder. Results read them, so
    only once every result has been written elsewhere."""
    from haulage.llm.shared_files import open_fs
    filesystem, inner = open_fs(f"{ensure_checkpoint_dir(spark).rstrip('/')}/haulage-llm")
    if filesystem.get_file_info(inner).type == pafs.FileType.Directory:
        filesystem.delete_dir(inner)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of jobs that are done (their results are tables by
    now). It acts only when the driver's JVM collects its garbage, and what a first collection
    frees (plans held by weak references) holds on to more, hence several."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker from task to task."""
    return _CACHES.setdefault(owner, {})


def lean(run, owner: str = ""):
    """``run`` for mapInArrow in workers that Spark uses again for other stages: caches of other
    operators go when it starts, and memory that it freed returns to the machine when it ends."""
    def task(batches):
        for name, cache in _CACHES.items():
            if name != owner:
                cache.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of any frame, whatever other columns it has."""
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """64-bit hash of a row's id and text: rows that share an id (or have none) but not their text
    keep apart. Made from the row alone, so it is the same in every pass."""
    return F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)),
                      F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


TAGS = ("tag_a", "tag_b")


def tagged(rows: DataFrame) -> DataFrame:
    """(doc_id, text) rows with two more longs, the halves of the text's MD5, where some id repeats:
    they keep rows apart that share an id (or have none) but not their text. Where no id repeats
    the rows stay as they are; :func:`tags_of` names what was added."""
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    half = lambda k: F.conv(F.substring(F.md5("text"), k, 16), 16, -10).cast("long")
    return rows.withColumns({TAGS[0]: half(1), TAGS[1]: half(17)})


def tags_of(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c in TAGS]


def same_row(rows: DataFrame, names: dict[str, str]):
    """Join condition: ``doc_id`` and the tags equal the columns that ``names`` gives for them."""
    return functools.reduce(lambda x, y: x & y, [F.col(c) == F.col(names[c]) for c in ("doc_id", *tags_of(rows))])


def shown_id(col: str = "doc_id"):
    """The id as results show it."""
    return F.when(F.col(col) != NULL_ID, F.col(col)).alias(col)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(batches, max_bytes: int):
    """Arrow batches cut into runs of rows with about ``max_bytes`` of buffers each (a single
    row is never split)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * max_bytes // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def gathered(batches, max_bytes: int):
    """Lists of the first two columns of Arrow batches, small batches together and large ones in
    slices, about ``max_bytes`` of buffers at a time."""
    first, second, held = [], [], 0
    for batch in slices(batches, max_bytes):
        if first and held + batch.nbytes > max_bytes:
            yield first, second
            first, second, held = [], [], 0
        first += batch.column(0).to_pylist()
        second += batch.column(1).to_pylist()
        held += batch.nbytes
    if first:
        yield first, second


def word_ids(words, vocabulary=None) -> tuple[np.ndarray, int]:
    """Exact integer ids of words in order of first appearance, and how many ids there are."""
    vocabulary = defaultdict(count().__next__) if vocabulary is None else vocabulary
    ids = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
    return ids, len(vocabulary)


def window_keys(ids: np.ndarray, n_ids: int, k: int) -> np.ndarray:
    """Exact integer key of every window of ``k`` ids: equal keys, equal windows."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    key, size = ids[:n].copy(), max(1, n_ids)
    for j in range(1, k):
        if size > 2**62 // max(1, n_ids):
            distinct, key = np.unique(key, return_inverse=True)
            size = len(distinct)
        key = key * n_ids + ids[j:j + n]
        size *= n_ids
    return key


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<i8").tobytes(), 1)


def sum_blocks(parts: DataFrame, blocks: int) -> np.ndarray:
    """Sum of integer arrays that tasks emitted as rows (block, counts), counts ``packed``.

    Added up in two levels of tasks, a block at a time as rows stream by, so that no task holds or
    adds the arrays of all tasks; one row per block comes back, a size that the data don't change.
    """
    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(counts), "<i8")
                sums[block] = sums[block] + own if block in sums else own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                              pa.array([packed(s) for s in sums.values()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    parts = parts.select("block", "counts")
    parts = parts.repartition("block", F.pmod(F.xxhash64("counts"), F.lit(16))).mapInArrow(total, schema)
    rows = parts.repartition("block").mapInArrow(total, schema).collect()
    found = {r["block"]: np.frombuffer(zlib.decompress(bytes(r["counts"])), "<i8") for r in rows}
    if not found:
        return np.zeros(0, np.int64)
    size = len(next(iter(found.values())))
    return np.concatenate([found.get(b, np.zeros(size, np.int64)) for b in range(blocks)])
