"""Sharded cuckoo filters: set membership with deletions, small enough to prune a join."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 4
LOAD = 0.85
MAX_ROUNDS = 400
SHARD_KEYS = 200_000
BROADCAST_BYTES = 32 << 20


def key_array(keys: list[bytes]) -> np.ndarray:
    """16-byte keys as an (n, 2) array of 64-bit halves."""
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key lives in one of two buckets.

    No false negatives. ``insert`` never drops: when a key finds no place it reports failure and
    the caller rebuilds a larger filter from the exact table behind it.
    """

    def __init__(self, n_buckets: int, slots: np.ndarray | None = None):
        self.n_buckets = n_buckets
        self.slots = np.zeros((n_buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        n = 1 << max(3, int(np.ceil(np.log2(max(1, len(keys)) / (SLOTS * LOAD)))))
        while True:
            made = cls(n)
            if made.insert(keys):
                return made
            n *= 2

    def _places(self, keys: np.ndarray):
        mask = np.uint64(self.n_buckets - 1)
        print_ = ((keys[:, 1] % np.uint64(65535)) + np.uint64(1)).astype(np.uint16)
        one = (keys[:, 0] & mask).astype(np.int64)
        return print_, one, self._other(one, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        spread = (print_.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(20)
        return bucket ^ (spread & np.uint64(self.n_buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        print_, one, two = self._places(keys)
        return ((self.slots[one] == print_[:, None]) | (self.slots[two] == print_[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """All keys in rounds: in each, every bucket takes as many waiting prints as it has room
        for, and a full bucket passes one of its own on to that one's other bucket."""
        if not len(keys):
            return True
        print_, at, other = self._places(keys)
        roomier = (self.slots[other] == 0).sum(axis=1) > (self.slots[at] == 0).sum(axis=1)
        at = np.where(roomier, other, at)
        victim = 0
        for _ in range(MAX_ROUNDS):
            order = np.argsort(at, kind="stable")
            at, print_ = at[order], print_[order]
            new = np.concatenate(([True], at[1:] != at[:-1]))
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            empty = self.slots[at] == 0
            room = empty.sum(axis=1)
            fits = nth < room
            # the nth empty slot of the bucket
            slot = np.argmax(np.cumsum(empty, axis=1) == (nth + 1)[:, None], axis=1)
            self.slots[at[fits], slot[fits]] = print_[fits]
            if fits.all():
                return True
            swap = ~fits & (nth == room)
            out = self.slots[at[swap], victim].copy()
            self.slots[at[swap], victim] = print_[swap]
            waiting = ~fits & ~swap
            at, print_ = (np.concatenate((self._other(at[swap], out), self._other(at[waiting], print_[waiting]))),
                          np.concatenate((out, print_[waiting])))
            victim = (victim + 1) % SLOTS
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Remove one print per key; only keys that were inserted may be deleted."""
        for print_, one, two in zip(*(x.tolist() for x in self._places(keys))):
            for bucket in (one, two):
                found = np.flatnonzero(self.slots[bucket] == print_)
                if len(found):
                    self.slots[bucket, found[0]] = 0
                    break
            else:
                raise KeyError("key was not in the filter")

    def to_bytes(self) -> bytes:
        return struct.pack("<Q", self.n_buckets) + self.slots.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        n, = struct.unpack_from("<Q", data)
        return cls(n, np.frombuffer(data, "<u2", n * SLOTS, 8).reshape(n, SLOTS).copy())


def n_shards(n_keys: int) -> int:
    return max(1, -(-n_keys // SHARD_KEYS))


def shard_of(key_col: str, shards: int):
    """Shard of a key: its last bytes modulo the number of shards (the filter uses the others)."""
    tail = F.conv(F.hex(F.substring(F.col(key_col), 13, 4)), 16, 10).cast("long")
    return (tail % shards).cast("int")


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) of a table of different 16-byte keys; a shard holds about SHARD_KEYS."""
    def build(group: pa.Table) -> pa.Table:
        made = CuckooFilter.of(key_array(group.column("key").to_pylist()))
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()),
                         "filter": pa.array([made.to_bytes()], pa.binary())})

    return (keys.select(shard_of("key", shards).alias("shard"), "key").groupBy("shard")
            .applyInArrow(build, "shard int, filter binary"))


class ShardedFilters:
    """All shards in one process, for pruning before a join."""

    def __init__(self, shards: int, images: dict[int, bytes]):
        self.shards = shards
        self.filters = {k: CuckooFilter.from_bytes(b) for k, b in images.items()}

    def contains(self, keys: list[bytes]) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        if not keys or not self.filters:
            return out
        halves = key_array(keys)
        shard = np.frombuffer(b"".join(k[12:16] for k in keys), ">u4").astype(np.int64) % self.shards
        for k in np.unique(shard).tolist():
            if k in self.filters:
                own = shard == k
                out[own] = self.filters[k].contains(halves[own])
        return out


def broadcast_filters(filters: DataFrame, shards: int):
    """The filters as a broadcast, or None when they are larger than BROADCAST_BYTES: then every
    key goes to the exact table, which gives the same result."""
    total = filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if total > BROADCAST_BYTES:
        return None
    images = {r["shard"]: bytes(r["filter"]) for r in filters.collect()}
    return filters.sparkSession.sparkContext.broadcast((shards, images))
