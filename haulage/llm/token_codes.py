"""Token ids in directly addressable codes.

Ids are split into 8-bit chunks. Level 0 holds the low chunk of every id; a bitmap tells which ids
go on, and those have their next chunk in level 1, and so on. A rank directory over each bitmap
turns "place in level k" into "place in level k + 1", so any token is read without decoding a block.

Documents are range-partitioned by id and encoded in order; a task's ids go into segments of whole
documents, each one code image. The segments are the stored files (a Parquet table with one image
per row, so that Spark's commit keeps exactly one attempt); the start of a partition is the sum of
the partitions before it, one row per partition.

Defined cases: null or empty text is the end id alone; a null doc_id comes last and stays null;
repeated ids follow each other in text order; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haulage.llm.common import cut, gathered, give_back, id_text, lean, prepare, shown_id, worker_cache

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
CHUNK_BITS = 8
SEGMENT_IDS = 1 << 18
RANK_BLOCK = 512
MEMO_PIECES = 250_000
MEMO_BYTES = 64
SPELT_WORDS = 4096
TEXT_BYTES = 4 << 20
_MAGIC = b"DAC1"
_ID = attrgetter("id")


class DirectCodes:
    """Integers in chunk levels with continuation bitmaps and rank directories."""

    def __init__(self, n: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.n, self.levels = n, levels

    @classmethod
    def build(cls, ids: np.ndarray) -> DirectCodes:
        levels, rest = [], ids.astype(np.uint32 if ids.dtype.itemsize <= 4 else np.uint64)
        while True:
            chunk = (rest & rest.dtype.type(2**CHUNK_BITS - 1)).astype(np.uint8)
            rest = rest >> rest.dtype.type(CHUNK_BITS)
            more = rest > 0
            bits = np.packbits(more, bitorder="little")
            blocks = -(-len(more) // RANK_BLOCK)
            words = np.zeros(blocks * (RANK_BLOCK // 64) * 8, np.uint8)
            words[:len(bits)] = bits
            words = words.view("<u8")
            per_block = np.bitwise_count(words).reshape(blocks, RANK_BLOCK // 64).sum(axis=1, dtype=np.uint32)
            ranks = (np.cumsum(per_block, dtype=np.uint32) - per_block).astype("<u4")
            levels.append((chunk, words, ranks))
            if not more.any():
                return cls(len(ids), levels)
            rest = rest[more]

    def to_bytes(self) -> bytes:
        parts = [_MAGIC, struct.pack("<QI", self.n, len(self.levels))]
        for chunk, words, ranks in self.levels:
            parts += [struct.pack("<QQQ", len(chunk), len(words), len(ranks)), chunk.tobytes(), words.tobytes(), ranks.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> DirectCodes:
        if data[:4] != _MAGIC:
            raise ValueError("not a code image")
        n, n_levels = struct.unpack_from("<QI", data, 4)
        at, levels = 16, []
        for _ in range(n_levels):
            c, w, r = struct.unpack_from("<QQQ", data, at)
            at += 24
            chunk = np.frombuffer(data, np.uint8, c, at)
            words = np.frombuffer(data, "<u8", w, at := at + c)
            ranks = np.frombuffer(data, "<u4", r, at := at + 8 * w)
            at += 4 * r
            levels.append((chunk, words, ranks))
        return cls(n, levels)

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, in any order."""
        out = np.zeros(len(places), np.uint64)
        live, at, shift = np.arange(len(places)), np.asarray(places, np.int64), 0
        for chunk, words, ranks in self.levels:
            out[live] |= chunk[at].astype(np.uint64) << np.uint64(shift)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            more = (words[word] >> bit) & np.uint64(1) == 1
            live, at, word, bit = live[more], at[more], word[more], bit[more]
            if not len(live):
                break
            block = at // RANK_BLOCK
            rank = ranks[block].astype(np.int64)
            counts = np.bitwise_count(words)
            before = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
            rank += before[word] - before[block * (RANK_BLOCK // 64)]
            rank += np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            at, shift = rank, shift + CHUNK_BITS
        return out

    def all(self) -> np.ndarray:
        """All ids in order, a level at a time."""
        out, at = np.zeros(self.n, np.uint64), np.arange(self.n)
        for k, (chunk, words, _) in enumerate(self.levels):
            out[at] |= chunk.astype(np.uint64) << np.uint64(CHUNK_BITS * k)
            at = at[np.unpackbits(words.view(np.uint8), count=len(chunk), bitorder="little").view(bool)]
        return out

    def get(self, place: int) -> int:
        """One id, touching one directory entry and at most 8 words per level."""
        value, at = 0, place
        for k, (chunk, words, ranks) in enumerate(self.levels):
            value |= int(chunk[at]) << (CHUNK_BITS * k)
            word, bit = at >> 6, at & 63
            if not int(words[word]) >> bit & 1:
                return value
            block = at // RANK_BLOCK
            first = block * (RANK_BLOCK // 64)
            at = (int(ranks[block]) + sum(int(w).bit_count() for w in words[first:word])
                  + (int(words[word]) & ((1 << bit) - 1)).bit_count())
        return value


# a lone space between two non-space characters always begins a piece of this tokenizer
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(f"[\\x20-\\x7e\\n{_LATIN}]*")
_MARK = "\x01"      # between units that are cut together; no unit of common characters holds it
_PLAIN_UNITS = re.compile(f"[\\x20-\\x7e\\n{_MARK}{_LATIN}]*")
# the published pattern of this tokenizer, its letter and number classes written out for _PLAIN texts; a mark ends a text
_PIECE = re.compile(rf" ?[{_LATIN}]+|{_MARK}|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{_MARK}{_LATIN}0-9]+|\s+(?![^\s{_MARK}])|\s+")


def _irregular(text: str) -> bool:
    """Whether a text has spaces that are not lone spaces between two non-space characters."""
    return ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "
            or _RARE_SPACE.search(text) is not None)


class Memo:
    """Ids of strings met lately: Arrow arrays of at most ``most`` short ones, and ``make`` for the rest.

    Strings met again come before those met once, so that the many that never come again push out
    only their like.
    """

    def __init__(self, most: int, make):
        self.most, self.make = most, make
        self.names, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def __call__(self, wanted: pa.Array) -> pa.Array:
        """Ids of strings; one that comes twice is made twice where it is not held."""
        at, n = pc.index_in(wanted, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64), len(self.names)
        met, new = at[at >= 0], np.flatnonzero(at < 0)
        if not len(new):
            return self.ids.take(pa.array(at))
        at[new] = n + np.arange(len(new))
        fresh = wanted.take(pa.array(new))
        names, ids = pa.concat_arrays([self.names, fresh]), pa.concat_arrays([self.ids, self.make(fresh)])
        found = ids.take(pa.array(at))
        others = np.ones(n, bool)
        others[met] = False
        others, short = np.flatnonzero(others), n + np.flatnonzero(pc.binary_length(fresh).to_numpy() <= MEMO_BYTES)
        stay = np.concatenate((met, others[:max(0, self.most - len(met) - len(short))], short))[:self.most]
        self.names, self.ids = names.take(pa.array(stay)), ids.take(pa.array(stay))
        return found


class Encoder:
    """The tokenizer with bounded memos of units and of the pre-tokenizer's pieces.

    The pre-tokenizer never joins text across a single space that stands between two non-space
    characters, so a text is cut there. A batch's units are told apart in Arrow; those not met
    lately are cut into the pre-tokenizer's pieces, all in one go, and these are told apart in
    turn. A piece not met lately goes straight to the tokenizer's model, in the letters that its
    pre-tokenizer gives for bytes. Units with other than common characters stay whole and go to the
    tokenizer, as do texts with a special-token marker.
    """

    def __init__(self, path: str, most: int = MEMO_PIECES):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.units, self.pieces = Memo(most, self._encode_units), Memo(most, self._encode_pieces)
        self.model = self.letters = None
        if self.tokenizer.normalizer is None and isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel):
            self.model, self.letters = self.tokenizer.model, _letters(pre_tokenizers)
            if hasattr(self.model, "_resize_cache"):
                self.model._resize_cache(0)     # the memos know what comes again

    def _encode(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in done]

    def _encode_pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of texts that are one piece each."""
        pieces = pc.if_else(pc.equal(pieces, _MARK), pa.scalar("", pa.large_string()), pieces)    # a mark is no piece
        if self.model is None:
            return pa.array(self._encode(pieces.to_pylist()), pa.large_binary())
        # a mark's own letter stands for nothing else, so all are spelt in one go
        words = _joined(pieces).encode().decode("latin-1").translate(self.letters).split(self.letters[ord(_MARK)])
        sizes, ids = [], []
        for k in range(0, len(words), SPELT_WORDS):
            done = list(map(self.model.tokenize, words[k:k + SPELT_WORDS]))
            sizes += map(len, done)
            ids.append(array("I", map(_ID, chain.from_iterable(done))).tobytes())
        return _binaries(4 * np.cumsum(sizes), b"".join(ids))

    def _encode_units(self, units: pa.Array) -> pa.Array:
        """Ids of units that begin as a text does or with their space."""
        at, text = [np.arange(len(units))], _joined(units)
        groups = []
        if text.count(_MARK) != len(units) - 1 or not _PLAIN_UNITS.fullmatch(text):
            names = units.to_pylist()
            plain = np.fromiter((_PLAIN.fullmatch(u) is not None for u in names), bool, len(names))
            at = [np.flatnonzero(~plain), np.flatnonzero(plain)]
            groups.append(pa.array(self._encode([names[k] for k in at[0].tolist()]), pa.large_binary()))
            text = _MARK.join([names[k] for k in at[1].tolist()])
        if len(at[-1]):
            pieces = pa.array(_PIECE.findall(text), pa.large_string()).dictionary_encode()
            distinct = pieces.dictionary
            ends, data = _parts(self.pieces(distinct).take(pieces.indices))
            marks = np.flatnonzero(pieces.indices.to_numpy() == pc.index(distinct, _MARK).as_py())
            groups.append(_binaries(np.concatenate((ends[marks], ends[-1:])), data))
        done = pa.concat_arrays(groups)
        return done if len(at) == 1 else done.take(pa.array(np.argsort(np.concatenate(at))))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers in the machine's order (little-endian here)."""
        out: list[bytes | None] = [None] * len(texts)
        whole = [k for k, t in enumerate(texts) if "<|" in t]
        for k, ids in zip(whole, self._encode([texts[k] for k in whole]) if whole else []):
            out[k] = ids
        plain, odd = [], []
        for k, t in enumerate(texts):
            if "<|" not in t:
                (odd if _irregular(t) else plain).append(k)
        for some, split in ((plain, lambda own: pc.split_pattern(pa.array(own, pa.large_string()), " ")),
                            (odd, lambda own: pa.array([_CUT.split(t) for t in own], pa.large_list(pa.large_string())))):
            for k, ids in zip(some, self._of_units(split([texts[k] for k in some])) if some else []):
                out[k] = ids
        return out

    def _of_units(self, units: pa.Array) -> list[bytes]:
        """Ids of texts given as lists of units, of which none is empty."""
        sizes, values = pc.list_value_length(units).to_numpy(), units.flatten()
        upto, n = np.cumsum(sizes), len(values)
        firsts = values.take(pa.array(upto - sizes)).dictionary_encode()
        later = np.ones(n, bool)
        later[upto - sizes] = False
        others = values.filter(pa.array(later)).dictionary_encode()
        del units, values       # from here on the distinct ones and their places will do
        at = np.empty(n, np.int32)
        at[~later], at[later] = firsts.indices.to_numpy(), others.indices.to_numpy() + len(firsts.dictionary)
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), others.dictionary, pa.scalar(" ", pa.large_string()))
        ends, data = _parts(self.units(pa.concat_arrays([firsts.dictionary, spaced])).take(pa.array(at)))
        bounds = [0, *ends[upto].tolist()]
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def _joined(strings: pa.Array) -> str:
    """All strings as one, a mark between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings), pa.scalar(_MARK, pa.large_string()))[0].as_py()


def _binaries(ends: np.ndarray, data: bytes) -> pa.Array:
    """The large binary array whose strings end there."""
    offsets = np.concatenate(([0], ends)).astype("<i8")
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _parts(strings: pa.Array) -> tuple[np.ndarray, bytes]:
    """Where the strings of a large binary array begin and end, and all of them as one."""
    _, offsets, data = strings.buffers()
    return (np.frombuffer(offsets, "<i8", len(strings) + 1) if len(strings) else np.zeros(1, "<i8")), data.to_pybytes() if data is not None else b""


def _letters(pre_tokenizers) -> dict[int, str]:
    """The letter that a byte-level pre-tokenizer gives for each byte that UTF-8 uses."""
    text = "".join(map(chr, [*range(0x800), *range(0x800, 0xD800, 0x800), *range(0xE000, 0x10000, 0x1000), *range(0x10000, 0x110000, 0x10000)]))
    spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)
    return dict(zip(text.encode(), "".join(w for w, _ in spelt)))


_ENCODERS: dict[str, Encoder] = worker_cache("token_codes")


def encoder_for(path: str) -> Encoder:
    """One encoder per tokenizer file and worker process; its memos serve all tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
        give_back()     # reading the file takes several times what the tokenizer keeps
    return _ENCODERS[path]


SEGMENT = ("part int, segment int, part_start long, n_ids long, doc_ids array<long>, n_tokens array<long>, codes binary")


def write_codes(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                segment_ids: int = SEGMENT_IDS, end_id: int = END_ID) -> DataFrame:
    """Encode every document in ascending id order; returns the stored segments."""
    prepare(docs.sparkSession)

    def encode(batches):
        from pyspark import TaskContext
        path = tokenizer_path
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path(TOKENIZER)
        encoder, part = encoder_for(path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        segment, start, held, ids, counts = 0, 0, 0, [], []
        names = [c.split()[0] for c in SEGMENT.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        doc_ids: list[int] = []

        def image():
            codes = DirectCodes.build(np.frombuffer(b"".join(ids), "<u4")).to_bytes()
            row = (part, segment, start, held, doc_ids, counts, codes)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

        # the encoder meets a unit once in all texts at hand: more of them than the JVM sends at once
        for some, texts in gathered(batches, TEXT_BYTES):
            for doc_id, own in zip(some, encoder([t or "" for t in texts])):
                ids.append(own + end)
                doc_ids.append(doc_id)
                counts.append(len(own) // 4 + 1)
                held += counts[-1]
                if held >= segment_ids:
                    yield image()
                    segment, start, held, ids, counts, doc_ids = segment + 1, start + held, 0, [], [], []
        if doc_ids:
            yield image()

    ordered = (id_text(docs, id_col, text_col).repartitionByRange("doc_id", F.substring("text", 1, 32))
               .sortWithinPartitions("doc_id", "text"))
    return cut(ordered.mapInArrow(lean(encode, "token_codes"), SEGMENT), "token-codes")


TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def read_codes(segments: DataFrame, with_ids: bool = True) -> DataFrame:
    """Per document: start (ids of all documents before it), n_tokens, crc32 of its ids, the ids."""
    prepare(segments.sparkSession)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("total"))
    # one row per partition of the write: bounded by the number of partitions, not by the data
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select(F.col("part").alias("b_part"), F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("begin"))
    placed = (segments.join(F.broadcast(begins), F.col("part") == F.col("b_part"))
              .select((F.col("begin") + F.col("part_start")).alias("start"), "doc_ids", "n_tokens", "codes"))

    def decode(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                codes = DirectCodes.from_bytes(row["codes"])
                counts = np.array(row["n_tokens"], np.int64)
                ends = np.cumsum(counts)
                ids = codes.all().astype("<u4")
                own = [ids[e - n:e].tobytes() for e, n in zip(ends.tolist(), counts.tolist())]
                out = (row["doc_ids"], (row["start"] + ends - counts).tolist(), row["n_tokens"],
                       [zlib.crc32(b) for b in own], own if with_ids else [None] * len(own))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                                 names=[c.split()[0] for c in TOKENS.split(", ")])

    out = placed.mapInArrow(lean(decode), TOKENS)
    return out.select(shown_id(), *out.columns[1:])
