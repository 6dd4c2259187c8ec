import zlib

import numpy as np
import public_tokenizers
from awkward import doc_rows, documents, empty_documents, ident
from haulage.llm import token_codes
from haulage.llm.token_codes import DirectCodes, Encoder, read_codes, write_codes
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_rows_read_back_equal_the_tokenizer(spark):
    rows = doc_rows()
    segments = write_codes(documents(spark), segment_ids=500)
    got = sorted((ident(r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in read_codes(segments).collect())
    order = sorted(zip(rows, plain([r[1] or "" for r in rows])), key=lambda x: (ident(x[0][0]), x[0][1] or ""))
    want, start = [], 0
    for row, ids in order:
        own = np.array([*ids, 0], "<u4").tobytes()
        want.append((ident(row[0]), start, len(ids) + 1, zlib.crc32(own), own))
        start += len(ids) + 1
    assert got == sorted(want)
    assert segments.count() > 3


def test_empty_table(spark):
    assert read_codes(write_codes(empty_documents(spark))).count() == 0


def test_pieces_and_units_give_the_tokenizers_ids():
    encoder = Encoder(PATH, most=50)
    texts = [r[1] or "" for r in doc_rows()]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder(texts)] == plain(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder(texts[::-1])] == plain(texts[::-1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Straße", "don't", "'s", "''", " ", "  ", "\n", "\t", " \n", "1", "²", "½", "é", "́", "漢", "🎉",
                                 ".", "...", "###", "_", " ", "　", "\x1c", "'ll", "×", "ª", "<|endoftext|>", "<|"]), max_size=14).map("".join))
def test_any_text_gives_the_tokenizers_ids(text):
    assert np.frombuffer(ENCODER([text])[0], "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


ENCODER, TOKENIZER = Encoder(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40) | st.integers(0, 300), max_size=1500))
def test_codes_round_trip_and_random_access(values):
    ids = np.array(values, np.uint64)
    codes = DirectCodes.from_bytes(DirectCodes.build(ids).to_bytes())
    assert codes.take(np.arange(len(ids))).tolist() == values
    assert [codes.get(k) for k in range(0, len(values), 7)] == values[::7]


def test_pieces_of_plain_texts_need_no_run_of_the_whole_tokenizer():
    """New units cost a call to the model for each piece, not a pass of the tokenizer over their text."""
    encoder, text = Encoder(PATH), "Straße 1 don't\nstop, 22nd... of  May"
    encoder.tokenizer = None
    assert np.frombuffer(encoder([text])[0], "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**40) | st.integers(0, 300), max_size=1500))
def test_all_ids_in_order_equal_random_access(values):
    for ids in (np.array(values, np.uint64), np.array(values, np.uint64).astype("<u4")):
        assert DirectCodes.from_bytes(DirectCodes.build(ids).to_bytes()).all().tolist() == ids.tolist()


def test_units_met_lately_are_not_cut_again(monkeypatch):
    """A unit that the encoder holds costs neither a cut into pieces nor a call to the tokenizer or its model."""
    encoder, texts = Encoder(PATH), ["Straße 1 don't\nstop, 22nd... of  May", "stop, 漢 don't 1", ""]
    want = plain(texts + texts[::-1])
    first = encoder(texts)
    encoder.model = encoder.tokenizer = None
    monkeypatch.setattr(token_codes, "_PIECE", None)
    assert [np.frombuffer(b, "<u4").tolist() for b in first + encoder(texts[::-1])] == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "don't", " 's", "  b", "c\n", "漢", "...", "x" * 70, "y" * 65 + "!", "\x01", "1²"]),
                         max_size=12).map(" ".join), max_size=8))
def test_full_memos_give_the_tokenizers_ids_and_stay_bounded(texts):
    for k in (1, 3):
        got = [np.frombuffer(b, "<u4").tolist() for part in range(0, len(texts), k) for b in SMALL(texts[part:part + k])]
        assert got == plain(texts)
        for memo in (SMALL.units, SMALL.pieces):
            assert len(memo.names) == len(memo.ids) <= 5
            assert all(len(n.encode()) <= token_codes.MEMO_BYTES for n in memo.names.to_pylist())


SMALL = Encoder(PATH, most=5)
