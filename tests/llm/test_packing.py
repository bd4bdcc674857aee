import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import llm_cases as C
from scoreflow.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abCD  \n\t.,!?'-<|>sStT019éÉßİΣς̱̇́%…\x1c\x85日")), max_size=40), max_size=8))
def test_words_give_the_ids_of_the_text(texts):
    texts = [*texts, "it's <|endoftext|> x<|startoftext|>, don't'LL 'S, a.b,c H̱."]
    got = packing.WordIds(PATH)([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids(t) for t in texts]


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    own = packing.WordIds(PATH)
    for seed in range(6):
        text = C.prose(seed, 30)
        assert np.frombuffer(own([text.encode()])[0], "<u4").tolist() == ids(text)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
def test_patterns_hold_every_piece_once(histogram):
    patterns = packing.packing_patterns(histogram, 64)
    held = {}
    for count, lengths in patterns:
        assert count > 0 and sum(lengths) <= 64
        for n in lengths:
            held[n] = held.get(n, 0) + count
    assert held == histogram


def check(rows, placed):
    want = {d: [*ids(t), 2] for d, t in rows}
    sequences, pieces = {}, {}
    for r in placed:
        own = want[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for parts, total in [(v, None) for v in sequences.values()] + [(v, len(want[d])) for d, v in pieces.items()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at <= packing.SIZE if total is None else at == total
    assert pieces.keys() == want.keys()
    assert sorted(sequences) == list(range(len(sequences)))
    return sum(map(len, want.values())) / len(sequences) / packing.SIZE


def test_round_trip(spark):
    rows = [(i, C.prose(i, 1 + (i * 37) % 900, 3000)) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, C.prose(1, 9000)), (1003, "x " * 4095), (1004, "x " * 4096)]
    fill = check(rows, packing.pack_documents(C.documents(spark, rows), PATH).collect())
    assert fill > 0.95


def test_one_length_for_most_rows_is_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 50)
    rows = [(i, "same text here") for i in range(2000)] + [(5000 + i, C.prose(i, 50)) for i in range(20)]
    placed = packing.pack_documents(C.documents(spark, rows), PATH)
    check(rows, placed.collect())


def test_repeated_rows_and_empty_table(spark):
    placed = packing.pack_documents(C.documents(spark, [(1, "a"), (1, "a")]), PATH).collect()
    assert sorted((r.start, r.length, r.offset) for r in placed) == [(0, 2, 0), (0, 2, 2)]
    assert packing.pack_documents(C.documents(spark, []), PATH).collect() == []
