import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewire.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, World! it's 42", "", None, "naïve ÉCOLE Σας ΑΣ", "<|endoftext|> a<|startoftext|>b", "x" * 3000, "a\x0bb\xa0c\x85d", "日本語 テキスト", "don't we'LL 'S", "same", "same"]


def _ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aB'sé,.1 \n\tÀ<|>", max_size=60))
def test_parts_give_the_ids_of_the_text(text):
    encoder = packing.encoder_of(PATH)
    got = np.frombuffer(encoder.texts([text])[0], dtype=np.uint16).tolist()
    assert got == encoder.parts.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30) | st.text(alphabet="aB'sé,.1 \n\tÀ<|>İ\xad\x1c", max_size=30), max_size=8))
def test_texts_of_a_run_keep_their_ids(texts):
    encoder = packing.encoder_of(PATH)
    got = [np.frombuffer(x, dtype=np.uint16).tolist() for x in encoder.texts(texts)]
    assert got == [encoder.parts.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_plain_letters_and_signs_give_the_ids_of_the_text():
    encoder = packing.TextEncoder(PATH)
    chars = [chr(c) for c in range(0x250) if chr(c) not in "\n\r"]
    texts = [form for c in chars for form in (c, f"a{c}b", f"'{c}'S", f"{c}{c}1", f"É{c}, x")]
    got = [np.frombuffer(x, dtype=np.uint16).tolist() for x in encoder.texts(texts)]
    assert got == [encoder.parts.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_are_merged_once_for_all_parts_that_hold_them(monkeypatch):
    merged = []
    found = packing.Parts.ids
    monkeypatch.setattr(packing.Parts, "ids", lambda self, unit: (merged.append(unit), found(self, unit))[1])
    packing.TextEncoder(PATH).texts(["House house, (HOUSE) house", "house's houSe, HOUSE."])
    assert len(merged) == len(set(merged)) and merged.count("house") == 1
    assert not [x for x in merged if "house" in x.lower() and x != "house"]


def test_kept_units_are_bounded_within_a_run(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_PARTS", 10)
    encoder = packing.TextEncoder(PATH)
    words = ["w" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(200)]
    assert encoder.texts([" ".join(words)]) == packing.TextEncoder(PATH).texts([" ".join(words)])
    assert len(encoder.parts) <= 12 and len(encoder.parts.old) <= 12


def test_old_parts_are_kept_a_while(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_PARTS", 3)
    encoder = packing.TextEncoder(PATH)
    texts = ["a b c d e f", "a g h", "i j k l a b"]
    assert encoder.texts(texts) == packing.TextEncoder(PATH).texts(texts)
    assert len(encoder.parts) < 12


def test_each_id_is_in_one_piece(spark, docs_of):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (3, TEXTS[3])]
    tokenizer = Tokenizer.from_file(PATH)
    pieces = packing.pack(docs_of(rows).repartition(3), PATH, length=64, with_ids=True)
    got = pieces.collect()
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got if r["start"] == 0) == sorted(k if k is not None else -1 for k, _ in rows)
    texts = {k: _ids(tokenizer, t) for k, t in rows}
    for r in got:
        mine = texts[r["doc_id"]]
        assert r["doc_tokens"] == len(mine) and r["ids"] == mine[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids"]))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    full = {r["sequence_id"]: r["ids"] for r in packing.sequences(pieces, 64, pad_id=0).collect()}
    for k, parts in by_sequence.items():
        parts.sort()
        assert [o for o, _, _ in parts] == [sum(n for _, n, _ in parts[:i]) for i in range(len(parts))]
        used = sum(n for _, n, _ in parts)
        assert used == 64 or k == len(by_sequence) - 1
        flat = [i for _, _, ids in parts for i in ids]
        assert full[k] == (flat if used.bit_count() == 1 else flat + [0] * (64 - used))


def test_documents_are_cut_in_runs_of_bounded_ids():
    assert packing.id_runs(np.array([], dtype=np.int64)) == []
    assert packing.id_runs(np.array([4, 5, 2, 30, 1, 1]), 10) == [(0, 2), (2, 3), (3, 4), (4, 6)]


def test_cutting_keeps_no_encoder():
    packing.encoder_of(PATH)
    packing.released()
    assert not packing._ENCODERS


def test_empty(spark, docs_of):
    assert packing.pack(docs_of([]), PATH).count() == 0
