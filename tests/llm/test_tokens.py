"""SentencePiece, bit planes and chat formatting."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm import bitplane, byte_bpe, chat_format, piece_bpe, registry

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "\n\n x", "a\n", "▁▁ b", "日本語 text 🎉\x00z", " " * 40 + "q", "\t\ttab\r\nx", "<s></s><0x0A>", "é" * 200, "aaaa" * 3000, "x²³½ \x1c\x85y's", "long " * 20_000]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_bpe.PieceBpe(PIECES)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_pieces_are_the_library_s(text):
    own = piece_bpe.loaded(PIECES)
    assert own.encode(text) == own.library.encode(text) + [2]
    assert own.mismatches == 0


def test_rows_and_agendas_agree(pieces):
    library, own = pieces
    rng = random.Random(4)
    words = [" " * rng.randint(0, 3) + "".join(rng.choice("thernodaig.éß,") for _ in range(rng.randint(1, 20))) for _ in range(2000)]
    assert own.merge_rows(words) == [tuple(own.merge(w)) for w in words]
    for text in ODD:
        assert own.encode(text) == library.encode(text) + [2]


def test_piece_digests(spark, pieces):
    library, _ = pieces
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None])] + [(0, "", "again"), (None, "null id", "x")]
    got = piece_bpe.digest_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PIECES).collect()
    want = []
    for key, text, _ in rows:
        ids = (library.encode(text) if text else []) + [2]
        want.append((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    back = piece_bpe.decode_documents(piece_bpe.encode_documents(docs, PIECES), PIECES).collect()
    assert {r.doc_id: r.text for r in back}[2] == library.decode(library.encode("  a"))
    assert piece_bpe.digest_documents(docs.limit(0), PIECES).count() == 0


def test_the_agenda_is_right_without_the_library_s_check(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = piece_bpe.digest_documents(docs, PIECES, surface=True)
    assert got.columns[-1] == "mismatches" and got.agg({"mismatches": "sum"}).first()[0] == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bytes_are_the_library_s(text):
    own = byte_bpe.loaded(BYTES)
    assert own.encode(text) == own.library.encode(text, add_special_tokens=False).ids
    assert "<|" in text or own.decode(own.encode(text)) == text


@pytest.mark.parametrize("kind", [bitplane.BIT, bitplane.BYTE])
@pytest.mark.parametrize("ids", [[0], [0, 0, 0], [50256, 1, 2**32 - 1], list(range(40_000))])
def test_frames_round_trip(kind, ids):
    frame = bitplane.pack(np.array(ids, np.uint32), kind, 1000)
    assert bitplane.unpack(frame).tolist() == ids
    with pytest.raises(ValueError):
        bitplane.unpack(b"xxxx" + frame[4:])


def test_files_hold_ascending_documents(spark, monkeypatch):
    monkeypatch.setattr(bitplane, "CHUNK_IDS", 500)
    library = Tokenizer.from_file(BYTES)
    rows = [(i * 3, t, "x") for i, t in enumerate([*ODD[:-1], None, "a<|endoftext|>b", *["some words here"] * 300])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in bitplane.round_trip(df, BYTES).collect()}
    start = 0
    for key, text, _ in sorted(rows, key=lambda r: r[0]):
        ids = (library.encode(text, add_special_tokens=False).ids if text else []) + [0]
        assert got[key] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert bitplane.round_trip(df.limit(0), BYTES).count() == 0
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n"), (1, "a")], "doc_id long, text string")
    assert sorted(r.start for r in bitplane.round_trip(twice, BYTES).collect()) == [0, 2, 4, 6]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"ab#\\</turn>| \n", "###", "</turn>", "<|"]), max_size=30).map("".join))
def test_escapes_are_reversible_and_hide_control_strings(text):
    hidden = chat_format.escape(text)
    assert chat_format.unescape(hidden) == text
    assert not any(c in hidden.replace("\\\\", "~~").replace("\\" + c, "~") for c in chat_format.CONTROL)


def test_conversations_read_back(spark):
    probe = registry.PROBE
    rows = [(1, 0, "user", "hi ### you"), (1, 1, "assistant", "one\\"), (1, 2, "odd ### role", "x"), (1, 3, "assistant", ""), (1, 4, "assistant", "two </turn> é🎉"), (2, 1, None, None), (-7, 0, "user", probe), (-7, 1, "assistant", probe), (None, 0, "assistant", "n"), (3, None, "assistant", "tie b"), (3, None, "assistant", "tie a"), (3, 5, "system", "end"), (3, 5, "system", "end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_conversations(df, BYTES).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=order)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.format_conversations(df.limit(0), BYTES).count() == 0
    masks = chat_format.assemble(df, BYTES).filter("role = 'user'").collect()
    assert all(r.loss_from == r.loss_to for r in masks)
    first = byte_bpe.loaded(BYTES).size
    for r in chat_format.assemble(df, BYTES).collect():
        assert sum(i >= first for i in r.ids) == (2 if r.role in chat_format.ROLES else 3)
