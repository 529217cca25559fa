"""The piece encoder against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from palimpsest.llm import pieces

from . import plain

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts_of_all_kinds(n, seed=1):
    rng = random.Random(seed)
    alphabets = ["abcdefgh ", "  ab", "etaoinshr ", "\u2581 a", "0123456789abcdef", "日本語テスト text é😀", "\n\t .,;:-_()[]{}xyz ", "inger theon "]
    yield from ["a\x00b", "\u2581a", "a \u2581 b", " a", "  a  b ", "\n\n x", "<s> a </s> <unk> <0x0A>", "ﬀ é é", " ", "   ", "     x", "hello   world    foo", "\t" * 50, "\U0010ffff \ufffd"]
    for _ in range(n):
        letters = rng.choice(alphabets)
        yield "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))


def same_as_library(model, library, text):
    ids = model.encode(text)
    assert ids == [1, *library.encode(text), 2]
    assert model.decode(ids) == library.decode(ids)


def test_encoding(library):
    model = pieces.Pieces(MODEL)
    for t in [*plain.ODD_TEXTS, *texts_of_all_kinds(1500), "ha" * 5_000, "the" * 5_000, "日本語のテキスト" * 500]:
        same_as_library(model, library, t or "")


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_stretches_that_a_queue_finishes(library, rounds, monkeypatch):
    monkeypatch.setattr(pieces, "ROUNDS", rounds)
    model = pieces.Pieces(MODEL)
    for t in texts_of_all_kinds(300, rounds):
        same_as_library(model, library, t)


def test_rounds_alone_are_enough_for_words(library, monkeypatch):
    """A stretch of up to 256 characters has as many merges at most: the queue is only asked for longer ones."""
    model = pieces.Pieces(MODEL)
    monkeypatch.setattr(model, "_queued", None)
    rng = random.Random(3)
    for t in ["x" * 20_000, " " * 250 + "x", *("".join(rng.choice("etaoinshrdlcu") for _ in range(256)) for _ in range(50)), *texts_of_all_kinds(200)]:
        same_as_library(model, library, t)


def test_decoding_of_any_ids(library):
    model = pieces.Pieces(MODEL)
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 40):
        for _ in range(100):
            ids = [int(i) for i in rng.integers(0, 320 if n < 5 else 32_000, n)]
            if 0 not in ids:
                assert model.decode(ids) == library.decode(ids), ids


def test_other_models_are_refused(tmp_path):
    with open(MODEL, "rb") as f:
        data = f.read()
    rule = b"\x0a\x08identity\x12\x00\x18\x01\x20"  # what follows says whether white space is removed
    at = data.rindex(rule) + len(rule)
    (tmp_path / "m").write_bytes(data[:at] + b"\x01" + data[at + 1 :])
    with pytest.raises(ValueError):
        pieces.Pieces(str(tmp_path / "m"))


def test_tables(spark, small, odd, empty, library):
    for docs in (small, odd):
        want = sorted((str(r.doc_id), len(ids := [1, *library.encode(r.text or ""), 2]), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()) for r in docs.collect())
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.piece_digest(docs, MODEL).collect()) == want
        whole = [(str(r.doc_id), len(r.ids), hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in pieces.piece_ids(docs, MODEL).collect()]
        assert sorted(whole) == want
    assert pieces.piece_digest(empty, MODEL).collect() == []
    dotted = small.withColumnRenamed("doc_id", "a.b").withColumnRenamed("text", "t`x.y")
    assert pieces.piece_digest(dotted, MODEL, "a.b", "t`x.y").columns[0] == "a.b"
