"""The pieces an encoder remembers: bounded, and those in use are not encoded anew."""

from __future__ import annotations

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marquee.llm import tokens, word_ids
from marquee.llm.queries import tokenizer_path


class Counted:
    """A tokenizer's model that keeps what it is asked for."""

    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, piece):
        self.asked.append(piece)
        if piece == "broken":
            raise ValueError(piece)
        return self.model.tokenize(piece)


def whole(texts):
    plain = Tokenizer.from_file(tokenizer_path())
    return [plain.encode(t, add_special_tokens=False).ids for t in texts]


def check(encoder, texts):
    ids, sizes = encoder.encode(pa.array(texts))
    expected = whole(texts)
    assert sizes.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_pieces_in_use_outlive_the_limit():
    encoder = word_ids.WordEncoder(tokenizer_path(), remember=20)
    encoder.model = Counted(encoder.model)
    common = "the cat isn't 4 dogs"
    check(encoder, [" ".join(f"w{'abcdefgh'[k % 8]}{'xyzu'[k // 8]}" for k in range(30)), common])
    check(encoder, [common, "Zebra"])  # over the limit: only the latest part's are kept
    check(encoder, [common, "zebra Éa", ""])
    check(encoder, ["dogs"])
    check(encoder, [common])
    assert len(encoder.model.asked) == len(set(encoder.model.asked))
    assert len(encoder.known) == len(encoder.sizes)
    for k in range(30):  # whatever comes, the limit and the latest part bound what is kept
        check(encoder, [f"{'abcdefgh'[k % 8]}{'ijklmn'[k % 6]} {'opqrstu'[k % 7]}{'vwxyz'[k % 5]} {common}"])
        assert len(encoder.known) <= 20 + 10


def test_an_error_leaves_no_piece_without_ids():
    encoder = word_ids.WordEncoder(tokenizer_path())
    encoder.model = Counted(encoder.model)
    with pytest.raises(ValueError):
        encoder.encode(pa.array(["some broken words"]))
    check(encoder, ["some words", "some more"])


def test_encoder_of_a_worker_is_bounded_as_any():
    assert tokens.word_encoder(tokenizer_path()).remember == word_ids.CACHE <= 400_000
