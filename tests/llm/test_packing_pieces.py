import random

import numpy as np
import public_tokenizers
import pytest

from quillon.llm import packing

PARTS = ["word", "Next", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u3000", "it's", "'ll", "x'", "12", "½", "é", "e\u0301", "中文", "。", "...", "!", "😀", "'", "ﬁ", "_", "\u0378"]


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path(packing.BYTE_BPE), "rb") as f:
        return packing._encoding(f.read())


def test_pieces_change_no_ids(encoding, monkeypatch):
    """Random text with all kinds of white space, cut everywhere it may be cut."""
    rng = random.Random(8)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60)))
        monkeypatch.setattr(packing, "CALL_CHARS", rng.randint(1, 25))
        assert packing.token_ids(encoding, text).tolist() == [*encoding.encode_ordinary(text), packing.SEPARATOR]
        assert "".join(packing.pieces(text, packing.CALL_CHARS)) == text


@pytest.mark.parametrize("text", ["a word.\n\nNext para " * 70_000, "one line of words, no ends " * 60_000, "word\n\n\n" * 200_000])
def test_very_long_texts(encoding, text):
    assert len(text) > packing.CALL_CHARS
    whole = encoding.encode_ordinary(text)
    assert packing.token_ids(encoding, text).tolist() == [*whole, packing.SEPARATOR]
    assert all(len(p) < packing.CALL_CHARS + 100 for p in packing.pieces(text, packing.CALL_CHARS))


def test_lossless(encoding):
    text = "a word.\n\nNext para " * 70_000
    assert encoding.decode(np.asarray(packing.token_ids(encoding, text)[:-1], int).tolist()) == text
