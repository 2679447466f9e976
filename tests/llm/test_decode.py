"""Decoding of a text's own ids."""

import numpy as np
import public_tokenizers
import pytest

from tracemill.llm import bpe, queries

TEXTS = ["one two  three\n four", "", None, "ü" * 70 + " x" * 9, "The same words, the same words."]


@pytest.mark.parametrize("ids", [3, 1000])
def test_ids_decode_to_the_text(monkeypatch, ids):
    monkeypatch.setattr(bpe, "IDS", ids)
    encoder = bpe.Encoder(queries.VOCABULARY, public_tokenizers.PATTERN)
    for (coded, decoded), text in zip(encoder.encode(TEXTS), TEXTS):
        assert decoded == (text or "").encode()
        bytes_of = {v: k for k, v in encoder.codec.ranks.items()}
        swapped = coded.split()[::-1]
        assert encoder.codec.decode([" ".join(swapped)]) == [b"".join(bytes_of[int(i)] for i in swapped)]
    rng = np.random.default_rng(1)
    some = [list(rng.integers(0, 256, n)) for n in (0, 5000, 1)]
    assert encoder.codec.decode([" ".join(map(str, s)) for s in some]) == [b"".join(bytes_of[i] for i in s) for s in some]
    with pytest.raises(ValueError):
        encoder.codec.decode(["0 65535000"])


def test_a_wrong_cached_piece_shows_in_the_decoded_text():
    encoder = bpe.Encoder(queries.VOCABULARY, public_tokenizers.PATTERN)
    encoder.encode(["see the cat"])
    right = encoder.codec.seen["cat"]
    encoder.codec.seen["cat"] = encoder.codec.seen["the"]
    try:
        assert encoder.encode(["see the cat"])[0][1] == b"see the the"
    finally:
        encoder.codec.seen["cat"] = right
