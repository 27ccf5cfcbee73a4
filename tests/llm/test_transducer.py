"""The encoder runs the determinised transducer, and its memory follows the open hypotheses, not the piece."""

import tracemalloc

import public_tokenizers
import pytest
import tiktoken

from lumenkiln.llm import byte_bpe
from lumenkiln.llm.byte_bpe import Encoder, Transducer, read_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _unpacked(data: bytes) -> list[int]:
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def test_encode_meets_transitions_and_restarts_their_tables(monkeypatch, ranks, library):
    text = " ".join(f"quorvendish{i}zan naïve 東京都庁 {'xyzzy' * (i % 7)}" for i in range(200))
    for most in (1, 7, 60_000):
        monkeypatch.setattr(byte_bpe, "MAX_TRANSITIONS", most)
        ours = Encoder(ranks, public_tokenizers.PATTERN)
        assert _unpacked(ours.encode([text])[0]) == library.encode_ordinary(text)
        assert ours.transducer._transitions <= most and (most < 100 or ours.transducer._transitions > 0)
        assert len(ours.transducer._shared) <= most + 2


def test_memory_does_not_follow_the_piece(ranks, library):
    piece = "abcdefghijklmnopqrstu" * 20_000
    ours = Transducer(ranks)
    ours.packed(piece[:2000].encode())
    tracemalloc.start()
    ids = ours.packed(piece.encode())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert _unpacked(ids[:4000]) == library.encode_ordinary(piece[:8000])[:1000]
    # the text and the packed ids, twice while they are handed out and grow
    assert peak < len(piece) + 3 * len(ids)
    longest = max(map(len, ranks))
    assert max(len(held) for _, _, held, _ in ours._shared.values()) <= byte_bpe.HELD + longest
