"""What piece encoding remembers, and that cuts between kinds of characters change no ids."""

import random

from sentencepiece import SentencePieceProcessor

from axonframe.llm import pieces


def test_words_are_cut_between_kinds_of_characters():
    model = pieces.read_model()
    sp, coder = SentencePieceProcessor(model_file=pieces.MODEL), pieces.coder_of(model)
    coder.encode("stone, stone. stone$$$ stone; stone")
    assert [w for w in coder.known if "stone" in w] == ["▁stone"]
    assert pieces.coder_of(model) is coder is not pieces.coder_of(pieces.read_model())
    rng = random.Random(5)
    for _ in range(300):
        s = "".join(rng.choice(["the", "ou", "é", "Ñ", "x", " ", " ", ".", "$$", "_", "7", "42", "\n", "-", "日", "'s"]) for _ in range(60))
        assert list(coder.encode(s)) == sp.encode(s) and coder.decode(coder.encode(s)) == s


def test_a_full_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    sp, coder = SentencePieceProcessor(model_file=pieces.MODEL), pieces.PieceCoder(pieces.read_model())
    for s in ("the quick brown foxes were jumping over lazier dogs", "unbelievable interoperability of miscellaneous quantities", "the quick brown foxes were jumping again"):
        assert list(coder.encode(s)) == sp.encode(s)
