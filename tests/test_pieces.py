"""Tokens counted by pieces against encoding each span."""

import pickle
import random

import pytest

from textloom import TextChunker
from textloom.functions import sizers
from textloom.functions.sizers import HuggingFace, Tiktoken

public_tokenizers = pytest.importorskip("public_tokenizers")
PARTS = ["word", "Über", "ſo", " ", "  ", "'s", " 's", "'", "it's", " 't", "don't ", "...", " (", ")", "1", "1,000.5", "\n", "\n\n", "\r\n", "\t", "\x0b", "\x1c", "_", " - ", "<|endoftext|>", '"', "?!"]


def made():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        yield HuggingFace(f.read())
    yield Tiktoken(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize("sizer", list(made()), ids=["huggingface", "tiktoken"])
def test_spans_have_the_tokens_that_encoding_gives(sizer):
    rng, told = random.Random(1), 0
    for _ in range(60):
        text = "".join(rng.choices(PARTS, k=rng.randint(1, 14)))
        pieces = sizer.pieces(text)
        if pieces is None:
            assert "<|endoftext|>" in text
            continue
        for start in range(len(text)):
            for end in range(start, len(text) + 1):
                n = pieces.tokens(start, end)
                assert n is None or n == sizer.size(text[start:end]), (text, start, end)
                told += n is not None
    assert told > 1000


@pytest.mark.parametrize("sizer", list(made()), ids=["huggingface", "tiktoken"])
def test_text_is_encoded_by_pieces_not_by_chunks(monkeypatch, sizer):
    """Before, every span tried was encoded: some ten times the text."""
    text = "Some plain words, and more of them; then the next sentence. " * 400
    encoded = []
    real = type(sizer).size
    monkeypatch.setattr(type(sizer), "size", lambda self, t: encoded.append(len(t)) or real(self, t))
    sizer = pickle.loads(pickle.dumps(sizer))
    monkeypatch.setattr(sizers, "_KNOWN", {})
    chunks = TextChunker(64, sizer=sizer).chunks(text)
    assert sum(encoded) < len(text) // 10
    monkeypatch.setattr(type(sizer), "pieces", lambda self, t: None)
    assert TextChunker(64, sizer=sizer).chunks(text) == chunks


def test_a_text_is_encoded_in_blocks_not_by_words(monkeypatch):
    """Before, each new word was encoded by a call of its own (F16)."""
    tiktoken = pytest.importorskip("tiktoken")
    text = " ".join(f"wo{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(6000))
    calls = []
    real = tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, t: calls.append(t) or real(self, t))
    sizer = Tiktoken(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    chunks = TextChunker(256, sizer=sizer).chunks(text)
    assert len(chunks) > 50 and len(calls) < 3000
    monkeypatch.setattr(Tiktoken, "pieces", lambda self, t: None)
    assert TextChunker(256, sizer=sizer).chunks(text) == chunks


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_blocks_and_white_space_do_not_change_tokens(monkeypatch, block):
    monkeypatch.setattr(sizers, "_BLOCK", block, raising=False)
    sizer = Tiktoken(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in ("  two  words \n\n Über\tſo  ", "\r\n 's  it's '' 'll x9 9x...a\n\n\n(b) ", "é" * 9 + "  " + "é1é'é", "   "):
        pieces, told = sizer.pieces(text), 0
        for start in range(len(text)):
            for end in range(start, len(text) + 1):
                n = pieces.tokens(start, end)
                assert n is None or n == sizer.size(text[start:end]), (text, start, end)
                told += n is not None
        assert told or not text.strip()


def test_simple_texts_have_the_same_sentences():
    """Found by one search a sentence (F12, F16)."""
    from textloom.functions import segments

    rng = random.Random(2)
    parts = list(".!?.!? \n\r\tabAÄß19,;:-()\"'") + [". ", "! ", "?\r\n", ".)", '." ']
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        assert segments.Segments(text).simple
        assert list(segments._plain_sentences(text)) == list(segments.sentences(text)), text
