"""Cutting by segments of the whole text, found once, against cutting without them."""

import random

import pytest
import regex

from textloom import CodeChunker, MarkdownChunker, TextChunker
from textloom.functions import segments
from textloom.functions.config import Capacity, ChunkConfig
from textloom.functions.segments import Segments
from textloom.functions.sizers import Bytes, Characters, Words
from textloom.operators import kernel

PARTS = ["word", "Ünïcödeſ", " ", "  ", "a.b", "it's", "x'", ".5", "1,000.5", "3;4", "1.b", "_a_1", "?", "! ", ". ", "etc. and", "End. Next", "\n", "\r\n", "\r", "\n\n", "\t", "\x0b", "\x1f", '"q"', "(a) ", ":", "a:b"]
ODD = ["́", "‍", "\U0001f1e9\U0001f1ea", "\U0001f469‍\U0001f467", "日本", "א\"ב", "ª", "\x85", "\xa0", "’"]


def texts(parts, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(n)]


def test_letters_of_simple_text_are_letters():
    kinds = segments._classes()
    assert all(regex.fullmatch(r"\p{WB=ALetter}", chr(i)) for i in range(1 << 16) if kinds[i] == segments._L)


@pytest.mark.parametrize("level", [segments.graphemes, segments.words, segments.sentences])
@pytest.mark.parametrize("parts", [PARTS, PARTS + ODD])
def test_segments_from_anywhere(level, parts):
    for text in texts(parts, 300, 1):
        whole = Segments(text)
        assert list(whole.ends(level)) == list(level(text, True))
        for at in range(len(text)):
            k = whole.index(level, at)
            if k is not None:
                first = next(segments.ends_from(text, at, level))
                assert [*whole.ends(level)[k:]] == [at + e for e in level(text[at:], True)] and first == whole.ends(level)[k]


class Unsegmented(Segments):
    def index(self, segmenter, at):
        return None


@pytest.mark.parametrize("sizer", [Characters(), Bytes(), Words()])
@pytest.mark.parametrize("kind", [TextChunker, MarkdownChunker])
def test_directly_as_step_by_step(monkeypatch, sizer, kind):
    rng = random.Random(2)
    parts = PARTS if kind is TextChunker else [p for p in PARTS if p not in (":", "\x0b", "\x1f", "\r")]
    for text in texts(parts, 250, 3) + texts(parts + ODD, 150, 4) + texts(["ab", "c", "d"], 30, 5):
        desired, more = rng.randint(0, 30), rng.choice([0, 0, 5, 40])
        overlap = rng.choice([0, 0, 1, 4, 12])
        config = ChunkConfig(Capacity(desired, max(desired + more, 1)), min(overlap, max(desired - 1, 0)), sizer, rng.random() < 0.6)
        got = list(kind.from_config(config).iterate(text))
        with monkeypatch.context() as m:
            m.setattr(kernel, "Segments", Unsegmented)
            m.setattr(kernel.Cutter, "directly", lambda self: None)
            assert list(kind.from_config(config).iterate(text)) == got


def test_long_text_is_segmented_once(monkeypatch):
    """Words were searched anew from each chunk's start on, and from capacity 0 on for each piece."""
    looked = []
    real = segments.words
    monkeypatch.setattr(segments, "ends_from", lambda *a, **o: looked.append(a[1]) or iter(()))
    monkeypatch.setattr(kernel, "ends_from", segments.ends_from)
    text = "some plain words " * 2000
    for capacity in (Capacity(0, 512), Capacity(64), Capacity(256, 512)):
        chunks = [c.chunk for c in TextChunker.from_config(ChunkConfig(capacity)).iterate(text)]
        assert "".join("".join(chunks).split()) == "".join(text.split())
    assert not looked and real is segments.words
