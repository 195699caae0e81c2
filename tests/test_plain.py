"""The kernel against the rules written out plainly."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests import plain
from textloom import MarkdownChunker, TextChunker
from textloom.functions.sizers import Bytes, Characters, Words

PROSE = ["word ", "Some ", "1.5 ", "end. ", "end.\n", "Why? ", "é", "ö̲", "\U0001f469‍\U0001f467", "\n", "\n\n", "\r\n", "\n\n\n", " ", "\t", "(a b) ", "can't ", "日本", "longerwordthanmost "]
MARKS = ["# Head\n", "## Sub\n\n", "- item\n", "  - inner\n", "1. one\n", "> quote ", "**bold** ", "`code` ", "```\ncode\n```\n", "---\n", "[a](b) ", "| a | b |\n|---|---|\n| c | d |\n", "    indented\n", "$x$ ", "Term\n: meaning\n"]
SIZERS = {"characters": (Characters(), len), "bytes": (Bytes(), lambda t: len(t.encode())), "words": (Words(), lambda t: len(t.split()))}


@pytest.mark.parametrize("sizer", SIZERS)
@pytest.mark.parametrize("kind", [TextChunker, MarkdownChunker])
@settings(max_examples=150, deadline=None)
@given(st.data())
def test_kernel_follows_the_rules(kind, sizer, data):
    parts = PROSE if kind is TextChunker else PROSE + MARKS
    text = "".join(data.draw(st.lists(st.sampled_from(parts), max_size=40)))
    desired, more = data.draw(st.integers(1, 40)), data.draw(st.sampled_from([0, 0, 3, 20]))
    overlap, trim = data.draw(st.sampled_from([0, 0, 1, 5, 20])), data.draw(st.booleans())
    own, measure = SIZERS[sizer]
    overlap = min(overlap, desired - 1)
    chunker = kind((desired, desired + more), overlap=overlap, trim=trim, sizer=own)
    want = plain.chunks(text, chunker.plan, desired, desired + more, measure, overlap, trim)
    assert chunker.chunk_indices(text) == want


@pytest.mark.parametrize("capacity", [16, 100, 512])
def test_kernel_follows_the_rules_on_longer_text(capacity):
    text = "".join(PROSE[(i * i + i // 7) % len(PROSE)] for i in range(700))
    for kind in (TextChunker, MarkdownChunker):
        chunker = kind(capacity)
        assert chunker.chunk_indices(text) == plain.chunks(text, chunker.plan, capacity, capacity, len)
