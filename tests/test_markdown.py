import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom import MarkdownChunker
from textloom.plans.markdown import BLOCK, INLINE, RULE, SOFT_BREAK, MarkdownPlan, heading
from textloom.plans.ranges import Ranges

B, I, S, R = BLOCK, INLINE, SOFT_BREAK, RULE

#: Ranges (level, start, end), derived by hand: a block, then what is inline in it.
CASES = [
    ("Plain words", [(B, 0, 11), (I, 0, 11)]),
    ("* [x] done\n* [ ] to do", [(B, 0, 22), (B, 0, 11), (I, 2, 5), (I, 6, 10), (B, 11, 22), (I, 13, 16), (I, 17, 22)]),
    ("See there[^note]", [(B, 0, 16), (I, 0, 9), (I, 9, 16)]),
    ("run `ls` now", [(B, 0, 12), (I, 0, 4), (I, 4, 8), (I, 8, 12)]),
    ("__very__", [(B, 0, 8), (I, 0, 8), (I, 2, 6)]),
    ("![a cat](c.png)", [(B, 0, 15), (I, 0, 15), (I, 2, 7)]),
    ("<b>bold</b>", [(B, 0, 11), (I, 0, 3), (I, 3, 7), (I, 7, 11)]),
    ("<p>in a block</p>", [(B, 0, 17), (B, 0, 17)]),
    ("first\nsecond", [(B, 0, 12), (I, 0, 5), (S, 5, 6), (I, 6, 12)]),
    ("first  \nsecond", [(B, 0, 14), (I, 0, 5), (I, 5, 8), (I, 8, 14)]),
    ("~~~\nlet x\n~~~", [(B, 0, 13), (I, 4, 10)]),
    (">  said", [(B, 0, 7), (B, 3, 7), (I, 3, 7)]),
    ("up\n\n***\n\ndown", [(B, 0, 3), (I, 0, 2), (R, 4, 8), (B, 9, 13), (I, 9, 13)]),
    ("## Part two", [(heading(2), 0, 11), (I, 3, 11)]),
    ("Part\n---\n", [(heading(2), 0, 9), (I, 0, 4)]),
    ("x --- y", [(B, 0, 7), (I, 0, 2), (I, 2, 5), (I, 5, 7)]),
    ("[ref]: /to\n\n[ref]", [(B, 12, 17), (I, 12, 17), (I, 13, 16)]),
    ("    one\n    two", [(B, 4, 15), (I, 4, 8), (I, 12, 15)]),
    ("", []),
    # math: inline, and on its own
    ("area $a^2$ here", [(B, 0, 15), (I, 0, 5), (I, 5, 10), (I, 10, 15)]),
    ("$$ x = 1 $$", [(B, 0, 11), (B, 0, 11)]),
    ("$5 and 6 $", [(B, 0, 10), (I, 0, 1), (I, 1, 9), (I, 9, 10)]),
    # wiki links
    ("to [[Home]] go", [(B, 0, 14), (I, 0, 3), (I, 3, 11), (I, 5, 9), (I, 11, 14)]),
    ("[[Home|my home]]", [(B, 0, 16), (I, 0, 16), (I, 7, 14)]),
    # an alert's tag is no text
    ("> [!TIP]\n> Rest.", [(B, 0, 16), (B, 11, 16), (I, 11, 16)]),
    # a definition list: its term, its definitions
    ("Tea\n: a drink\n: a meal\n", [(B, 0, 23), (B, 0, 4), (I, 0, 3), (B, 4, 14), (I, 6, 13), (B, 14, 23), (I, 16, 22)]),
    ("Tea\n\n: a drink\n\nafter", [(B, 0, 15), (B, 0, 4), (I, 0, 3), (B, 5, 15), (B, 7, 15), (I, 7, 14), (B, 16, 21), (I, 16, 21)]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_ranges(text, want):
    assert Ranges(MarkdownPlan().parse(text)).all == want


def test_table():
    found = Ranges(MarkdownPlan().parse("| x | yy |\n|---|----|\n| 1 | 22 |")).all
    assert found[0] == (B, 0, 32) and [r for r in found if r[0] == B][1:] == [(B, 0, 11), (B, 22, 32)]


def test_headings_start_chunks():
    text = "# One\n\nFirst part.\n\n# Two\n\nSecond part.\n"
    assert MarkdownChunker(30, trim=False).chunks(text) == ["# One\n\nFirst part.\n\n", "# Two\n\nSecond part.\n"]


def test_indentation_is_kept():
    """Where a chunk has several lines; one line is trimmed."""
    text = "- aaaa aaaa\n  - bb bb\n  - cc cc\n- dd\n  - ee\n"
    assert MarkdownChunker(24).chunks(text) == ["- aaaa aaaa", "  - bb bb\n  - cc cc", "- dd\n  - ee"]
    assert MarkdownChunker(12).chunks(text)[1] == "- bb bb"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab#*_`~-+>|[]()!<>:\\&;. \n\t1=\"'^$", max_size=120))
def test_any_text_parses_within_bounds(text):
    for level, start, end in MarkdownPlan().parse(text):
        assert 0 <= start <= end <= len(text) and 0 <= level <= 9
    assert "".join(MarkdownChunker(7, trim=False).chunks(text)) == text


def test_lines_side_by_side_have_a_range_of_places():
    """Before, a list held a place for every character (F12)."""
    from textloom.plans.markdown import _Inlines, _Parser

    for text, lines, side_by_side in (("one *two*\nthree  \n", [(0, 10), (10, 18)], True), ("> one\n> two", [(2, 6), (8, 11)], False), ("one\r\ntwo", [(0, 5), (5, 8)], False)):
        inlines = _Inlines(_Parser(text), lines)
        assert isinstance(inlines.place, range) == side_by_side
        assert [text[p] for p, c in zip(inlines.place, inlines.text) if c != "\n"] == [c for c in inlines.text if c != "\n"]
