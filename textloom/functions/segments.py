"""Unicode text segmentation (UAX #29) from the start of a string.

Each function takes a string and yields the ends of its segments.  If the string
is only the front of a longer one (``whole`` false), an end is given only where
nothing that follows could move it.

Scripts that need a dictionary (Thai, Chinese, Japanese and others) are cut by
the default rules.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import regex

_X = r"[\p{WB=Extend}\p{WB=Format}\p{WB=ZWJ}]*+"
_LETTER = rf"(?:\p{{WB=ALetter}}{_X}|\p{{WB=Hebrew_Letter}}{_X}(?:\p{{WB=Double_Quote}}{_X}(?=\p{{WB=Hebrew_Letter}}))?)"
#: Colons part words, but for the languages that write them inside.
_MIDDLE = r"(?![:\ufe55\uff1a])[\p{WB=MidLetter}\p{WB=MidNumLet}\p{WB=Single_Quote}]"
_LETTERS = rf"{_LETTER}(?:(?:{_MIDDLE}{_X})?{_LETTER})*+(?:(?<=\p{{WB=Hebrew_Letter}}{_X})\p{{WB=Single_Quote}}{_X})?"
_DIGITS = rf"\p{{WB=Numeric}}{_X}(?:(?:[\p{{WB=MidNum}}\p{{WB=MidNumLet}}\p{{WB=Single_Quote}}]{_X})?\p{{WB=Numeric}}{_X})*+"
_KANA = rf"(?:\p{{WB=Katakana}}{_X})++"
_BLOCK = rf"(?:(?:{_LETTERS}|{_DIGITS})++|{_KANA})"
_TIE = rf"(?:\p{{WB=ExtendNumLet}}{_X})++"
_PICTURES = rf"(?:(?<=‍)\p{{Extended_Pictographic}}{_X})*+"
_WORD = regex.compile(
    rf"\r\n|[\r\n\p{{WB=Newline}}]"
    rf"|(?:{_TIE}(?:{_BLOCK}{_TIE})*+{_BLOCK}?|{_BLOCK}(?:{_TIE}{_BLOCK})*+(?:{_TIE})?){_PICTURES}"
    rf"|\p{{WB=WSegSpace}}++{_X}{_PICTURES}"
    rf"|\p{{WB=Regional_Indicator}}{_X}(?:\p{{WB=Regional_Indicator}}{_X})?{_PICTURES}"
    rf"|(?s:.){_X}{_PICTURES}"
)
_GRAPHEME = regex.compile(r"\X")

_I = r"[\p{SB=Extend}\p{SB=Format}]*+"
_STOP = regex.compile(r"\r\n|[\p{SB=Sep}\r\n]|[\p{SB=STerm}\p{SB=ATerm}]")
_SEPARATOR = regex.compile(r"\r\n|[\p{SB=Sep}\r\n]")
_IGNORED = regex.compile(_I)
_ATERM = regex.compile(r"\p{SB=ATerm}")
_DIGIT = regex.compile(r"\p{SB=Numeric}")
_CAPITAL = regex.compile(r"\p{SB=Upper}")
_CASED_BEFORE = regex.compile(rf"[\p{{SB=Upper}}\p{{SB=Lower}}]{_I}$")
_CLOSED = regex.compile(rf"(?:\p{{SB=Close}}{_I})*+(?:\p{{SB=Sp}}{_I})*+")
_GOES_ON = regex.compile(r"[\p{SB=SContinue}\p{SB=STerm}\p{SB=ATerm}]")
_TO_LETTER = regex.compile(r"[^\p{SB=OLetter}\p{SB=Upper}\p{SB=Lower}\p{SB=Sep}\r\n\p{SB=STerm}\p{SB=ATerm}]*+")
_SMALL = regex.compile(r"\p{SB=Lower}")

#: How much a decision can look ahead in graphemes and words.
_MARGIN = 64


_MARKS = regex.compile(rf"{_X}")


def marks_end(text: str, start: int) -> int:
    """Where a run of marks that extend what is before them ends."""
    return _MARKS.match(text, start).end()


def characters(text: str, whole: bool = True) -> Iterator[int]:
    return iter(range(1, len(text) + 1))


def _by_pattern(pattern: regex.Pattern) -> Callable[[str, bool], Iterator[int]]:
    def ends(text: str, whole: bool = True) -> Iterator[int]:
        last = len(text) if whole else len(text) - _MARGIN
        for m in pattern.finditer(text):
            if m.end() > last:
                return
            yield m.end()

    return ends


graphemes = _by_pattern(_GRAPHEME)
words = _by_pattern(_WORD)


def sentences(text: str, whole: bool = True) -> Iterator[int]:
    n, at = len(text), 0
    last = n if whole else n - _MARGIN
    emitted = 0
    while True:
        stop = _STOP.search(text, at)
        if not stop:
            break
        at = stop.end()
        if not _SEPARATOR.match(text, stop.start()):
            at = _after_terminator(text, stop.start(), at, whole)
            if at < 0:
                at = -at
                continue
        if at > last:
            break
        if at > emitted:
            yield at
            emitted = at
    if whole and emitted < n:
        yield n


#: Of simple text: a line break; or stops with what ends the sentence, if that is told
#: by the next two characters.
_PLAIN_STOP = re.compile(r"\r\n|[\r\n]|[.!?]+(?:\n| (?=[A-ZÀ-ÖØ-Þ])|(?<=[!?]) (?=[A-Za-z]))?")


def _plain_sentences(text: str) -> Iterator[int]:
    """The sentences of a whole simple text."""
    emitted = 0
    for stop in _PLAIN_STOP.finditer(text):
        at = stop.end()
        if at <= emitted:
            continue
        if text[at - 1] in ".!?":
            at = _after_terminator(text, at - 1, at, True)
        if at > emitted:
            yield at
            emitted = at
    if emitted < len(text):
        yield len(text)


def _after_terminator(text: str, start: int, end: int, whole: bool) -> int:
    """Where the sentence ends after a terminator; minus a position to go on
    from if it doesn't."""
    # the usual cases: a line break, or a space and an ASCII capital
    follows = text[end : end + 2]
    if follows[:1] == "\n":
        return end + 1
    if follows[:1] == " " and "A" <= follows[1:] <= "Z":
        return end + 1
    at = _IGNORED.match(text, end).end()
    aterm = _ATERM.match(text, start)
    if aterm:
        if _DIGIT.match(text, at):
            return -at
        if _CAPITAL.match(text, at) and _CASED_BEFORE.search(text[max(0, start - 16) : start]):
            return -at
    at = _CLOSED.match(text, at).end()
    if aterm:
        letter = _TO_LETTER.match(text, at).end()
        if _SMALL.match(text, letter):
            return -at
        if letter == len(text) and not whole:
            return letter  # too near the end to tell
    if _GOES_ON.match(text, at):
        return -at
    separator = _SEPARATOR.match(text, at)
    return separator.end() if separator else at


#: From small to large.
LEVELS: list[Callable[[str, bool], Iterator[int]]] = [characters, graphemes, words, sentences]


def ends_from(text: str, start: int, segmenter: Callable[[str, bool], Iterator[int]], window: int = 2048) -> Iterator[int]:
    """Ends (in ``text``) of the segments of ``text[start:]``, which is only cut
    as far as it is read."""
    if segmenter is characters:
        yield from range(start + 1, len(text) + 1)
        return
    given = start
    while True:
        whole = start + window >= len(text)
        for end in segmenter(text[start : start + window], whole):
            if start + end > given:
                given = start + end
                yield given
        if whole:
            return
        window *= 4


def goes_on(text: str, start: int, window: int = 2048) -> bool:
    """Whether a sentence that is cut at ``start`` surely ends where it did: rules
    look back only from a full stop, over marks, to the letter before it."""
    at = marks_end(text, start)
    if not _ATERM.match(text, at):
        return True
    front = text[start : start + window]
    found = _after_terminator(front, at - start, at - start + 1, False) if at - start + _MARGIN < window else 0
    return found < 0


def last_stop(text: str, start: int, end: int) -> int:
    """After the last mark that could end a sentence; ``end`` if there is none."""
    last = end
    for stop in _STOP.finditer(text, start, end):
        last = stop.start() + 1
    return last


# The segments of one whole text, found once.

_L, _D, _TIED, _SP, _MID, _NUM, _CR, _LF, _NONE = 1, 2, 4, 8, 16, 32, 64, 128, 255


@lru_cache(maxsize=1)
def _classes():
    """Kinds of the characters of ASCII and of Latin letters that stand alone."""
    import numpy as np

    kinds = np.full(1 << 16, _NONE, dtype=np.uint8)
    kinds[:0x80] = 0
    for first, last in ("AZ", "az", "ÀÖ", "Øö", "øſ"):
        kinds[ord(first) : ord(last) + 1] = _L
    for members, kind in (("0123456789", _D), ("_", _TIED), (" ", _SP), (".'", _MID), (",;", _NUM), ("\r", _CR), ("\n", _LF)):
        kinds[[ord(c) for c in members]] = kind
    return kinds


def _array(ends) -> array:
    made = array("q")
    made.frombytes(ends.astype("int64").tobytes())
    return made


class Segments:
    """The segments of ``text`` by level, each level found when it is asked for.

    From an end on, what follows is segmented alike whether or not the front is
    there; so a cut that starts at an end goes on in the same list.  In simple text
    (ASCII and Latin letters) boundaries hang on two neighbours only, and are told
    for all characters at once.
    """

    def __init__(self, text: str):
        self.text = text
        self._found: dict[Callable, Sequence[int]] = {characters: range(1, len(text) + 1)}
        self._stops: dict[int, int] = {}
        self._kinds = self._breaks = None
        self._plain = (0, 0)
        self.simple = False
        if len(text) < 1 << 31:
            import numpy as np

            ascii_only = text.isascii()
            points = np.frombuffer(text.encode("ascii") if ascii_only else text.encode("utf-16-le", "surrogatepass"), dtype=np.uint8 if ascii_only else np.uint16)
            self._kinds = _classes()[points]
            self.simple = ascii_only or (len(points) == len(text) and int(self._kinds.max()) != _NONE)

    def _simple(self, segmenter: Callable) -> Sequence[int]:
        """Ends of graphemes or words of simple text."""
        import numpy as np

        c = self._kinds
        a, b = c[:-1], c[1:]
        joined = (a == _CR) & (b == _LF)
        if segmenter is graphemes:
            if not joined.any():
                return self._found[characters]
        else:
            joined |= ((a & 7) != 0) & ((b & 7) != 0)
            joined |= (a == _SP) & (b == _SP)
            if len(c) > 2:
                around = c[:-2] & c[2:]
                between = ((c[1:-1] & _MID) != 0) & ((around & (_L | _D)) != 0) | (c[1:-1] == _NUM) & ((around & _D) != 0)
                # the marks within a word or number go with both neighbours
                joined[:-1] |= between
                joined[1:] |= between
        return _array(np.append(np.flatnonzero(~joined) + 1, len(c)))

    def plain_run(self, at: int) -> int:
        """Where the letters, digits and ``_`` from ``at`` on end, in simple text."""
        if not self._plain[0] <= at < self._plain[1]:
            if self._breaks is None:
                import numpy as np

                self._breaks = np.flatnonzero((self._kinds & 7) == 0)
            k = int(self._breaks.searchsorted(at))
            self._plain = (at, int(self._breaks[k]) if k < len(self._breaks) else len(self.text))
        return self._plain[1]

    def ends(self, segmenter: Callable) -> Sequence[int]:
        found = self._found.get(segmenter)
        if found is None:
            if not self.text:
                found = range(0)
            elif self.simple:
                found = array("q", _plain_sentences(self.text)) if segmenter is sentences else self._simple(segmenter)
            else:
                found = array("q", segmenter(self.text, True))
            self._found[segmenter] = found
        return found

    def index(self, segmenter: Callable, at: int) -> int | None:
        """The index, among ``ends``, of the first segment of ``text[at:]``; None if
        that is segmented otherwise, or can't be told."""
        if segmenter is characters:
            return at
        ends = self.ends(segmenter)
        k = bisect_right(ends, at)
        start = ends[k - 1] if k else 0
        if segmenter is sentences:
            if at != start and at >= self._last_stop(k, start, ends[k]):
                return None
            apart = self.text[at] != "." if self.simple else goes_on(self.text, at)
            return k if apart else None
        if at == start or (self.simple and self._kinds[at] not in (_MID, _NUM)):
            return k
        return None

    def _last_stop(self, k: int, start: int, end: int) -> int:
        found = self._stops.get(k)
        if found is None:
            found = self._stops[k] = last_stop(self.text, start, end)
        return found
