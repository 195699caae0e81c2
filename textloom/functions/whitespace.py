"""Unicode white space at the ends of a span, without copying text."""

from __future__ import annotations

from array import array
from functools import lru_cache

#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_WHITE = frozenset(WHITE_SPACE)

KEEP, ALL, INDENTATION = "keep", "all", "indentation"


def is_white(text: str) -> bool:
    """Whether there is nothing but white space."""
    return not text.strip(WHITE_SPACE)


@lru_cache(maxsize=1)
def _is_white():
    import numpy as np

    white = np.zeros(1 << 16, dtype=bool)
    white[[ord(c) for c in WHITE_SPACE]] = True
    return white


def runs_of_words(text: str) -> tuple[array, array]:
    """Where the runs of characters that aren't white space start and end."""
    import numpy as np

    if text.isascii():
        points = np.frombuffer(text.encode("ascii"), dtype=np.uint8)
    else:
        points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0xFFFF)
    ink = np.zeros(len(text) + 2, dtype=np.int8)
    ink[1:-1] = ~_is_white()[points]
    edges = np.flatnonzero(np.diff(ink)).astype("int64")
    starts, ends = array("q"), array("q")
    starts.frombytes(edges[::2].tobytes())
    ends.frombytes(edges[1::2].tobytes())
    return starts, ends


class Trimmer:
    """Trims spans of one text; white space is looked at from the ends only, and
    the last long run of it remembered, so that it isn't walked again."""

    def __init__(self, text: str, policy: str):
        self.text, self.policy = text, policy
        self.run = (0, 0)

    def trim(self, start: int, end: int) -> tuple[int, int]:
        """The span without white space at its ends, as the policy has it."""
        if self.policy == KEEP:
            return start, end
        text = self.text
        first, last = start, end
        known, known_end = self.run
        while first < last and text[first] in _WHITE:
            first = known_end if known <= first < known_end else first + 1
        if first - start > 32:
            self.run = start, first
        if first >= last:
            return end, end
        while text[last - 1] in _WHITE:
            last = known if known < last <= known_end else last - 1
        if end - last > 32:
            self.run = last, end
        if self.policy == INDENTATION and first > start and (text.find("\n", first, last) >= 0 or text.find("\r", first, last) >= 0):
            first = start
            while text[first] in "\r\n":
                first += 1
        return first, last
