"""Semantic ranges of one text, asked for by position and level.

A range is (level, start, end) in code points; levels are integers, larger ones
for larger units.  A plan is a function from text to ranges, plus how its ranges
cut text into sections.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

Range = tuple[int, int, int]


class Ranges:
    """Ranges in document order, larger before smaller where they start together."""

    def __init__(self, found: list[Range]):
        self.all = sorted(found, key=lambda r: (r[1], -r[2]))
        self.starts = [r[1] for r in self.all]
        self.levels = sorted({r[0] for r in self.all})
        self._own: dict[int, list[int]] = {level: [] for level in self.levels}
        for i, r in enumerate(self.all):
            self._own[r[0]].append(i)
        self._upward: dict[int, list[int]] = {}

    def first_live(self, cursor: int) -> int:
        """Index of the first range that starts at or after ``cursor``."""
        return bisect_left(self.starts, cursor)

    def live_levels(self, live: int) -> list[int]:
        """Levels of the ranges from index ``live`` on, ascending."""
        return [level for level in self.levels if self._own[level][-1] >= live]

    def _from_level(self, level: int) -> list[int]:
        """Indexes of the ranges of ``level`` and larger ones."""
        found = self._upward.get(level)
        if found is None:
            found = self._upward[level] = [i for i, r in enumerate(self.all) if r[0] >= level]
        return found

    def at_level(self, live: int, level: int) -> Iterator[Range]:
        """The live ranges of ``level`` or larger, without those that enclose the
        first range of ``level``: they would hide it."""
        indexes = self._from_level(level)
        at = bisect_left(indexes, live)
        own = self._own.get(level, [])
        k = bisect_left(own, live)
        if k < len(own):
            target = own[k]
            if target == live:
                # of neighbours that start together, the shortest
                while target + 1 < len(self.all) and self.all[target + 1][0] == level and self.starts[target + 1] == self.starts[live]:
                    target += 1
            _, first, last = self.all[target]
            while at < len(indexes):
                l, s, e = self.all[indexes[at]]
                if not ((l > level and s <= first < e) or (l == level and s == first and e > last)):
                    break
                at += 1
        for i in range(at, len(indexes)):
            yield self.all[indexes[i]]


def plain_sections(text: str, start: int, ranges: Iterator[Range]) -> Iterator[tuple[int, int]]:
    """Each range and each gap between ranges is a section, from ``start`` on."""
    cursor = start
    for _, s, e in ranges:
        if s < cursor:
            continue
        if s > cursor:
            yield cursor, s
        if e > s:
            yield s, e
        cursor = e
    if cursor < len(text):
        yield cursor, len(text)
