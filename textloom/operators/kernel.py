"""Cuts one text into chunks.

Positions are code points; ``byte`` gives the UTF-8 offset of each, since byte
lengths decide some choices.  A chunk is found in four steps: pick the level of
unit to cut along, gather sections of that level, take the longest run of them
that fits, and move on (back by the overlap, if one is wanted).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

from textloom.functions.config import ChunkConfig
from textloom.functions.segments import LEVELS, Segments, characters, ends_from, goes_on, graphemes, last_stop, marks_end, sentences, words
from textloom.functions.sizers import Bytes, Characters, Words
from textloom.functions.whitespace import KEEP, Trimmer, runs_of_words
from textloom.plans.ranges import Ranges

#: A unit is first probed at this many times the capacity in bytes,
#: and is too large as soon as a prefix is this part over the capacity.
PROBE_FACTOR = 8
PROBE_PART = 4


class Chunk(NamedTuple):
    index: int
    byte_offset: int
    char_offset: int
    chunk: str


class Candidate(NamedTuple):
    """A unit at the cursor: its level, end, and the level that probes it."""

    level: object
    end: int
    probe: object


def byte_offsets(text: str) -> range | list[int]:
    """The UTF-8 offset of each code point and of the end."""
    if text.isascii():
        return range(len(text) + 1)
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate([[0], np.cumsum(widths)]).tolist()


class Cutter:
    """One pass over one text under one configuration."""

    def __init__(self, text: str, plan, config: ChunkConfig):
        self.text, self.plan, self.config = text, plan, config
        self.capacity = config.capacity
        self.byte = byte_offsets(text)
        self.ranges = Ranges(plan.parse(text))
        self.trimmer = Trimmer(text, plan.trim if config.trim else KEEP)
        self.cursor = 0
        self.longest: int | None = None
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.sizes: dict[tuple[int, int], int] = {}
        self.known: dict[Callable, tuple[int, int, int]] = {}
        self.marks = (0, 0)
        self.segments = Segments(text)
        #: Whether sizes never shrink as a span grows.
        self.monotone = True
        sizer = config.sizer
        if isinstance(sizer, Characters):
            self.size = self._characters
        elif isinstance(sizer, Bytes):
            self.size = self._bytes
        elif type(sizer) is Words:
            self.size = self._words
            self.run_starts, self.run_ends = runs_of_words(text)
        else:
            self.size = self._measured
            self.monotone = False
            self.pieces = sizer.pieces(text) if self.segments.simple and hasattr(sizer, "pieces") else None

    def _characters(self, start: int, end: int) -> int:
        start, end = self.trimmer.trim(start, end)
        return end - start

    def _bytes(self, start: int, end: int) -> int:
        start, end = self.trimmer.trim(start, end)
        return self.byte[end] - self.byte[start]

    def _words(self, start: int, end: int) -> int:
        """The runs that the span holds or cuts; trimming takes none away."""
        return max(bisect_left(self.run_starts, end) - bisect_right(self.run_ends, start), 0)

    def _measured(self, start: int, end: int) -> int:
        """The size of a trimmed span, measured once a chunk."""
        span = self.trimmer.trim(start, end)
        size = self.sizes.get(span)
        if size is None and self.pieces:
            size = self.pieces.tokens(*span)
        if size is None:
            size = self.sizes[span] = self.config.sizer.size(self.text[span[0] : span[1]])
        return size

    def chunks(self) -> Iterator[Chunk]:
        shown = index = 0
        while self.cursor < len(self.text):
            start = self.cursor
            for start, end in self.strides():
                shown = end
                yield Chunk(index, self.byte[start], start, self.text[start:end])
                index += 1
            start = self.cursor
            end = self.directly() if self.monotone else None
            if end is None:
                end = self.longest_fit(self.gather())
            width = self.byte[end] - self.byte[start]
            self.longest = width if self.longest is None else max(self.longest, width)
            self.sizes.clear()
            self.cursor = self.next_cursor(start, end)
            first, last = self.trimmer.trim(start, end)
            # an overlap may leave nothing that wasn't shown before
            if first < last and last > shown:
                shown = last
                yield Chunk(index, self.byte[first], first, self.text[first:last])
                index += 1

    def strides(self) -> Iterator[tuple[int, int]]:
        """Chunks within a word of letters and digits that is far too long, under a
        capacity of characters: nothing but characters fits, nothing is trimmed."""
        desired, most, cursor = self.capacity.desired, self.capacity.max, self.cursor
        if not (self.size == self._characters and self.segments.simple and self.config.overlap < desired):
            return
        if len(self.text) - cursor <= 2 * most or self.text.find(" ", cursor, cursor + 2 * most) >= 0:
            return
        end = self.segments.plain_run(cursor)
        live = self.ranges.first_live(cursor)
        if end - cursor <= 2 * most or (live < len(self.ranges.all) and self.ranges.starts[live] < end):
            return
        step = desired - self.config.overlap
        while end - cursor > most:
            yield cursor, cursor + desired
            cursor += step
        self.cursor = cursor

    # directly, where sizes never shrink: no section is measured but where sizes cross a bound

    def directly(self) -> int | None:
        """The end of the chunk at the cursor; None if segments can't be told from
        those of the whole text."""
        live = self.ranges.first_live(self.cursor)
        level, limit = None, None
        if live < len(self.ranges.all):
            level, limit = self.pick_level(self._plan_candidates(live), None)
        if level is not None:
            return self._among_sections(self._plan_sections(live, level), limit)
        at = self._level_directly(limit)
        return None if at is None else self._among_segments(*at)

    def _fits_directly(self, end: int) -> bool:
        return self.byte[end] - self.byte[self.cursor] <= self.capacity.max or self.size(self.cursor, end) <= self.capacity.max

    def _level_directly(self, limit: int | None) -> tuple[Sequence[int], int, int | None] | None:
        """The ends of the largest segments whose first fits, the index of the first,
        and the last place where one may start: the largest level is tried first."""
        larger: int | None = None
        for segmenter in (sentences, words, graphemes, characters):
            index = self.segments.index(segmenter, self.cursor)
            if index is None:
                return None
            ends = self.segments.ends(segmenter)
            end = ends[index]
            if larger is not None and end >= larger:
                # not shorter than the next larger level's
                larger = end
                continue
            larger = end
            if self._fits_directly(end):
                return ends, index, limit
            limit = end if limit is None else min(limit, end)
        return self.segments.ends(characters), self.cursor, limit

    def _among_sections(self, sections: Iterator[tuple[int, int]], limit: int | None) -> int:
        """The chunk's end among sections read one by one, no further than needed."""
        self.starts, self.ends = starts, ends = [], []
        cursor, desired, most, size = self.cursor, self.capacity.desired, self.capacity.max, self.size
        end, taken, settled = cursor, 0, False
        for s, e in sections:
            if limit is not None and s > limit:
                break
            n = size(cursor, e)
            if settled:
                if n > taken:
                    break
            elif n >= desired:
                if n > most and ends:
                    break
                settled = True
            starts.append(s)
            ends.append(e)
            end, taken = e, n
        return end

    def _among_segments(self, ends: Sequence[int], low: int, limit: int | None) -> int:
        """The chunk's end among segments, of which only a few are measured."""
        cursor, desired, most, size = self.cursor, self.capacity.desired, self.capacity.max, self.size
        high = len(ends) if limit is None else min(len(ends), bisect_right(ends, limit, low) + 1)
        by_runs = size == self._words
        if desired <= 0:
            at = low
        elif by_runs:
            run = bisect_right(self.run_ends, cursor) + desired - 1
            at = bisect_right(ends, self.run_starts[run], low, high) if run < len(self.run_starts) else high
        else:
            point = cursor + desired if size == self._characters else bisect_left(self.byte, self.byte[cursor] + desired, cursor)
            at = bisect_left(ends, point, low, high)
            if at < high and size(cursor, ends[at]) < desired:
                at = self._first_from(ends, at + 1, high, desired)
        taken = size(cursor, ends[at]) if at < high else most + 1
        if taken > most and at > low:
            at -= 1
        elif by_runs:
            run = bisect_right(self.run_ends, cursor) + taken
            at = bisect_right(ends, self.run_starts[run], at, high) - 1 if run < len(self.run_starts) else high - 1
        else:
            while at + 1 < high and size(cursor, ends[at + 1]) <= taken:
                at += 1
        if self.config.overlap:
            # sections far before the end can't remain within the overlap, but for white space
            first = low
            if not by_runs and at - low > 2 * self.config.overlap + 64:
                first = at - 2 * self.config.overlap - 64
                if size(ends[first], ends[at]) <= self.config.overlap:
                    first = low
            self.ends = list(ends[first : at + 1])
            self.starts = [cursor if first == low else ends[first - 1], *self.ends[:-1]]
        return ends[at]

    def _first_from(self, ends: Sequence[int], low: int, high: int, desired: int) -> int:
        """The first index from ``low`` on at which ``desired`` is reached, near ones first."""
        step = 1
        while low < high and self.size(self.cursor, ends[min(low + step, high) - 1]) < desired:
            low = min(low + step, high)
            step *= 2
        return bisect_left(ends, True, low, min(low + step, high), key=lambda e: self.size(self.cursor, e) >= desired)

    # the level

    def pick_level(self, candidates: Iterable[Candidate], inner_ends: Callable[[object], Iterator[int]]) -> tuple[object, int | None]:
        """The largest level whose unit fits, and where the first unit that
        doesn't fit ends (None if all do)."""
        chosen, byte, cursor = None, self.byte, self.cursor
        for c in self._shadowed(candidates):
            if byte[c.end] - byte[cursor] > self.capacity.max and self._too_large(c, inner_ends):
                return chosen, c.end
            chosen = c.level
        return chosen, None

    @staticmethod
    def _shadowed(candidates: Iterable[Candidate]) -> Iterator[Candidate]:
        """Without candidates that aren't shorter than the next larger level's."""
        held = None
        for c in candidates:
            if held is not None and held.end < c.end:
                yield held
            held = c
        if held is not None:
            yield held

    def _too_large(self, unit: Candidate, inner_ends: Callable[[object], Iterator[int]]) -> bool:
        """Whether a unit exceeds the capacity, told from prefixes if they say so."""
        byte, most = self.byte, self.capacity.max
        if self.monotone:
            return self.size(self.cursor, unit.end) > most
        from_byte = byte[self.cursor] + max(most * PROBE_FACTOR, 1)
        if from_byte < byte[unit.end] and unit.probe is not None:
            limit = most + max(most // PROBE_PART, 1)
            skip = stride = 0
            for end in inner_ends(unit.probe):
                if end > unit.end:
                    break
                if byte[end] < from_byte:
                    continue
                if skip:
                    skip -= 1
                    continue
                size = self.size(self.cursor, end)
                if size > limit or end == unit.end:
                    return size > most
                stride = stride * 2 or 1
                skip = stride - 1
        return self.size(self.cursor, unit.end) > most

    def _plan_sections(self, live: int, level: int) -> Iterator[tuple[int, int]]:
        return self.plan.sections(self.text, self.cursor, self.ranges.at_level(live, level))

    def _plan_candidates(self, live: int) -> Iterator[Candidate]:
        below = None
        for level in self.ranges.live_levels(live):
            for _, end in self._plan_sections(live, level):
                yield Candidate(level, end, below)
                break
            below = level

    def _fallback_candidates(self) -> Iterator[Candidate]:
        for segmenter in LEVELS:
            yield Candidate(segmenter, self.first_end(segmenter), words if segmenter is sentences else None)

    def _fallback_ends(self, segmenter: Callable) -> Iterator[int]:
        """Ends of the segments from the cursor, the first ones as they are remembered."""
        index = self.segments.index(segmenter, self.cursor)
        if index is not None:
            ends = self.segments.ends(segmenter)
            for i in range(index, len(ends)):
                yield ends[i]
            return
        given = self.first_end(segmenter)
        yield given
        known = self.known.get(segmenter)
        if known and segmenter is not sentences and known[0] <= given < known[1] and self._in_step(segmenter, given, known[2]):
            given = known[2]
            yield given
        for end in ends_from(self.text, self.cursor, segmenter):
            if end > given:
                yield end

    def first_end(self, segmenter: Callable) -> int:
        """The end of the first segment from the cursor.

        A long segment is cut many times, and its end remembered: from within it,
        up to its last mark, a sentence ends alike unless it begins with a full stop,
        and a word or grapheme does from wherever one begins that goes on as far as
        rules look.
        """
        cursor = self.cursor
        index = self.segments.index(segmenter, cursor)
        if index is not None:
            return self.segments.ends(segmenter)[index]
        known = self.known.get(segmenter)
        if known and known[0] <= cursor < known[1]:
            in_step = goes_on(self.text, cursor) if segmenter is sentences else self._in_step(segmenter, cursor, known[2])
            if in_step:
                return known[2]
        end = next(ends_from(self.text, cursor, segmenter))
        if end - cursor > 64:
            self.known[segmenter] = (cursor, last_stop(self.text, cursor, end) if segmenter is sentences else end, end)
        return end

    def _in_step(self, segmenter: Callable, at: int, end: int) -> bool:
        """Whether the segment that begins at ``at``, inside one up to ``end``,
        surely ends there too."""
        if end - at <= 256:
            return False
        if not self.marks[0] <= at < self.marks[1]:
            self.marks = (at, marks_end(self.text, at))
        if self.marks[1] > at:
            # marks without a letter before them join nothing that follows
            return self.marks[1] >= end
        return next(segmenter(self.text[at : at + 256], False), None) is None

    def sections(self) -> tuple[Iterator[tuple[int, int]], int | None]:
        """Sections from the cursor on, and the last place where one may start."""
        text, cursor = self.text, self.cursor
        live = self.ranges.first_live(cursor)
        level, limit = self.pick_level(self._plan_candidates(live), lambda lower: (end for _, end in self._plan_sections(live, lower)))
        if level is not None:
            return self._plan_sections(live, level), limit
        level, own_limit = self.pick_level(self._fallback_candidates(), self._fallback_ends)
        ends = self._fallback_ends(level) if level else ends_from(text, cursor, LEVELS[0])

        def cut() -> Iterator[tuple[int, int]]:
            start = cursor
            for end in ends:
                yield start, end
                start = end

        return cut(), min((x for x in (limit, own_limit) if x is not None), default=None)

    # the sections

    def gather(self) -> int:
        """Fills ``starts`` and ``ends`` as far as a chunk could reach; returns the
        index of a section up to which there is room for sure."""
        byte, begin = self.byte, self.byte[self.cursor]
        most = self.capacity.max
        sections, limit = self.sections()
        self.starts, self.ends = starts, ends = [], []
        goal = most if self.longest is None else self.longest
        low, equal = 0, None
        more = True
        while more:
            before = len(ends)
            more = False
            for s, e in sections:
                if limit is not None and s > limit:
                    sections = iter(())
                    break
                starts.append(s)
                ends.append(e)
                if byte[e] - begin > goal:
                    break
            reach = byte[ends[-1]] - begin if ends else 0
            if len(ends) == before or reach < goal:
                break
            size = self.size(self.cursor, ends[-1])
            fit = self.capacity.fits(size)
            if fit > 0:
                break
            unit = max(size, 1)
            goal = reach + max(most - unit, 1) * -(-reach // unit) + -(-reach // 10)
            if fit < 0:
                low = len(ends) - 1
            elif equal is not None and equal < size:
                break
            else:
                equal = size
            more = True
        return low

    # the chunk

    def longest_fit(self, low: int) -> int:
        """The end of the chunk at the cursor.

        Bisects for the last section that fits; once the desired size is reached,
        for the first that reaches it.  Sections that add no size go along.
        """
        cursor, ends, fits = self.cursor, self.ends, self.capacity.fits
        end, taken, taken_size, reached = cursor, None, 0, False
        high = len(ends) - 1
        while low <= high:
            mid = (low + high) // 2
            size = self.size(cursor, ends[mid])
            fit = fits(size)
            better = (fit < 0 and ends[mid] > end) or (fit == 0 and (not reached or ends[mid] < end)) or (fit > 0 and mid == 0 and end == cursor)
            if better:
                end, taken, taken_size = ends[mid], mid, size
            reached = reached or fit == 0
            if fit < 0:
                low = mid + 1
            else:
                high = mid - 1
        if taken is not None:
            for further in range(taken + 1, len(ends)):
                if self.size(cursor, ends[further]) > taken_size:
                    break
                end = max(end, ends[further])
        return end

    def next_cursor(self, start: int, end: int) -> int:
        """Where the next chunk starts: the earliest section after ``start`` from
        which no more than the overlap remains up to ``end``."""
        overlap = self.config.overlap
        if not overlap:
            return end
        found, low, high = end, 0, bisect_left(self.ends, end)
        while low <= high and low < len(self.starts):
            mid = min((low + high) // 2, len(self.starts) - 1)
            s = self.starts[mid]
            size = self.size(s, end) if s < end else 0
            if size <= overlap and start < s < found:
                found = s
            if size < overlap and mid > 0:
                high = mid - 1
            else:
                low = mid + 1
        return found


def cut(text: str, plan, config: ChunkConfig) -> Iterator[Chunk]:
    """The chunks of ``text``, in order."""
    return Cutter(text, plan, config).chunks()


__all__ = ["Chunk", "Cutter", "cut"]
