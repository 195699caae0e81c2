"""Chunking by its rules, plainly: every section of the rest of the text is looked
at, every size measured, nothing remembered. For sizers that never shrink as text
grows."""

from textloom.functions import segments
from textloom.functions.whitespace import ALL, WHITE_SPACE

LEVELS = [segments.characters, segments.graphemes, segments.words, segments.sentences]


def trimmed(text, start, end, trim, keep_indentation):
    """The span without white space at its ends, as the trim policy has it."""
    if not trim:
        return start, end
    part = text[start:end]
    body = part.strip(WHITE_SPACE)
    if keep_indentation and ("\n" in body or "\r" in body):
        front = len(part) - len(part.lstrip("\r\n"))
    else:
        front = len(part) - len(part.lstrip(WHITE_SPACE))
    return (start + front, start + len(part.rstrip(WHITE_SPACE))) if body else (start + len(part), start + len(part))


def at_level(ranges, level):
    """The ranges of a level and larger ones, without those around the first of it."""
    first = next(i for i, r in enumerate(ranges) if r[0] == level)
    if first == 0:
        while first + 1 < len(ranges) and ranges[first + 1][0] == level and ranges[first + 1][1] == ranges[0][1]:
            first += 1
    _, s, e = ranges[first]
    out = [r for r in ranges if r[0] >= level]
    while out and ((out[0][0] > level and out[0][1] <= s < out[0][2]) or (out[0][0] == level and out[0][1] == s and out[0][2] > e)):
        out.pop(0)
    return out


def chunks(text, plan, desired, most, size_of, overlap=0, trim=True):
    """(character offset, chunk) of each chunk."""
    keep = plan.trim is not ALL
    found = sorted(plan.parse(text), key=lambda r: (r[1], -r[2]))
    octets = lambda a, b: len(text[a:b].encode())

    def size(a, b):
        a, b = trimmed(text, a, b, trim, keep)
        return size_of(text[a:b])

    def choose(candidates, cursor):
        """The last level accepted, and where a unit that is too large ends."""
        merged = []
        for level, end in candidates:
            if merged and octets(cursor, merged[-1][1]) >= octets(cursor, end):
                merged.pop()
            merged.append((level, end))
        chosen = None
        for level, end in merged:
            if octets(cursor, end) > most and size(cursor, end) > most:
                return chosen, end
            chosen = level
        return chosen, None

    def pieces(segmenter, cursor):
        ends = [0, *segmenter(text[cursor:], True)]
        return [(cursor + a, cursor + b) for a, b in zip(ends, ends[1:])]

    out, cursor, shown = [], 0, 0
    while cursor < len(text):
        live = [r for r in found if r[1] >= cursor]
        sections = {level: list(plan.sections(text, cursor, iter(at_level(live, level)))) for level in sorted({r[0] for r in live})}
        level, limit = choose([(k, v[0][1]) for k, v in sections.items() if v], cursor)
        if level is None:
            units = {k: pieces(k, cursor) for k in LEVELS}
            level, own = choose([(k, units[k][0][1]) for k in LEVELS], cursor)
            parts = units[level or LEVELS[0]]
            limit = min((x for x in (limit, own) if x is not None), default=None)
        else:
            parts = sections[level]
        parts = [p for p in parts if limit is None or p[0] <= limit]
        sizes = [size(cursor, e) for _, e in parts]
        within = [i for i, n in enumerate(sizes) if desired <= n <= most]
        less = [i for i, n in enumerate(sizes) if n < desired]
        at = within[0] if within else less[-1] if less else 0
        taken = sizes[at]
        while at + 1 < len(parts) and sizes[at + 1] <= taken:
            at += 1
        end = parts[at][1]
        a, b = trimmed(text, cursor, end, trim, keep)
        if a < b and b > shown:
            out.append((a, text[a:b]))
            shown = b
        starts = [s for s, _ in parts[: at + 1] if s > cursor and overlap and size(s, end) <= overlap]
        cursor = min(starts, default=end)
    return out
