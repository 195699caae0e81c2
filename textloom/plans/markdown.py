"""Markdown: headings, blocks and inline elements with their places in the text.

A block parser for CommonMark with tables, footnotes, task lists, metadata,
definition lists, alerts and quotes works on views: a line's span without what its containers (quotes, list
items, definitions, footnotes) take off its front.  An inline parser then reads a
block's views, math and wiki links included.
Only places matter: what is shown, where links lead and titles aren't kept.

Text is split where typographic marks (quotes, dashes, dots), escapes, entities and
delimiters stand, as parsers do that replace them.

Levels, small to large: soft break, inline, block, rule, headings 6 to 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.entities import html5

from textloom.functions.whitespace import INDENTATION, is_white
from textloom.plans.ranges import Range

SOFT_BREAK, INLINE, BLOCK, RULE = 0, 1, 2, 3


def heading(level: int) -> int:
    return 10 - level


#: A line of words and spaces, between letters or digits.
_PLAIN = re.compile(r"([A-Za-z0-9](?:[A-Za-z0-9 ]*[A-Za-z0-9])?)[ \t]*[\r\n]*")
#: Start and end of a line's rest, the end past its line break.
View = tuple[int, int]

_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ATX = re.compile(r"( {0,3})(#{1,6})(?=[ \t]|$)")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})")
_QUOTE = re.compile(r" {0,3}>")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
_FOOTNOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*")
_MEANING = re.compile(r" {0,3}:(?=[ \t])")
_ALERT = re.compile(r"\[!(?:NOTE|TIP|IMPORTANT|WARNING|CAUTION)\][ \t]*$", re.I)
_WIKI_LINK = re.compile(r"!?\[\[(?P<target>[^\[\]|\n]+)(?:\|(?P<shown>[^\[\]\n]*))?\]\]")
_MATH = re.compile(r"\$\$(?P<display>(?:[^\\$]|\\.|\$(?!\$))+)\$\$|\$(?![\s$])(?:[^\\$]|\\.)*(?<!\s)\$", re.S)
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)(?:[ \t]*(?:\n[ \t]*)?(?<=\s)(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)")
_DEFINITION_PLAIN = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)[ \t]*(?:\n|$)")
_DELIMITERS = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_TASK = re.compile(r"\[[ xX]\](?=[ \t\n]|$)")
_TAG_END = r"(?:[ \t>/]|$)"
#: The names by which HTML blocks are told.
_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
_ATTRIBUTE = r"""(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)"""
_TAG = rf"(?:<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)"
_HTML_STARTS = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(_BLOCK_TAGS.split())}){_TAG_END}", re.I), None),
    (re.compile(rf"{_TAG}[ \t]*$"), None),
]
_INLINE_HTML = re.compile(rf"{_TAG}|<!---?>|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)>")
_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#\d{1,7}|[A-Za-z][A-Za-z0-9]*);")
_LINK_TAIL = re.compile(r"\(\s*(?:(?:<(?:[^<>\n\\]|\\.)*>|(?!<)(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\))+)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?)?\s*\)", re.S)
_REFERENCE_TAIL = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]")
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")
_SPECIAL = re.compile(r"[\n\\`*_~^<&!\[\]'\".\-$]")


def _is_punctuation(c: str) -> bool:
    if c.isascii():
        return bool(_PUNCTUATION.match(c))
    import unicodedata

    return unicodedata.category(c)[0] in "PS"


class _Parser:
    def __init__(self, text: str):
        self.text, self.found = text, []
        self.definitions: set[str] = set()

    def add(self, level: int, start: int, end: int) -> None:
        self.found.append((level, start, end))

    # views

    def line(self, view: View) -> str:
        return self.text[view[0] : view[1]].rstrip("\r\n")

    def blank(self, view: View) -> bool:
        return not self.text[view[0] : view[1]].strip(" \t\r\n")

    def indent(self, view: View) -> int:
        line = self.text[view[0] : view[1]]
        rest = line.lstrip(" ")
        width = len(line) - len(rest)
        for c in rest if rest[:1] == "\t" else "":
            if c == " ":
                width += 1
            elif c == "\t":
                width += 4 - width % 4
            else:
                break
        return width

    def stripped(self, view: View, columns: int) -> View:
        """The view without up to ``columns`` of indentation."""
        at, width = view[0], 0
        while at < view[1] and width < columns and self.text[at] in " \t":
            width += 1 if self.text[at] == " " else 4 - width % 4
            at += 1
        return at, view[1]

    # blocks

    def blocks(self, views: list[View], tight: bool = False) -> None:
        """Parses the blocks of a container, once those at hand are done: nesting
        may be deeper than calls can be."""
        self.containers.append((views, tight))

    def _blocks(self, views: list[View], tight: bool, top: bool) -> None:
        i = 0
        while i < len(views):
            if self.blank(views[i]):
                i += 1
                continue
            i = self.block(views, i, tight, top)

    def block(self, views: list[View], i: int, tight: bool, top: bool) -> int:
        """Parses the block that starts at view i; the first view after it."""
        view = views[i]
        first = self.text[view[0]]
        if "a" <= first <= "z" or "A" <= first <= "Z":
            # no mark at the front: a paragraph or a table
            if i + 1 < len(views) and self.table_at(views, i):
                return self.table(views, i)
            return self.paragraph(views, i, tight)
        line = self.line(view)
        if self.indent(view) >= 4:
            return self.indented_code(views, i)
        if top and line.rstrip() in ("---", "+++"):
            end = self.metadata(views, i, line.rstrip())
            if end:
                return end
        if _RULE.match(line):
            self.add(RULE, view[0] + len(line) - len(line.lstrip(" ")), view[1])
            return i + 1
        if m := _ATX.match(line):
            self.atx(view, line, m)
            return i + 1
        if m := _FENCE.match(line):
            return self.fenced_code(views, i, m)
        if _QUOTE.match(line):
            return self.quote(views, i)
        if _ITEM.match(line):
            return self.list(views, i)
        if (m := _FOOTNOTE.match(line)) and top:
            return self.footnote(views, i, m)
        kind = self.html_start(line)
        if kind is not None:
            return self.html(views, i, kind)
        if i + 1 < len(views) and self.table_at(views, i):
            return self.table(views, i)
        return self.paragraph(views, i, tight)

    def indented_code(self, views: list[View], i: int) -> int:
        begin = last = i
        while i < len(views) and (self.blank(views[i]) or self.indent(views[i]) >= 4):
            if not self.blank(views[i]):
                last = i
            i += 1
        lines = [self.stripped(v, 4) for v in views[begin : last + 1]]
        self.add(BLOCK, lines[0][0], lines[-1][1])
        self.verbatim(lines)
        return last + 1

    def verbatim(self, lines: list[View]) -> None:
        """Text taken as it is: an element as long as lines follow without a gap."""
        held: View | None = None
        for s, e in lines:
            if held and held[1] == s:
                held = (held[0], e)
            elif e > s:
                if held:
                    self.add(INLINE, *held)
                held = (s, e)
        if held:
            self.add(INLINE, *held)

    def metadata(self, views: list[View], i: int, mark: str) -> int | None:
        if i + 1 >= len(views) or self.blank(views[i + 1]):
            return None
        ends = ("---", "...") if mark == "---" else ("+++",)
        for k in range(i + 1, len(views)):
            if self.line(views[k]).rstrip() in ends:
                self.add(BLOCK, views[i][0], views[k][0] + len(self.line(views[k])))
                self.verbatim(views[i + 1 : k])
                return k + 1
        return None

    def atx(self, view: View, line: str, m: re.Match) -> None:
        start = view[0] + m.end(1)
        self.add(heading(len(m[2])), start, view[1])
        content = line[m.end() :].rstrip(" \t")
        closed = re.sub(r"(?:^|[ \t])#+$", "", content) if content.endswith("#") else content
        s = view[0] + m.end()
        e = s + len(closed.rstrip(" \t"))
        while s < e and self.text[s] in " \t":
            s += 1
        self.inlines([(s, e)])

    def fenced_code(self, views: list[View], i: int, m: re.Match) -> int:
        start, fence, depth = views[i][0] + m.end(1), m[2], len(m[1])
        close = re.compile(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$")
        inner: list[View] = []
        k = i + 1
        end = views[i][1]
        while k < len(views):
            line = self.line(views[k])
            if close.match(line):
                end = views[k][0] + len(line)
                k += 1
                break
            inner.append(self.stripped(views[k], depth))
            end = views[k][1]
            k += 1
        self.add(BLOCK, start, end)
        self.verbatim(inner)
        return k

    def interrupts(self, view: View, in_list: bool = False) -> bool:
        """Whether a line ends a paragraph."""
        line = self.line(view)
        if self.indent(view) >= 4:
            return False
        if _RULE.match(line) or _ATX.match(line) or _FENCE.match(line) or _QUOTE.match(line):
            return True
        if m := _ITEM.match(line):
            rest = line[m.end() :].strip()
            return bool(rest) and (len(m[2]) == 1 or m[2][:-1] == "1" or in_list) or (in_list and bool(m))
        kind = self.html_start(line)
        return kind is not None and kind < 6

    def contained(self, views: list[View], i: int, own, mark: re.Pattern | None = None) -> tuple[list[View], int]:
        """The views of a container from i on: those that ``own`` turns into inner
        ones, and lazy continuations of a paragraph that is open, up to a line that
        begins with ``mark``."""
        inner: list[View] = []
        k, fences = i, 0
        while k < len(views):
            v = own(views[k], k == i)
            if v is None:
                lazy = inner and not self.blank(views[k]) and not (mark and mark.match(self.line(views[k]))) and not self.interrupts(views[k], True) and self.open_paragraph(inner, fences % 2 == 1)
                if not lazy:
                    break
                v = self.stripped(views[k], 99)
            inner.append(v)
            fences += bool(_FENCE.match(self.line(v)))
            k += 1
        return inner, k

    def open_paragraph(self, inner: list[View], fenced: bool) -> bool:
        """Whether the last of these views is in a paragraph that could go on;
        ``fenced``: a code fence among them is open."""
        view = inner[-1]
        while True:
            if self.blank(view):
                return False
            line = self.line(view)
            if m := _QUOTE.match(line):
                view = self.stripped((view[0] + m.end(), view[1]), 1)
            elif m := _ITEM.match(line):
                view = self.stripped((view[0] + m.end(), view[1]), 4)
            else:
                break
        if _RULE.match(line) or _ATX.match(line) or self.html_start(line) is not None:
            return False
        if fenced:
            return False
        return self.indent(view) < 4 or len(inner) > 1 and not self.blank(inner[-2])

    def quote(self, views: list[View], i: int) -> int:
        def own(view: View, first: bool) -> View | None:
            m = _QUOTE.match(self.line(view))
            return self.stripped((view[0] + m.end(), view[1]), 1) if m else None

        inner, k = self.contained(views, i, own)
        start = views[i][0] + self.text[views[i][0] : views[i][1]].index(">")
        self.add(BLOCK, start, views[k - 1][1])
        if _ALERT.match(self.line(inner[0])):
            inner = inner[1:]
        self.blocks(inner)
        return k

    def list(self, views: list[View], i: int) -> int:
        first = _ITEM.match(self.line(views[i]))
        kind = first[2][-1]
        begin = views[i][0]
        items: list[tuple[int, int, list[View]]] = []
        loose, k = False, i
        while k < len(views):
            line = self.line(views[k])
            m = _ITEM.match(line)
            if not m or m[2][-1] != kind or _RULE.match(line) or self.indent(views[k]) >= 4:
                break
            rest = line[m.end() :]
            pad = self.indent((views[k][0] + m.end(), views[k][1]))
            empty = not rest.strip()
            width = m.end() + (1 if empty or pad > 4 else pad)
            state = {"blank": empty, "n": 0}

            def own(view: View, is_first: bool, width=width, m=m, empty=empty, pad=pad, state=state) -> View | None:
                if is_first:
                    return self.stripped((view[0] + m.end(), view[1]), 1 if empty or pad > 4 else pad)
                state["n"] += 1
                if self.blank(view):
                    # an item that begins with a blank line has no second one
                    return None if empty and state["n"] == 1 else self.stripped(view, width)
                return self.stripped(view, width) if self.indent(view) >= width else None

            inner, after = self.contained(views, k, own)
            begun = views[k][0]
            if after < len(views) and self.blank(views[after]):
                while after < len(views) and self.blank(views[after]):
                    after += 1
            trailing = len(inner)
            while trailing and self.blank(inner[trailing - 1]):
                trailing -= 1
            # a blank line between two of an item's blocks, or before the next item
            loose = loose or self.loosens(inner[:trailing])
            k = after
            # an item ends where the line of the next one starts
            items.append((begun, views[k - 1][1], inner))
            nxt = _ITEM.match(self.line(views[k])) if k < len(views) else None
            goes_on = nxt and nxt[2][-1] == kind and not _RULE.match(self.line(views[k])) and self.indent(views[k]) < 4
            if goes_on and self.blank(views[k - 1]):
                loose = True
            if not goes_on:
                break
        stop = views[k - 1][1]
        self.add(BLOCK, begin, stop)
        for start, end, inner in items:
            self.add(BLOCK, start, end)
            if inner and (m := _TASK.match(self.text[inner[0][0] : inner[0][1]])):
                self.add(INLINE, inner[0][0], inner[0][0] + 3)
                inner = [self.stripped((inner[0][0] + 3, inner[0][1]), 1), *inner[1:]]
            self.blocks(inner, tight=not loose)
        return k

    def loosens(self, inner: list[View]) -> bool:
        """Whether a blank line stands between direct children."""
        fence = None
        for a, view in enumerate(inner):
            line = self.line(view)
            m = _FENCE.match(line)
            if m and fence is None:
                fence = m[2][0]
            elif m and m[2][0] == fence:
                fence = None
            if fence is None and self.blank(view) and a and self.indent(inner[a + 1]) < 2 if a + 1 < len(inner) else False:
                return True
        return False

    def footnote(self, views: list[View], i: int, m: re.Match) -> int:
        def own(view: View, first: bool) -> View | None:
            # one paragraph, whose further lines come lazily, and blank lines
            return (view[0] + m.end(), view[1]) if first else view if self.blank(view) else None

        inner, k = self.contained(views, i, own)
        start = views[i][0] + len(self.line(views[i])) - len(self.line(views[i]).lstrip(" "))
        self.add(BLOCK, start, views[k - 1][1])
        self.blocks(inner)
        return k

    def html_start(self, line: str) -> int | None:
        rest = line.lstrip(" ")
        if not rest.startswith("<") or len(line) - len(rest) > 3:
            return None
        for kind, (start, _) in enumerate(_HTML_STARTS):
            if start.match(rest):
                return kind
        return None

    def html(self, views: list[View], i: int, kind: int) -> int:
        close, k = _HTML_STARTS[kind][1], i
        while k < len(views):
            if close is None and self.blank(views[k]):
                break
            k += 1
            if close is not None and close.search(self.line(views[k - 1])):
                break
        start = views[i][0] + self.text[views[i][0] : views[i][1]].index("<")
        self.add(BLOCK, start, views[k - 1][1])
        for s, e in [(start, views[i][1]), *views[i + 1 : k]]:
            self.add(BLOCK, s, e)
        return k

    def cells(self, view: View) -> list[tuple[int, int]]:
        """The spans between the bars of a table row."""
        line = self.line(view)
        at = view[0] + len(line) - len(line.lstrip(" \t"))
        end = view[0] + len(line.rstrip(" \t"))
        if at < end and self.text[at] == "|":
            at += 1
        found, k = [], at
        while k < end:
            if self.text[k] == "\\":
                k += 2
                continue
            if self.text[k] == "|":
                found.append((at, k))
                at = k + 1
            k += 1
        if at < end:
            found.append((at, end))
        return found

    def table_at(self, views: list[View], i: int) -> bool:
        head, rule = self.line(views[i]), self.line(views[i + 1])
        if "|" not in head or "-" not in rule or not _DELIMITERS.match(rule) or self.indent(views[i + 1]) >= 4:
            return False
        return len(self.cells(views[i])) == len(self.cells(views[i + 1]))

    def table(self, views: list[View], i: int) -> int:
        k = i + 2
        while k < len(views) and not self.blank(views[k]) and not self.interrupts(views[k]):
            k += 1
        begin = views[i][0] + len(self.line(views[i])) - len(self.line(views[i]).lstrip(" "))
        self.add(BLOCK, begin, views[k - 1][1])
        width = len(self.cells(views[i]))
        for v in [views[i], *views[i + 2 : k]]:
            line = self.line(v)
            self.add(BLOCK, v[0] + len(line) - len(line.lstrip(" ")), v[1])
            for s, e in self.cells(v)[:width]:
                self.add(INLINE, s, e)
                inner = self.text[s:e]
                self.inlines([(s + len(inner) - len(inner.lstrip(" \t")), s + len(inner.rstrip(" \t")))])
        return k

    def meaning_at(self, views: list[View], k: int) -> re.Match | None:
        """The mark of a definition at view k, if one begins there."""
        return _MEANING.match(self.line(views[k])) if k < len(views) else None

    def meanings(self, views: list[View], i: int, k: int) -> int:
        """A definition list: its first term is views i to k, a mark follows."""
        begin, parts = views[i][0], []
        while True:
            term = [self.stripped(v, 999) for v in views[i:k]]
            parts.append((term[0][0], term[-1][1], term, False))
            while True:
                after = k + (k + 1 < len(views) and self.blank(views[k]))
                m = self.meaning_at(views, after)
                if not m:
                    break
                loose = after > k
                k = after
                pad = self.indent((views[k][0] + m.end(), views[k][1]))
                width = m.end() + (1 if pad > 4 else pad)

                def own(view: View, first: bool, m=m, pad=pad, width=width) -> View | None:
                    if first:
                        return self.stripped((view[0] + m.end(), view[1]), 1 if pad > 4 else pad)
                    return self.stripped(view, width) if self.blank(view) or self.indent(view) >= width else None

                inner, after = self.contained(views, k, own, _MEANING)
                while inner and self.blank(inner[-1]):
                    inner.pop()
                    after -= 1
                parts.append((views[k][0] + m.end() - 1, views[after - 1][1], inner, loose))
                k = after
            # another term may follow, at once or after a blank line
            i = k + (k + 1 < len(views) and self.blank(views[k]))
            more = i
            while more < len(views) and not self.blank(views[more]) and not self.interrupts(views[more]) and not self.meaning_at(views, more):
                more += 1
            if more == i or not self.meaning_at(views, more + (more + 1 < len(views) and self.blank(views[more]))):
                break
            k = more
        self.add(BLOCK, begin, parts[-1][1])
        for start, end, lines, loose in parts:
            self.add(BLOCK, start, end)
            if lines and lines[0][0] == start:
                self.inlines(lines)
            else:
                self.blocks(lines, tight=not loose)
        return k

    def paragraph(self, views: list[View], i: int, tight: bool) -> int:
        k = i
        level = None
        while k < len(views):
            if self.blank(views[k]):
                if k + 1 < len(views) and self.meaning_at(views, k + 1):
                    return self.meanings(views, i, k)
                break
            if k > i and self.meaning_at(views, k):
                return self.meanings(views, i, k)
            if k > i:
                m = _SETEXT.match(self.line(views[k]))
                if m and self.indent(views[k]) < 4:
                    level = 1 if m[1][0] == "=" else 2
                    k += 1
                    break
                if self.interrupts(views[k]):
                    break
                if k + 1 < len(views) and self.table_at(views, k):
                    break
            k += 1
        lines = [self.stripped(v, 999) for v in views[i : k - 1 if level else k]]
        lines = self.define(lines)
        if not lines:
            if level:
                return self.paragraph(views, k - 1, tight) if not self.blank(views[k - 1]) else k
            return k
        start = lines[0][0]
        end = views[k - 1][1]
        if level:
            self.add(heading(level), start, end)
        elif not tight:
            self.add(BLOCK, start, end)
        self.inlines(lines)
        return k

    def define(self, lines: list[View]) -> list[View]:
        """Without the link reference definitions at the front, which are kept."""
        while lines and self.text[lines[0][0]] == "[":
            joined = "".join(self.text[s:e] for s, e in lines)
            m = _DEFINITION.match(joined) or _DEFINITION_PLAIN.match(joined)
            if not m or m[1].startswith("^") or not m[1].strip():
                break
            self.definitions.add(" ".join(m[1].split()).casefold())
            used = m.end()
            while lines and used >= lines[0][1] - lines[0][0] > 0:
                used -= lines[0][1] - lines[0][0]
                lines = lines[1:]
            if used and lines:
                break
        return lines

    # inlines

    def inlines(self, lines: list[View]) -> None:
        lines = [v for v in lines if v[1] > v[0]]
        if len(lines) == 1 and (m := _PLAIN.fullmatch(self.text[lines[0][0] : lines[0][1]])):
            # nothing but words: one piece
            self.add(INLINE, lines[0][0], lines[0][0] + m.end(1))
        elif lines:
            self.pending.append(lines)

    def run(self) -> list[Range]:
        self.pending: list[list[View]] = []
        self.containers: list[tuple[list[View], bool]] = []
        views, at = [], 0
        for part in self.text.splitlines(keepends=True) if not re.search("[\x0b\x0c\x1c-\x1e\x85  ]", self.text) else re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$", self.text):
            views.append((at, at + len(part)))
            at += len(part)
        self._blocks(views, False, True)
        while self.containers:
            self._blocks(*self.containers.pop(), False)
        for lines in self.pending:
            _Inlines(self, lines).run()
        return self.found


class _Inlines:
    """The inline elements of one block, whose lines are joined by ``\\n``."""

    def __init__(self, parser: _Parser, lines: list[View]):
        self.parser = parser
        parts, starts = [], []
        for n, (s, e) in enumerate(lines):
            body = parser.text[s:e].rstrip("\r\n")
            parts.append(body if n < len(lines) - 1 else body.rstrip(" \t"))
            starts.append(s)
        self.text = "\n".join(parts)
        if all(s + len(part) + 1 == after for s, part, after in zip(starts, parts, starts[1:])):
            # the lines lie side by side
            self.place: Sequence[int] = range(starts[0], starts[0] + len(self.text) + 1)
        else:
            self.place = [at for s, part in zip(starts, parts) for at in range(s, s + len(part) + 1)]
        self.breaks = {s + len(parser.text[s:e].rstrip("\r\n")): e for s, e in lines}

    def add(self, start: int, end: int, level: int = INLINE) -> None:
        if end > start:
            self.parser.add(level, self.place[start], self.place[end - 1] + 1)

    def run(self) -> None:
        self.scan(0, len(self.text))

    def scan(self, at: int, stop: int) -> None:
        """Elements between two places, then emphasis among what is left."""
        text = self.text
        begin = at
        marks: list[list] = []
        brackets: list[tuple[int, bool]] = []
        pieces: list[tuple[int, int]] = []
        links: list[tuple[int, int]] = []

        def flush(end: int) -> None:
            if end > begin:
                pieces.append((begin, end))

        while at < stop:
            m = _SPECIAL.search(text, at, stop)
            if not m:
                break
            at, c = m.start(), m[0]
            if c == "\n":
                front = text[begin:at]
                spaces = len(front) - len(front.rstrip(" \t"))
                place = self.place[at]
                if spaces >= 2:
                    flush(at - spaces)
                    self.parser.add(INLINE, self.place[at - spaces], self.breaks.get(place, place + 1))
                else:
                    flush(at - spaces)
                    self.parser.add(SOFT_BREAK, place, self.breaks.get(place, place + 1))
                at += 1
                begin = at
            elif c == "\\":
                if at + 1 < stop and text[at + 1] == "\n":
                    flush(at)
                    place = self.place[at + 1]
                    self.parser.add(INLINE, self.place[at], self.breaks.get(place, place + 1))
                    at += 2
                    begin = at
                elif at + 1 < stop and _PUNCTUATION.match(text[at + 1]):
                    flush(at)
                    begin = at + 1
                    at += 2
                else:
                    at += 1
            elif c == "`":
                run = re.compile("`+").match(text, at).end() - at
                close = re.compile(rf"(?<!`)`{{{run}}}(?!`)").search(text, at + run, stop)
                flush(at)
                end = close.end() if close else at + run
                pieces.append((at, end))
                at = begin = end
            elif c == "<":
                link = _AUTOLINK.match(text, at, stop)
                tag = None if link else _INLINE_HTML.match(text, at, stop)
                if link:
                    flush(at)
                    self.add(at, link.end())
                    pieces.append((at + 1, link.end() - 1))
                    at = begin = link.end()
                elif tag:
                    flush(at)
                    pieces.append((at, tag.end()))
                    at = begin = tag.end()
                else:
                    flush(at)
                    pieces.append((at, at + 1))
                    at = begin = at + 1
            elif c == "&":
                m = _ENTITY.match(text, at, stop)
                if m and (m[0][1] == "#" or m[0][1:] in html5):
                    flush(at)
                    pieces.append((at, m.end()))
                    at = begin = m.end()
                else:
                    at += 1
            elif c == "$":
                m = _MATH.match(text, at, stop)
                flush(at)
                if m and m["display"]:
                    self.add(at, m.end(), BLOCK)
                else:
                    pieces.append((at, m.end() if m else at + 1))
                at = begin = m.end() if m else at + 1
            elif c in "![" and (m := _WIKI_LINK.match(text, at, stop)):
                flush(at)
                self.add(at, m.end())
                shown = m.span("target" if m["shown"] is None else "shown")
                if shown[1] > shown[0]:
                    pieces.append(shown)
                at = begin = m.end()
            elif c == "!" and text[at + 1 : at + 2] == "[" and at + 1 < stop:
                flush(at)
                brackets.append((at, len(pieces), len(marks), True))
                pieces.append((at, at + 2))
                at = begin = at + 2
            elif c == "[":
                note = re.compile(r"\[\^[^\]\s]+\]").match(text, at, stop)
                flush(at)
                if note:
                    pieces.append((at, note.end()))
                    at = begin = note.end()
                else:
                    brackets.append((at, len(pieces), len(marks), False))
                    pieces.append((at, at + 1))
                    at = begin = at + 1
            elif c == "]":
                flush(at)
                end = self.link_end(brackets, at, stop)
                if end:
                    opened, n_pieces, n_marks, image = brackets.pop()
                    del pieces[n_pieces]
                    self.emphasis(marks[n_marks:], pieces)
                    del marks[n_marks:]
                    self.add(opened, end)
                    links.append((opened, end))
                    if not image:
                        brackets = [b for b in brackets if b[3]]
                    at = begin = end
                else:
                    if brackets:
                        brackets.pop()
                    pieces.append((at, at + 1))
                    at = begin = at + 1
            elif c in "*_~^":
                run = at
                while run < stop and text[run] == c:
                    run += 1
                opens, closes = self.flanks(at, run, c)
                if (opens or closes) and not (c in "~^" and run - at > 2):
                    flush(at)
                    marks.append([c, at, run, opens, closes, run - at])
                    begin = run
                at = run
            elif c in "'\"":
                flush(at)
                pieces.append((at, at + 1))
                at = begin = at + 1
            elif c == ".":
                if text[at : at + 3] == "..." and at + 3 <= stop:
                    flush(at)
                    pieces.append((at, at + 3))
                    at = begin = at + 3
                else:
                    at += 1
            elif c == "-":
                run = at
                while run < stop and text[run] == "-":
                    run += 1
                if run - at > 1:
                    flush(at)
                    pieces.append((at, run))
                    begin = run
                at = run
            else:
                at += 1
        flush(stop)
        self.emphasis(marks, pieces)
        for s, e in pieces:
            self.add(s, e)

    def link_end(self, brackets: list, at: int, stop: int) -> int | None:
        """The end of the link or image whose text ends at ``at``."""
        if not brackets:
            return None
        opened, _, _, image = brackets[-1]
        label = self.text[opened + (2 if image else 1) : at]
        if m := _LINK_TAIL.match(self.text, at + 1, stop):
            return m.end()
        defined = self.parser.definitions
        if m := _REFERENCE_TAIL.match(self.text, at + 1, stop):
            if " ".join((m[1] or label).split()).casefold() in defined:
                return m.end()
            return None
        return at + 1 if " ".join(label.split()).casefold() in defined else None

    def flanks(self, start: int, end: int, c: str) -> tuple[bool, bool]:
        """Whether a delimiter run may open and may close."""
        before = self.text[start - 1] if start else " "
        after = self.text[end] if end < len(self.text) else " "
        white_a, white_b = is_white(after), is_white(before)
        mark_a, mark_b = _is_punctuation(after), _is_punctuation(before)
        left = not white_a and (not mark_a or white_b or mark_b)
        right = not white_b and (not mark_b or white_a or mark_a)
        if c == "_":
            return left and (not right or mark_b), right and (not left or mark_a)
        return left, right

    def emphasis(self, marks: list[list], pieces: list[tuple[int, int]]) -> None:
        """Pairs delimiter runs; what is left of them is text, mark by mark."""
        k = 0
        # below these places no opener is left for closers of a kind
        bottom: dict[tuple, int] = {}
        while k < len(marks):
            closer = marks[k]
            if not closer[4]:
                k += 1
                continue
            kind = (closer[0], closer[3], closer[5] if closer[0] in "~^" else closer[5] % 3)
            for j in range(k - 1, bottom.get(kind, 0) - 1, -1):
                opener = marks[j]
                if opener[0] != closer[0] or not opener[3] or opener[1] == opener[2]:
                    continue
                if closer[0] in "*_" and (opener[4] or closer[3]) and (opener[5] + closer[5]) % 3 == 0 and (opener[5] % 3 or closer[5] % 3):
                    continue
                if closer[0] in "~^" and opener[5] != closer[5]:
                    continue
                n = closer[5] if closer[0] in "~^" else 2 if min(opener[2] - opener[1], closer[2] - closer[1]) >= 2 else 1
                self.add(opener[2] - n, closer[1] + n)
                opener[2] -= n
                closer[1] += n
                for dead in marks[j + 1 : k]:
                    self.left_over(dead, pieces)
                    dead[1] = dead[2]
                del marks[j + 1 : k]
                k = j + 1
                break
            else:
                bottom[kind] = k
                k += 1
                continue
            if closer[1] == closer[2]:
                k += 1
        for mark in marks:
            self.left_over(mark, pieces)

    @staticmethod
    def left_over(mark: list, pieces: list[tuple[int, int]]) -> None:
        pieces.extend((p, p + 1) for p in range(mark[1], mark[2]))


class MarkdownPlan:
    """Levels as above; sections by ``sections``."""

    trim = INDENTATION

    def parse(self, text: str) -> list[Range]:
        return _Parser(text).run()

    @staticmethod
    def sections(text: str, start: int, ranges: Iterator[Range]) -> Iterator[tuple[int, int]]:
        """Headings stay at the front of what follows; a block takes along the
        white space before it; anything else stands alone."""
        cursor = start
        for level, s, e in ranges:
            if s < cursor:
                continue
            if level > RULE:
                if s > cursor:
                    yield cursor, s
                cursor = s
            elif level == BLOCK and is_white(text[cursor:s]):
                if e > cursor:
                    yield cursor, e
                cursor = e
            else:
                if s > cursor:
                    yield cursor, s
                if e > s:
                    yield s, e
                cursor = e
        if cursor < len(text):
            yield cursor, len(text)
