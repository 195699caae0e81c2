"""Source code: a range for each node of the syntax tree but the root, the
shallower the larger.

Parsers are looked up by name, since grammars don't pickle: "python" is parsed
with the standard library's ``ast`` (statements and expressions, which isn't the
tree that other parsers build); "module:attribute" is imported on the worker and
must be a tree-sitter language, or a function returning one; ``register_parser``
adds a function text -> [(depth, start, end)] in code points.
"""

from __future__ import annotations

import ast
import importlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from textloom.functions.config import LanguageError
from textloom.functions.whitespace import INDENTATION
from textloom.plans.ranges import Range, plain_sections

Parser = Callable[[str], list[tuple[int, int, int]]]
_PARSERS: dict[str, Parser] = {}
_LINE_BREAK = re.compile(r"\r\n?|\n")


def register_parser(name: str, parser: Parser) -> None:
    """Known by ``name`` in this process; on a cluster, register in a module that
    the workers import."""
    _PARSERS[name] = parser


def parse_python(text: str) -> list[tuple[int, int, int]]:
    """Nodes of Python source; none if it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    # the parser's lines end at \n, \r\n and \r only
    begins = [0, *(m.end() for m in _LINE_BREAK.finditer(text)), len(text)]
    is_ascii = text.isascii()
    encoded: dict[int, bytes] = {}

    def at(line: int, column: int) -> int:
        # columns count UTF-8 bytes
        begin, after = begins[line - 1], begins[line]
        if is_ascii:
            return begin + column
        if line not in encoded:
            encoded[line] = text[begin:after].encode()
        octets = encoded[line]
        return begin + (column if len(octets) == after - begin else len(octets[:column].decode(errors="ignore")))

    found = []
    queue: list[tuple[ast.AST, int]] = [(tree, 0)]
    while queue:
        node, depth = queue.pop()
        if depth and getattr(node, "end_lineno", None):
            start = (node.lineno, node.col_offset)
            decorators = getattr(node, "decorator_list", None)
            if decorators:
                start = min(start, *((d.lineno, d.col_offset - 1) for d in decorators))
            found.append((depth, at(*start), at(node.end_lineno, node.end_col_offset)))
        for name in node._fields:
            value = getattr(node, name, None)
            if isinstance(value, list):
                queue.extend([(child, depth + 1) for child in value if isinstance(child, ast.AST)])
            elif isinstance(value, ast.AST):
                queue.append((value, depth + 1))
    return found


@lru_cache(maxsize=16)
def _tree_sitter(name: str) -> Parser:
    module, _, attribute = name.partition(":")
    try:
        import tree_sitter

        language = getattr(importlib.import_module(module), attribute or "language")
        language = tree_sitter.Language(language() if callable(language) else language)
        parser = tree_sitter.Parser(language)
    except (ImportError, AttributeError, ValueError, TypeError) as e:
        raise LanguageError(f"code language {name} can't be used: {e}") from e

    def parse(text: str) -> list[tuple[int, int, int]]:
        data = text.encode("utf-8")
        starts = {b: i for i, b in enumerate(_byte_starts(text))}
        found, queue = [], [(c, 1) for c in parser.parse(data).root_node.children]
        while queue:
            node, depth = queue.pop()
            found.append((depth, starts[node.start_byte], starts[node.end_byte]))
            queue.extend((c, depth + 1) for c in node.children)
        return found

    return parse


def _byte_starts(text: str) -> Iterator[int]:
    at = 0
    for c in text:
        yield at
        at += len(c.encode("utf-8"))
    yield at


def parser_of(language: str) -> Parser:
    if not isinstance(language, str):
        raise TypeError("a code language is given by name")
    if language in _PARSERS:
        return _PARSERS[language]
    if ":" in language or "." in language or language.startswith("tree_sitter"):
        return _tree_sitter(language)
    raise LanguageError(f"no parser is registered for code language {language}")


register_parser("python", parse_python)


class CodePlan:
    """Levels are depths, negated."""

    trim = INDENTATION
    sections = staticmethod(plain_sections)

    def __init__(self, language: str):
        self._parse = parser_of(language)

    def parse(self, text: str) -> list[Range]:
        found = sorted([(start, -end, depth) for depth, start, end in self._parse(text)])
        return [(-depth, start, -end) for start, end, depth in found]
