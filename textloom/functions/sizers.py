"""Sizers: how long a piece of text is.

A sizer is an object with ``size(str) -> int``.  Those that hold a tokenizer
pickle its JSON, path or name, and build it once per Python process.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from functools import lru_cache
from itertools import accumulate
from typing import Any, Protocol, runtime_checkable


@runtime_checkable
class Sizer(Protocol):
    def size(self, text: str) -> int: ...


@dataclass(frozen=True)
class Characters:
    """Code points."""

    def size(self, text: str) -> int:
        return len(text)


@dataclass(frozen=True)
class Bytes:
    """UTF-8 bytes."""

    def size(self, text: str) -> int:
        return len(text) if text.isascii() else len(text.encode("utf-8"))


#: Runs of what isn't Unicode White_Space (``\\s`` also takes U+001C to U+001F).
WORD = re.compile(r"(?:[^\s]|[\x1c-\x1f])+")


@dataclass(frozen=True)
class Words:
    """Runs of characters that aren't white space."""

    def size(self, text: str) -> int:
        return len(WORD.findall(text))


@dataclass(frozen=True)
class Callback:
    """Any function from text to a size."""

    function: Callable[[str], int]

    def size(self, text: str) -> int:
        return int(self.function(text))


@lru_cache(maxsize=8)
def _hf(source: str, is_path: bool) -> Any:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(source) if is_path else Tokenizer.from_str(source)


@lru_cache(maxsize=8)
def _tiktoken(source: str, pattern: str | None, ranks: bytes | None) -> Any:
    import base64

    import tiktoken

    if pattern is None or ranks is None:
        return tiktoken.encoding_for_model(source)
    table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding(source, pat_str=pattern, mergeable_ranks=table, special_tokens={})


#: The split of byte-level tokenizers.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same where white space stands alone, without looking ahead: searched much faster.
PLAIN_SPLIT = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: BYTE_LEVEL over simple text (``segments.Segments.simple``): ASCII and Latin letters.
_LATIN = "A-Za-zÀ-ÖØ-öø-ſ"
_PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LATIN}]+| ?[0-9]+| ?[^\t-\r {_LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Pieces whose counts a process remembers.
_REMEMBERED = 1 << 18


class _Counts(dict[str, int]):
    """The tokens of pieces, each counted when it is first looked up."""

    def __init__(self, count: Callable[[str], int]):
        self.count = count

    def __missing__(self, piece: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        n = self[piece] = self.count(piece)
        return n


class Pieces:
    """A simple text's pieces, which a byte-level tokenizer encodes each by itself:
    the tokens of a span are those of its pieces, where it cuts none but takes at
    most the space off the first."""

    def __init__(self, text: str, tokens: Callable[[str], int]):
        self.text, self._tokens = text, tokens
        found = _PIECE.findall(text)
        self.ends = array("q", accumulate(map(len, found)))
        self.sums = array("q", accumulate(map(tokens, found), initial=0))

    def tokens(self, start: int, end: int) -> int | None:
        """The tokens of a span; None if it must be encoded to be told."""
        text, ends = self.text, self.ends
        if start >= end or text[start] in _ASCII_SPACE or text[end - 1] in _ASCII_SPACE:
            return None
        last = bisect_left(ends, end)
        if ends[last] != end:
            return None
        first = bisect_right(ends, start)
        begin = ends[first - 1] if first else 0
        if start == begin:
            return self.sums[last + 1] - self.sums[first]
        if start == begin + 1 and text[begin] == " " and text[start] != "'":
            return self._tokens(text[start : ends[first]]) + self.sums[last + 1] - self.sums[first + 1]
        return None


class Encoded:
    """A simple text's tokens, from encoding it once, split by PLAIN_SPLIT. Where letters,
    digits, marks and white space meet, a piece ends and so does a token: the tokens of
    a span between such places are counted by their ends."""

    def __init__(self, text: str, encode: Callable[[str], list[int]], widths: Any):
        import numpy as np

        self.text, self.encode = text, encode
        self.ends, at = array("q", [0]), 0
        while at < len(text):
            cut = _BEFORE_SPACE.search(text, at + _BLOCK)
            block = text[at : cut.end() if cut else len(text)]
            ids: list[int] = []
            begin = 0
            for run in _SPACES.finditer(block):
                # the last one isn't of the run's piece where something follows
                first, last = run.start(), run.end() - (run.end() < len(block))
                ids += encode(block[begin:first]) + encode(block[first:last])
                begin = last
            ids += encode(block[begin:])
            ends = np.cumsum(widths[np.array(ids, dtype=np.int64)])
            if not block.isascii():
                octets = np.frombuffer(block.encode(), dtype=np.uint8)
                ends = np.cumsum((octets & 0xC0) != 0x80)[ends - 1]
            self.ends.frombytes((ends + at).astype("int64").tobytes())
            at += len(block)

    def tokens(self, start: int, end: int) -> int | None:
        """The tokens of a span; None if it must be encoded to be told."""
        text, ends = self.text, self.ends
        if start >= end or text[start] in _ASCII_SPACE or text[end - 1] in _ASCII_SPACE or not self._apart(end):
            return None
        first = 0
        if start and text[start - 1] == " ":
            # the space before goes with the first piece
            if text[start] == "'":
                return None
            begin, start = start, _SAME.match(text, start).end()
            first = len(self.encode(text[begin:start]))
        elif start and text[start - 1] not in _ASCII_SPACE and not self._apart(start):
            return None
        return first + bisect_right(ends, end) - bisect_right(ends, start)

    def _apart(self, at: int) -> bool:
        """Whether a piece surely ends after what isn't white space."""
        text = self.text
        if at == len(text) or text[at] in _ASCII_SPACE:
            return True
        # an apostrophe may go with letters after it
        return _SAME.match(text, at - 1).end() == at and text[at - 1] != "'"


#: Characters that are encoded at a time, up to the next white space.
_BLOCK = 1 << 16
_SPACES = re.compile(r"[\t-\r ]{2,}")
_BEFORE_SPACE = re.compile(r"[^\t-\r ](?=[\t-\r ])")
#: Characters of one kind.
_SAME = re.compile(rf"[{_LATIN}]+|[0-9]+|[^\t-\r {_LATIN}0-9]+")
_ASCII_SPACE = frozenset("\t\n\x0b\x0c\r ")
_KNOWN: dict[Any, _Counts] = {}


@lru_cache(maxsize=8)
def _byte_level(source: str, is_path: bool) -> tuple[str, ...] | None:
    """The added tokens of a tokenizer that splits by BYTE_LEVEL and does nothing but
    that and merging; None for others."""
    import json

    made = json.loads(_hf(source, is_path).to_str())
    split, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    merging = model.get("type") == "BPE" and not model.get("dropout") and not any(made.get(k) for k in ("normalizer", "truncation", "padding"))
    return tuple(t["content"] for t in made.get("added_tokens") or ()) if plain and merging else None


class _Tokenizing:
    """Keeps its tokenizer, its known pieces and what it splits by at hand, and leaves
    them behind when it is sent: looking a source of megabytes up compares it whole."""

    def __getstate__(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def _kept(self, name: str, make: Callable[[], Any]) -> Any:
        try:
            return self.__dict__[name]
        except KeyError:
            object.__setattr__(self, name, make())
            return self.__dict__[name]

    def _tokens_of(self) -> Callable[[str], int]:
        """Looks pieces up; those that are known without a step of Python."""
        return self._kept("_lookup", lambda: _KNOWN.setdefault(self, _Counts(self.size)).__getitem__)


@dataclass(frozen=True)
class HuggingFace(_Tokenizing):
    """Tokens of a tokenizer given as JSON or by the path of its file.

    Special tokens that the tokenizer would add aren't counted, nor is padding;
    what truncation cuts off is.
    """

    source: str
    is_path: bool = False

    def size(self, text: str) -> int:
        tokenizer = self._kept("_tokenizer", lambda: _hf(self.source, self.is_path))
        pad = (tokenizer.padding or {}).get("pad_id")
        return _unpadded(tokenizer.encode(text, add_special_tokens=False), pad)

    def pieces(self, text: str) -> Pieces | None:
        """Of simple text; None where a tokenizer's pieces aren't known."""
        added = self._kept("_added", lambda: _byte_level(self.source, self.is_path))
        if added is None or any(a in text for a in added):
            return None
        return Pieces(text, self._tokens_of())


def _unpadded(encoding: Any, pad: int | None) -> int:
    ids = encoding.ids
    if pad is not None:
        first = next((i for i, x in enumerate(ids) if x != pad), len(ids))
        last = next((i for i in range(first, len(ids)) if ids[i] == pad), len(ids))
        ids = ids[first:last]
    return len(ids) + sum(_unpadded(e, pad) for e in encoding.overflowing)


@dataclass(frozen=True)
class Tiktoken(_Tokenizing):
    """Tokens of a tiktoken model, or of a rank file with its split pattern.

    A file is read here, once, and its content sent along to the workers.  Special
    strings in the text are ordinary text.
    """

    source: str
    pattern: str | None = None
    ranks: bytes | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if self.pattern is not None and self.ranks is None:
            with open(self.source, "rb") as f:
                object.__setattr__(self, "ranks", f.read())

    def size(self, text: str) -> int:
        return len(self._kept("_tokenizer", lambda: _tiktoken(self.source, self.pattern, self.ranks)).encode_ordinary(text))

    def pieces(self, text: str) -> Encoded | None:
        """Of simple text; None where a tokenizer's pieces aren't known."""
        if self.pattern != BYTE_LEVEL:
            return None
        plain = self._kept("_plain", lambda: _tiktoken(self.source, PLAIN_SPLIT, self.ranks))
        return Encoded(text, plain.encode_ordinary, self._kept("_token_widths", lambda: _widths(plain)))


def _widths(encoding: Any) -> Any:
    """Each token's bytes."""
    import numpy as np

    found = np.zeros(encoding.n_vocab, dtype=np.int64)
    for token in encoding.token_byte_values():
        found[encoding.encode_single_token(token)] = len(token)
    return found


def sizer_of(value: Any) -> Any:
    """A sizer, or a function made into one."""
    return value if hasattr(value, "size") else Callback(value)
