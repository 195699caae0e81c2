"""Token ids of whole texts, exactly as the tokenizer's library gives them.

``encoder(path)`` builds, once per Python worker, an encoder for a ``.json``
(tokenizers) or ``.model`` (sentencepiece) file.  Where the tokenizer lowers
case, drops white space and splits at it, a text's ids are the ids of its
white-space-free words in order, so words are encoded once and remembered; the
memory is bounded (``MEMO_WORDS``) and only saves time.  Any other tokenizer,
and any text that holds a special string, goes through the library whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

#: Entries of the word memo: frequent words settle in ``_kept``, later ones
#: pass through ``_recent``, which is emptied when full.
MEMO_WORDS = 125_000
RECENT_WORDS = 25_000
MEMO_PIECES = 100_000

#: The configuration under which words can be encoded alone.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same for lower-cased ASCII.
ASCII_PATTERN = rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
WORD_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]

#: Last code point up to which str.lower() and the library's rule were compared.
LATIN_END = "ɏ"


def file_digest(path: str) -> str:
    """Digest of a tokenizer file: its version in the count cache."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def splits_at_white_space(spec: dict) -> bool:
    """Whether each word's ids depend on that word alone."""
    normalizer, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers") or [{}]
    return (
        normalizer.get("normalizers") == WORD_NORMALIZERS
        and len(steps) == 2
        and steps[0].get("type") == "Split"
        and steps[0].get("pattern") == {"Regex": WORD_PATTERN}
        and steps[0].get("behavior") == "Removed"
        and steps[0].get("invert") is True
        and steps[1].get("type") == "ByteLevel"
        and not steps[1].get("add_prefix_space")
        and not steps[1].get("use_regex")
        and (spec.get("model") or {}).get("type") == "BPE"
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens") or [])
    )


def byte_table() -> dict[int, int]:
    """Byte -> the printable character by which byte-level models name it."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


class LibraryEncoder:
    """Whole texts through the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()

    def whole(self, text: bytes) -> bytes:
        ids = self.tok.encode(text.decode("utf-8"), add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of one UTF-8 text."""
        return self.whole(text)

    def count(self, text: bytes) -> int:
        return len(self.ids(text)) // 4


class PieceEncoder(LibraryEncoder):
    """Whole texts through the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        self.tok = sentencepiece.SentencePieceProcessor(model_file=path)

    def whole(self, text: bytes) -> bytes:
        return np.asarray(self.tok.encode(text.decode("utf-8")), dtype="<u4").tobytes()


class WordEncoder(LibraryEncoder):
    """The same ids, word by word, each word encoded once while remembered."""

    def __init__(self, path: str, spec: dict):
        import regex

        super().__init__(path)
        self.special = [t["content"].lower().encode() for t in spec.get("added_tokens") or []]
        self.mark = b"<" if self.special and all(s[:1] == b"<" for s in self.special) else b""
        self.pieces = regex.compile(WORD_PATTERN).findall
        self.ascii_pieces = re.compile(ASCII_PATTERN).findall
        self.bytes_to_chars = byte_table()
        self.tokenize = self.tok.model.tokenize
        self._kept: dict[bytes, bytes] = {}
        self._recent: dict[bytes, bytes] = {}
        self._pieces: dict[bytes, bytes] = {}

    def piece(self, piece: bytes) -> bytes:
        """The ids of one piece, lower-cased."""
        ids = self._pieces.get(piece)
        if ids is None:
            text = piece.decode("utf-8")
            shown = text if piece.isascii() and text.isprintable() else piece.decode("latin-1").translate(self.bytes_to_chars)
            ids = array("I", [t.id for t in self.tokenize(shown)]).tobytes()
            if len(self._pieces) > MEMO_PIECES:
                self._pieces.clear()
            self._pieces[piece] = ids
        return ids

    def word(self, word: bytes) -> bytes:
        if word.isascii():
            low = word.lower()
            return self.piece(low) if low.isalpha() else b"".join(map(self.piece, self.ascii_pieces(low)))
        text = unicodedata.normalize("NFC", word.decode("utf-8"))
        if max(text) > LATIN_END or "İ" in text:
            return self.whole(word)
        text = text.lower()
        return self.piece(text.encode()) if text.isalpha() else b"".join([self.piece(p.encode()) for p in self.pieces(text)])

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        kept, recent = self._kept, self._recent
        if len(recent) > RECENT_WORDS:
            recent.clear()
        out = {}
        for w in words:
            ids = recent.get(w)
            if ids is None:
                ids = self.word(w)
                (kept if len(kept) < MEMO_WORDS else recent)[w] = ids
            elif len(kept) < MEMO_WORDS + RECENT_WORDS:
                kept[w] = ids  # seen again
            out[w] = ids
        return out

    def parts(self, text: bytes) -> list[bytes]:
        """The ids of each word of ``text``, in order."""
        if self.mark in text and any(s in text.lower() for s in self.special):
            return [self.whole(text)]
        # lower-casing A-Z beforehand makes words alike, but could part a letter from its mark
        words = text.lower().split() if text.isascii() else text.split()
        found = list(map(self._kept.get, words))
        if None in found:
            more = self.learn({w for w, ids in zip(words, found) if ids is None})
            found = [more[w] if ids is None else ids for w, ids in zip(words, found)]
        return found

    def ids(self, text: bytes) -> bytes:
        return b"".join(self.parts(text))


@lru_cache(maxsize=4)
def encoder(path: str) -> LibraryEncoder:
    """The encoder of a tokenizer file, one per process."""
    if path.endswith(".model"):
        return PieceEncoder(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return WordEncoder(path, spec) if splits_at_white_space(spec) else LibraryEncoder(path)
