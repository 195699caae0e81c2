"""Pieces of chunking that Catalyst can do alone: no Python on the way.

White space is the Unicode property White_Space throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\p{IsWhite_Space}"


def size_characters(text: Column) -> Column:
    """Code points."""
    return F.char_length(text)


def size_bytes(text: Column) -> Column:
    """UTF-8 bytes."""
    return F.octet_length(text)


def size_words(text: Column) -> Column:
    """Runs of characters that aren't white space."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"[^{_SPACE}]+"), F.lit(0)))


def fits(size: Column, desired: int, most: int) -> Column:
    """-1 below the desired size, 1 above the largest, else 0."""
    return F.when(size < desired, -1).when(size > most, 1).otherwise(0)


def trim_all(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"^{_SPACE}+", ""), rf"{_SPACE}+\z", "")


def trim_indentation(text: Column) -> Column:
    """White space goes at the end; at the start, of a text of several lines, only
    line breaks do."""
    whole = trim_all(text)
    several = F.regexp_replace(F.regexp_replace(text, r"^[\r\n]+", ""), rf"{_SPACE}+\z", "")
    return F.when(whole.rlike(r"[\r\n]"), several).otherwise(whole)


def is_white(text: Column) -> Column:
    return text.rlike(rf"\A{_SPACE}*\z")


def newline_runs(text: Column) -> Column:
    """The runs of line breaks, in order, as strings."""
    return F.regexp_extract_all(text, F.lit(r"[\r\n]+"), F.lit(0))


def run_level(run: Column) -> Column:
    """How many breaks a run has, ``\\r\\n`` being one."""
    return F.char_length(F.regexp_replace(run, r"\r\n", "\n"))


def graphemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def fixed_windows(text: Column, size: int, step: int | None = None) -> Column:
    """Windows of ``size`` code points, ``step`` apart, until one reaches the end."""
    step = step or size
    n = F.char_length(text)
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.substr(text, i * step + 1, F.lit(size)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def has_bare_lines(text: Column) -> Column:
    """Whether some line is empty, or begins or ends with white space."""
    return text.rlike(rf"\A(?:{_SPACE}|\z)|{_SPACE}\n|\n{_SPACE}|{_SPACE}\z|\r")


def packed_lines(text: Column, size: int) -> Column:
    """The lines joined greedily, untrimmed, as far as ``size`` code points hold; a
    longer line stays alone."""

    def add(state: Column, line: Column) -> Column:
        more = F.concat(state["last"], F.lit("\n"), line)
        fits = F.char_length(more) <= size
        done = F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["last"])))
        return F.struct(done.alias("done"), F.when(fits, more).otherwise(line).alias("last"))

    lines = F.split(text, "\n")
    first = F.struct(F.array().cast("array<string>").alias("done"), F.element_at(lines, 1).alias("last"))
    return F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), first, add, lambda s: F.concat(s["done"], F.array(s["last"])))
