"""Plain text: runs of line breaks, the longer the larger."""

from __future__ import annotations

import re

from textloom.functions.whitespace import ALL
from textloom.plans.ranges import Range, plain_sections

_RUN = re.compile(r"[\r\n]+")


class TextPlan:
    """A run's level is its number of breaks, ``\\r\\n`` counting as one."""

    trim = ALL
    sections = staticmethod(plain_sections)

    def parse(self, text: str) -> list[Range]:
        return [(len(run) - run.count("\r\n"), m.start(), m.end()) for m in _RUN.finditer(text) for run in [m.group()]]
