"""How large chunks may be and how they are cut."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from textloom.functions.sizers import Characters

#: Largest size there is: ranges without an upper bound.
UNBOUNDED = 2**64 - 1


# The messages of the two errors below.


class CapacityError(ValueError):
    """A maximum below the desired size."""

    def __init__(self) -> None:
        super().__init__("Max chunk size must be greater than or equal to the desired chunk size")


class OverlapError(ValueError):
    """An overlap that leaves nothing new in a chunk."""

    def __init__(self) -> None:
        super().__init__("The overlap is larger than or equal to the desired chunk capacity")


class LanguageError(ValueError):
    """A code language that can't be used."""


@dataclass(frozen=True)
class Capacity:
    """Chunks of ``desired`` up to ``max`` units of the sizer."""

    desired: int
    max: int | None = None

    def __post_init__(self) -> None:
        if self.desired < 0:
            raise CapacityError
        if self.max is None:
            object.__setattr__(self, "max", self.desired)
        if self.max < self.desired:
            raise CapacityError

    def with_max(self, most: int) -> Capacity:
        return Capacity(self.desired, most)

    def fits(self, size: int) -> int:
        """-1 if there is room for more, 0 if it is within, 1 if it is too large."""
        return -1 if size < self.desired else 1 if size > self.max else 0

    @classmethod
    def of(cls, value: Capacity | int | tuple[int, int] | range | slice) -> Capacity:
        """From a size, an inclusive pair, a half-open ``range`` or a ``slice``
        (open ends: from 0, without bound)."""
        if isinstance(value, Capacity):
            return value
        if isinstance(value, range):
            return cls(value.start, max(value.stop - 1, value.start, 0))
        if isinstance(value, slice):
            low = value.start or 0
            return cls(low, UNBOUNDED if value.stop is None else max(value.stop - 1, low, 0))
        if isinstance(value, tuple):
            return cls(*value)
        return cls(value)

    @classmethod
    def up_to(cls, most: int) -> Capacity:
        """From 0 to ``most``, inclusive."""
        return cls(0, most)


@dataclass(frozen=True)
class ChunkConfig:
    """Capacity, overlap, sizer and whether chunks are trimmed."""

    capacity: Capacity
    overlap: int = 0
    sizer: Any = field(default_factory=Characters)
    trim: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "capacity", Capacity.of(self.capacity))

    def with_overlap(self, overlap: int) -> ChunkConfig:
        if overlap < 0 or overlap >= self.capacity.desired:
            raise OverlapError
        return replace(self, overlap=overlap)

    def with_sizer(self, sizer: Any) -> ChunkConfig:
        return replace(self, sizer=sizer)

    def with_trim(self, trim: bool) -> ChunkConfig:
        return replace(self, trim=trim)
