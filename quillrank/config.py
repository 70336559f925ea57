"""Scoring methods and their parameters."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from .errors import InvalidParameter

METHODS = ("robertson", "lucene", "atire", "bm25l", "bm25plus")
_LABELS = {"robertson": "Robertson", "lucene": "Lucene", "atire": "ATIRE", "bm25l": "BM25L", "bm25plus": "BM25+"}


def parse_method(name: str) -> str:
    """The method's name in ``METHODS``, whatever its case; "bm25+" is "bm25plus"."""
    clean = name.strip().lower().replace("+", "plus")
    if clean not in METHODS:
        raise InvalidParameter(f"unknown scoring method {name!r}; known are {', '.join(METHODS)}")
    return clean


def single(x: float) -> float:
    """``x`` as the nearest single-precision number, which is how parameters are held."""
    return struct.unpack("f", struct.pack("f", x))[0]


@dataclass(frozen=True)
class Params:
    """k1 and b of any method; delta counts for bm25l and bm25plus only."""

    method: str = "lucene"
    k1: float = 1.5
    b: float = 0.75
    delta: float = 0.5

    def __post_init__(self) -> None:
        object.__setattr__(self, "method", parse_method(self.method))
        for name in ("k1", "b", "delta"):
            value = getattr(self, name)
            if value != value:
                raise InvalidParameter(f"{name} is not a number")
            object.__setattr__(self, name, single(value))
        if self.k1 < 0:
            raise InvalidParameter("k1 is negative")
        if not 0 <= self.b <= 1:
            raise InvalidParameter("b is outside 0 to 1")
        if self.delta < 0 and self.method in ("bm25l", "bm25plus"):
            raise InvalidParameter("delta is negative")

    @property
    def label(self) -> str:
        return _LABELS[self.method]


def check_k(k: int) -> int:
    if k < 1:
        raise InvalidParameter("k must be at least 1")
    return k
