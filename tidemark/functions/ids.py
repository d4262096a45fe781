"""Columns of 64-bit post identifiers: 32 bits of seconds, 10 of milliseconds, 8 of counter, 14 of place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIX_MASK = (1 << 22) - 1


def _bits(c: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(c, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def second(c: Column) -> Column:
    return F.shiftrightunsigned(c, 32)


def millisecond(c: Column) -> Column:
    return _bits(c, 22, 10)


def counter(c: Column) -> Column:
    return _bits(c, 14, 8)


def geo(c: Column) -> Column:
    return _bits(c, 0, 14)


def datacenter(c: Column) -> Column:
    return _bits(c, 8, 6)


def worker(c: Column) -> Column:
    return _bits(c, 0, 8)


def suffix(c: Column) -> Column:
    return _bits(c, 0, 22)


def segment(c: Column, first: int, last: int) -> Column:
    """Bits first to last of the low word, counted from its most significant bit."""
    return _bits(c, 31 - last, last - first + 1)


def timestamp(c: Column) -> Column:
    return F.timestamp_seconds(second(c))


def compose(sec: Column, ms: Column, count: Column, place: Column) -> Column:
    long = lambda c: c.cast("long")
    return long(sec) * (1 << 32) + long(ms) * (1 << 22) + long(count) * (1 << 14) + long(place)
