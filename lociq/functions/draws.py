"""Repeatable random draws from md5, the same in every engine that has md5."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: 15 hex digits make 60 random bits.
SPAN = float(2**60)


def hash_bits(*parts: Column | str | int) -> Column:
    """60 random bits from the ``|``-joined parts, as BIGINT (ints are literals)."""
    text = F.concat_ws("|", *[_text(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """Uniform number in [0, 1)."""
    return hash_bits(*parts) / F.lit(SPAN)


def hash_bits_py(*parts: object) -> int:
    """The same bits inside a Python task."""
    text = "|".join(str(p) for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def uniform_py(*parts: object) -> float:
    """The same draw inside a Python task."""
    return hash_bits_py(*parts) / SPAN


def _text(part: Column | str | int) -> Column:
    if isinstance(part, int):
        return F.lit(str(part))
    return (F.col(part) if isinstance(part, str) else part).cast("string")
