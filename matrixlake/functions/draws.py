"""Draws that depend on a key alone: the same key gives the same number in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts) -> Column:
    """Text of a draw: the parts joined by colons."""
    return F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def order(*parts) -> Column:
    return F.md5(key(*parts))


def uniform(*parts) -> Column:
    """In [0, 1), with 32 bits."""
    return F.conv(F.substring(order(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
