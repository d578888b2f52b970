"""Draws by digests of keys: the same on any partitioning and on every run."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*key) -> float:
    """A number in (0, 1), by the key's digest."""
    return (int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def drawn(*key) -> Column:
    """draw() of literals and columns, by row."""
    text = F.concat_ws(":", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32
