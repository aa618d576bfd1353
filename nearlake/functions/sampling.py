"""Samples by a hash: the same rows each time, at any share however small."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_sample(share: float, *keys: Column | str, seed: int = 0) -> Column:
    """Whether a row is among the given share of all keys: its hash, as a number from 0 to 2**63, is below it."""
    if share >= 1:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 1) < F.lit(int(share * (1 << 63)))
