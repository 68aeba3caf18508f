"""Position-addressed pseudo-random draws: a draw is a function of (seed, position, purpose).

Nothing is carried from one draw to the next, so any executor can make any draw and a restart
needs only the position.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, position: Column, purpose: str) -> Column:
    """A double in [0, 1), with 52 random bits."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), position.cast("bigint"), F.lit(purpose)), 12)
    return bits / F.lit(float(1 << 52))


def integer(seed: int, position: Column, purpose: str, low: int, high: int) -> Column:
    """An integer in [low, high]."""
    return (F.lit(low) + F.floor(uniform(seed, position, purpose) * (high - low + 1))).cast("int")


def pick(seed: int, position: Column, purpose: str, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), integer(seed, position, purpose, 1, len(values)))
