"""Class numbers of the two common detection catalogues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers 1..91 that no class uses.
UNUSED = (12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91)

LONG = [n for n in range(1, 92) if n not in UNUSED]


def long_to_short(number: Column) -> Column:
    """1..91 with gaps -> 0..79; null for unused numbers."""
    return F.when(number.isin(LONG), number - 1 - sum((F.when(number > u, 1).otherwise(0) for u in UNUSED), F.lit(0)))


def short_to_long(number: Column) -> Column:
    """0..79 -> 1..91 with gaps."""
    return F.get(F.array(*[F.lit(n) for n in LONG]), number.cast("int"))
