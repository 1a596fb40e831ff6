"""Running numbers over a whole table in an order, without sorting it in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.operators.ranking import ordered_rank


def running_ids(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Adds ``name``: ``start``, ``start + 1``, ... along ``order``, which must tell rows apart."""
    return ordered_rank(df, [], [F.col(c) for c in order], name).withColumn(name, F.col(name) + start)
