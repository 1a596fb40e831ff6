"""Ranks and look-ups that hold for hot keys: no task ever gets more than a bounded share of one key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.runtime import settle


def _matching(keys: list[str], alias: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, alias)], F.lit(True))


def ordered_rank(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank", total: str | None = None) -> DataFrame:
    """Adds ``rank``: 0, 1, 2, ... within each key along ``order``, for keys of any size; ``total``: rows of the key.

    Rows are dealt to ranges of (keys, order), sorted there and numbered by their place in the range, so a hot key is
    spread over as many ranges as it fills and no window ever sees a whole key. What then has to be known is where each
    key begins in each range: a table with a row per key and one more per range. Equal rows of ``order`` are numbered
    in any order.
    """
    along = [*[F.col(k).asc() for k in keys], *order]
    placed = settle(df.repartitionByRange(*along).sortWithinPartitions(*along).withColumn("_at", F.monotonically_increasing_id()))
    alias = [f"_k{i}" for i in range(len(keys))]
    range_of = F.shiftright("_at", 33)
    held = placed.groupBy(*[F.col(k).alias(a) for k, a in zip(keys, alias)], range_of.alias("_range")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    of_key = Window.partitionBy(*alias)
    before = F.coalesce(F.sum("_rows").over(of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(*alias, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(of_key).alias("_all"))
    both = placed.join(starts, _matching(keys, alias) & (range_of == F.col("_range")))
    out = both.withColumn(rank, F.col("_at") + F.col("_shift"))
    return (out.withColumn(total, F.col("_all")) if total else out).drop(*alias, "_range", "_shift", "_all", "_at")


def running(df: DataFrame, keys: list[str], order: list[Column], rank: str, sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None) -> DataFrame:
    """Adds ``rank`` (1, 2, ...), running totals and running maxima (name -> column) within each key along ``order``, the row itself included.

    As in ``ordered_rank`` a key is cut into ranges; windows run inside one range of one key, and what the ranges before
    hold is added.
    """
    sums, maxima = sums or {}, maxima or {}
    along = [*[F.col(k).asc() for k in keys], *order]
    placed = settle(df.repartitionByRange(*along).withColumn("_range", F.spark_partition_id()))
    alias = [f"_k{i}" for i in range(len(keys))]
    whole = [F.sum(c).alias(f"_t_{n}") for n, c in sums.items()] + [F.max(c).alias(f"_m_{n}") for n, c in maxima.items()]
    held = placed.groupBy(*[F.col(k).alias(a) for k, a in zip(keys, alias)], F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_t_"), *whole)
    before = Window.partitionBy(*alias).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    added = [F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in ("", *sums)] + [F.max(f"_m_{n}").over(before).alias(f"_g_{n}") for n in maxima]
    starts = held.select(*alias, "_r", *added)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = {"_i": F.count(F.lit(1)).over(inside)} | {f"_s_{n}": F.sum(c).over(inside) for n, c in sums.items()} | {f"_x_{n}": F.max(c).over(inside) for n, c in maxima.items()}
    both = placed.withColumns(near).join(starts, _matching(keys, alias) & (F.col("_range") == F.col("_r")))
    told = [(F.col(f"_s_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums] + [F.greatest(f"_x_{n}", f"_g_{n}").alias(n) for n in maxima]
    return both.select(*df.columns, (F.col("_i") + F.col("_b_")).alias(rank), *told)


def lookup(big: DataFrame, small: DataFrame, key: str, how: str = "left", rows_per_salt: int = 1_000_000) -> DataFrame:
    """``big`` joined with ``small``, which has each key once, where one key may hold a third of ``big``.

    A key with more than ``rows_per_salt`` rows of ``big`` is split over as many salts as it has such portions, and
    only its row of ``small`` is repeated, once per salt. Null keys match nothing.
    """
    hot = big.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_salt)
    hot = hot.select("_k", F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_salts"))
    left = big.join(hot, F.col(key) == F.col("_k"), "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("_salts", F.lit(1)).cast("long")).cast("int")).drop("_k", "_salts")
    right = small.join(hot, F.col(key) == F.col("_k"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_k", "_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def meet(left: DataFrame, right: DataFrame, key: str, rows_per_portion: int = 100_000) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, which may be hot on both sides; other columns must have different names.

    The rows of a hot key are dealt into portions on either side, and each portion of one side meets each of the other
    in a task of its own, so no task gets more than a portion of both. Null keys match nothing.
    """
    load = lambda df, n: df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_portion).select("_k", F.ceil(F.col("_n") / rows_per_portion).cast("int").alias(n))
    hot = load(left, "_l").join(load(right, "_r"), "_k", "full").select("_k", F.coalesce("_l", F.lit(1)).alias("_l"), F.coalesce("_r", F.lit(1)).alias("_r"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        known = df.join(hot, F.col(key) == F.col("_k"), "left")
        mine = F.pmod(F.monotonically_increasing_id(), F.coalesce(own, F.lit(1)).cast("long")).cast("int")
        return known.withColumn(f"{own}_at", mine).withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("_k", "_l", "_r")

    return dealt(left, "_l", "_r").join(dealt(right, "_r", "_l"), [key, "_l_at", "_r_at"]).drop("_l_at", "_r_at")
