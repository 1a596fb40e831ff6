"""Percentiles by radix selection, exact or within a rank error, from partial histograms that add up.

``radix_percentiles`` is exact and reads the values once per digit. ``daily_digits`` makes a bounded summary per day
that can be kept; ``percentiles_of`` answers from the kept ones of any days, so a new day costs no scan of older ones.

A value becomes an order-preserving integer. A partial histogram counts, per part of the data (a day, a file, a
partition), the values of each digit below the digits already fixed; partials of one level add up by key, whoever
made them. Then each target rank steps into the one digit that holds it, and only values under that digit are
counted on the next level. What is kept and combined is histograms, never values.

Defined results: rank ``ceil(p * n)``, at least 1 (the nearest-rank percentile). Nulls and NaN are not counted. A
group without values has no rows. -0.0 equals 0.0. Percentiles outside 0..1 are clamped to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.functions.names import let, usable_split
from boxloom.runtime import settle

#: Bits per digit: a histogram has at most 256 rows per part, group and open digit.
DIGIT_BITS = 8


def ordered_key(value: Column) -> Column:
    """A double as a bigint with the same order: exponent and fraction as one number, negated below zero.

    Built from arithmetic that is exact in binary floating point.
    """

    def at(x: Column, e: Column) -> Column:
        # two exact scalings instead of one, since 2^1074 is no double
        scaled = (x * F.pow(F.lit(2.0), F.least(-e, F.lit(1000)))) * F.pow(F.lit(2.0), F.lit(52) + F.greatest(-e - 1000, F.lit(0)))
        return (e.cast("bigint") + 1022) * F.lit(1 << 52) + scaled.cast("bigint")

    def exponent(x: Column, guess: Column) -> Column:
        step = F.when(x >= F.pow(F.lit(2.0), guess + 1), 1).when(x < F.pow(F.lit(2.0), guess), -1).otherwise(0)
        return F.least(F.greatest(guess + step, F.lit(-1022)), F.lit(1023))

    def key(x: Column) -> Column:
        guess = F.greatest(F.floor(F.log2(x)), F.lit(-1022))
        magnitude = let(let(guess, lambda g: exponent(x, g)), lambda e: at(x, e))
        return F.when(x == 0, F.lit(0)).when(x == float("inf"), F.lit(0x7FF << 52)).otherwise(magnitude)

    found = let(F.abs(value.cast("double")), key)
    return F.when(value.isNull() | F.isnan(value.cast("double")), None).when(value < 0, -found).otherwise(found)


def value_of(key: Column) -> Column:
    """The double whose ``ordered_key`` is ``key``."""
    m = F.abs(key)
    e = F.shiftright(m, 52)
    low = m - F.greatest(e - 1, F.lit(0)) * F.lit(1 << 52)
    # the fraction first, so that nothing overflows on the way
    x = low.cast("double") * F.lit(2.0**-52) * F.pow(F.lit(2.0), F.greatest(e - 1, F.lit(0)).cast("double") - 1022)
    x = F.when(e >= 0x7FF, F.lit(float("inf"))).otherwise(x)
    return F.when(key < 0, -x).otherwise(x)


def _above(prefix: Column, shift: int, bits: int) -> Column:
    """The digits above the last one of a prefix; all signs and exponents share the empty prefix."""
    return F.shiftright(prefix, bits) if shift + bits < 64 else F.lit(0).cast("bigint")


def partial_histogram(values: DataFrame, shift: int, bits: int = DIGIT_BITS, open_digits: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """``part, grp, measure, prefix, n``: counts per digit (``prefix`` is the key without its low ``shift`` bits).

    With ``open_digits`` (``keys`` and ``above``, the digits fixed so far) only values under these count. Counting
    is combined on the map side, so hot groups and parts shuffle one row per digit.
    """
    rows, keys = values.withColumn("prefix", F.shiftright("key", shift)), keys or ["grp", "measure"]
    if open_digits is not None:
        digits = open_digits.select(*keys, F.col("above").alias("_above")).distinct()
        rows = rows.withColumn("_above", _above(F.col("prefix"), shift, bits)).join(digits, [*keys, "_above"]).drop("_above")
    return rows.groupBy("part", "grp", "measure", "prefix").agg(F.count(F.lit(1)).alias("n"))


def combine(*partials: DataFrame) -> DataFrame:
    """Partials of one level, from any number of days or jobs, as one histogram ``grp, measure, prefix, n``."""
    out = partials[0]
    for p in partials[1:]:
        out = out.unionByName(p)
    return out.groupBy("grp", "measure", "prefix").agg(F.sum("n").alias("n"))


def step(state: DataFrame, histogram: DataFrame, shift: int, bits: int = DIGIT_BITS) -> DataFrame:
    """Each target moves into the digit that holds its rank.

    ``state`` has ``grp, measure, pct, total, rank`` (within the open digit) and ``above``; after the step ``above``
    has one digit more and ``rank`` counts inside it. A histogram has at most 256 rows per open digit, so the running
    sum of one window stays that small.
    """
    h = histogram.withColumn("above", _above(F.col("prefix"), shift, bits))
    w = Window.partitionBy("grp", "measure", "above").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
    hit = state.join(h, ["grp", "measure", "above"]).filter("rank > before and rank <= upto")
    return hit.select("grp", "measure", "pct", "total", (F.col("rank") - F.col("before")).alias("rank"), F.col("prefix").alias("above"))


def _levels(values: DataFrame) -> tuple[int, int, int] | None:
    """(bits below the digits that all keys share, lowest bit that any key uses, the shared digits); null without values."""
    m = values.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.bit_or("key").alias("used")).first()
    if m["lo"] is None:
        return None
    top = 64 if m["lo"] < 0 <= m["hi"] else (m["lo"] ^ m["hi"]).bit_length()
    used = m["used"] & -m["used"] if m["used"] else 1
    return top, min(top, used.bit_length() - 1), m["lo"] >> top if top < 64 else 0


def _steps(top: int, low: int) -> list[int]:
    """The shifts of the levels from the first differing digit down to the lowest bit in use."""
    return [max(low, s) for s in range(top - DIGIT_BITS, low - DIGIT_BITS, -DIGIT_BITS)]


def radix_percentiles(values: DataFrame, targets: DataFrame) -> DataFrame:
    """``grp, measure, pct, total, key``: the exact nearest-rank percentiles, as keys.

    ``values`` has ``part, grp, measure, key``; ``targets`` has ``measure, pct``. Digits that all keys share and bits
    that no key uses are skipped.
    """
    values = settle(values.filter("key is not null"))
    levels = _levels(values)
    if levels is None:
        return values.sparkSession.createDataFrame([], "grp string, measure string, pct double, total bigint, key bigint")
    top, low, shared = levels
    totals = values.groupBy("grp", "measure").agg(F.count(F.lit(1)).alias("total"))
    wanted = targets.filter("pct is not null").select("measure", "pct").distinct()
    state = settle(totals.join(wanted, "measure").select("grp", "measure", "pct", "total", _rank().alias("rank"), F.lit(shared).cast("bigint").alias("above")))
    for before, shift in zip([top, *_steps(top, low)], _steps(top, low)):
        level = combine(partial_histogram(values, shift, before - shift, state))
        state = settle(step(state, level, shift, before - shift))
    return state.select("grp", "measure", "pct", "total", F.shiftleft("above", low).alias("key"))


def _rank() -> Column:
    p = F.least(F.greatest(F.col("pct"), F.lit(0.0)), F.lit(1.0))
    return F.greatest(F.lit(1), F.ceil(p * F.col("total") - 1e-9)).cast("bigint")


def daily_digits(values: DataFrame, error: float) -> DataFrame:
    """``part, grp, measure, lo, hi, n`` (no part, group or measure null): per part a summary that can be kept and combined with those of other parts.

    It is the tree of digits of the part's keys, in which a digit is opened only if it holds more than ``error`` of the
    part's values, or else is told as one interval of keys. The intervals of a part don't overlap and each one that was
    not opened to the end holds at most ``error`` of its values, so over any set of parts a rank is known to within
    ``error`` of all values. Its size depends on the error and not on the number of values: at most 256 / ``error``
    intervals per level.
    """
    values = settle(values.filter("key is not null"))
    levels, keys = _levels(values), ["part", "grp", "measure"]
    if levels is None:
        return values.sparkSession.createDataFrame([], "part date, grp string, measure string, lo bigint, hi bigint, n bigint")
    top, low, shared = levels
    limit = values.groupBy(*keys).agg((F.count(F.lit(1)) * error).alias("most"))
    open_, done = limit.select(*keys, F.lit(shared).cast("bigint").alias("above")), []
    if top == low:
        done.append(values.groupBy(*keys, F.col("key").alias("lo"), F.col("key").alias("hi")).agg(F.count(F.lit(1)).alias("n")))
    for before, shift in zip([top, *_steps(top, low)], _steps(top, low)):
        level = settle(partial_histogram(values, shift, before - shift, open_, keys).join(limit, keys))
        last = (F.col("n") <= F.col("most")) | F.lit(shift == low)
        lo = F.shiftleft("prefix", shift)
        # bits below the lowest one in use are 0 in every key
        done.append(level.filter(last).select(*keys, lo.alias("lo"), (lo + F.lit((1 << shift) - (1 << low))).alias("hi"), "n"))
        open_ = level.filter(~last).select(*keys, F.col("prefix").alias("above"))
    return reduce(DataFrame.unionByName, done)


def percentiles_of(digits: DataFrame, targets: DataFrame) -> DataFrame:
    """``grp, measure, pct, total, lo, hi, rank_error`` from kept summaries of any parts: the percentile lies in ``lo``..``hi`` (keys).

    With all values of an interval at its end the rank is reached at ``hi``, with all at its start at ``lo``. For each
    part one interval at most reaches across a key, so the rank of any key between the two is off by at most
    ``rank_error``, a share of the values that is no more than the error of the summaries. Parts are added up by interval
    first, so all this works on a bounded number of rows per group.
    """
    merged = settle(digits.groupBy("grp", "measure", "lo", "hi").agg(F.sum("n").alias("n")))
    totals = merged.groupBy("grp", "measure").agg(F.sum("n").alias("total"))
    asked = settle(totals.join(targets.filter("pct is not null").select("measure", "pct").distinct(), "measure").select("grp", "measure", "pct", "total", _rank().alias("rank")))
    target = ["grp", "measure", "pct", "total", "rank"]

    def reached(end: str) -> DataFrame:
        w = Window.partitionBy("grp", "measure").orderBy(end).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = merged.groupBy("grp", "measure", end).agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w))
        return asked.join(upto, ["grp", "measure"]).filter("upto >= rank").groupBy(*target).agg(F.min(end).alias(end))

    both = reached("lo").join(reached("hi"), target)
    each = both.join(merged.select("grp", "measure", F.col("lo").alias("a"), F.col("hi").alias("b"), "n"), ["grp", "measure"])
    sums = each.groupBy(*target, "lo", "hi").agg(F.sum(F.when(F.col("b") <= F.col("lo"), F.col("n")).otherwise(0)).alias("sure"), F.sum(F.when(F.col("a") < F.col("hi"), F.col("n")).otherwise(0)).alias("maybe"))
    off = F.greatest(F.col("rank") - F.col("sure"), F.col("maybe") + 1 - F.col("rank"), F.lit(0)) / F.col("total")
    return sums.select("grp", "measure", "pct", "total", "lo", "hi", off.alias("rank_error"))


def sizes_by_day(records: DataFrame) -> DataFrame:
    """``part`` (scan day, 0001-01-01 where there is none), ``grp`` (usable split or ``unassigned``), ``measure``, ``key`` (ordered) of image sides from 1 to 12,000 px; a record counts once."""
    once = records.groupBy("record_id").agg(F.max(F.struct("scanned_at", "old_split", "width", "height")).alias("m")).filter("record_id is not null")
    flat = once.select(F.coalesce(F.to_date("m.scanned_at"), F.lit("0001-01-01").cast("date")).alias("part"), F.coalesce(usable_split(F.col("m.old_split")), F.lit("unassigned")).alias("grp"), F.explode(F.create_map(F.lit("width"), "m.width", F.lit("height"), "m.height")).alias("measure", "side"))
    return flat.filter("side between 1 and 12000").select("part", "grp", "measure", ordered_key(F.col("side")).alias("key"))
