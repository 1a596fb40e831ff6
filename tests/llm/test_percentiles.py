import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxloom.llm import percentiles as P


def keys(spark, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(P.ordered_key(F.col("v"))).collect()]


def test_keys_keep_the_order(spark):
    random.seed(1)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, 0.1, 1 / 3, 640.0, 2.0**52, 2.0**53 - 1]
    values += [struct.unpack("d", struct.pack("Q", random.getrandbits(64)))[0] for _ in range(3000)]
    values = [v for v in values if not math.isnan(v)]
    got = keys(spark, values)
    bits = np.array(values).view(np.int64)
    want = [int(b) if b >= 0 else -int(b & 0x7FFFFFFFFFFFFFFF) for b in bits]
    assert got == want
    back = [r[0] for r in spark.createDataFrame([(i, k) for i, k in enumerate(got)], "i int, k bigint").orderBy("i").select(P.value_of(F.col("k"))).collect()]
    assert all(a == b for a, b in zip(back, values))


def test_nothing_to_count(spark):
    assert keys(spark, [None, math.nan]) == [None, None]
    values = spark.createDataFrame([], "part date, grp string, measure string, key bigint")
    targets = spark.createDataFrame([("m", 0.5, 0.0)], "measure string, pct double, error double")
    assert P.radix_percentiles(values, targets).count() == 0


@pytest.mark.parametrize("kind", ["wide", "ties", "negative", "one"])
def test_exact_and_bounded(spark, kind):
    rng = np.random.default_rng(4)
    draw = {"wide": lambda n: rng.integers(-(2**62), 2**62, n), "ties": lambda n: rng.choice([640, 640, 640, 1280, 5], n), "negative": lambda n: -rng.integers(1, 9000, n), "one": lambda n: np.full(n, 7)}[kind]
    rows, by = [], {}
    for g, n in (("a", 800), ("b", 37), ("c", 1)):
        for m in ("x", "y"):
            v = draw(n)
            by[g, m] = np.sort(v)
            rows += [(k % 5, g, m, int(x)) for k, x in enumerate(v)]
    values = spark.createDataFrame(rows + [(0, "a", "x", None)], "part int, grp string, measure string, key bigint")
    wanted = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    targets = spark.createDataFrame([(m, p, 0.03) for m in ("x", "y") for p in wanted] + [("x", None, 0.1), ("z", 0.5, 0.1)], "measure string, pct double, error double")
    exact = P.radix_percentiles(values, targets).collect()
    assert len(exact) == 3 * 2 * len(wanted)
    for r in exact:
        s = by[r["grp"], r["measure"]]
        assert r["key"] == s[max(1, math.ceil(r["pct"] * len(s) - 1e-9)) - 1]
    digits = P.daily_digits(values, 0.03).cache()
    # the intervals of a part hold all its values, once
    assert digits.agg(F.sum("n")).first()[0] == len(rows)
    bounded = P.percentiles_of(digits, targets).collect()
    assert len(bounded) == len(exact)
    for r in bounded:
        s = by[r["grp"], r["measure"]]
        rank = max(1, math.ceil(r["pct"] * len(s) - 1e-9))
        assert r["lo"] <= s[rank - 1] <= r["hi"] and r["rank_error"] <= 0.03
        for v in (r["lo"], r["hi"]):
            assert max(np.searchsorted(s, v) + 1 - rank, rank - np.searchsorted(s, v, "right"), 0) <= r["rank_error"] * len(s) + 1e-9


def test_partials_of_days_add_up(spark):
    rows = [(d, "a", "x", (d * 37 + i * 11) % 300) for d in range(4) for i in range(50)]
    values = spark.createDataFrame(rows, "part int, grp string, measure string, key bigint")
    apart = [P.partial_histogram(values.filter(F.col("part") == d), 8) for d in range(4)]
    order = ["grp", "measure", "prefix"]
    assert P.combine(*apart).orderBy(*order).collect() == P.combine(P.partial_histogram(values, 8)).orderBy(*order).collect()


def test_kept_days_equal_all_at_once(spark):
    rng = np.random.default_rng(7)
    rows = [(d, "a", "x", float(v)) for d, n in ((0, 3000), (1, 20), (2, 900)) for v in rng.lognormal(0, 3, n) * (1 if d else -1)]
    values = spark.createDataFrame(rows, "part int, grp string, measure string, v double").withColumn("key", P.ordered_key(F.col("v")))
    targets = spark.createDataFrame([("x", p) for p in (0.01, 0.5, 0.95)], "measure string, pct double")
    kept = [P.daily_digits(values.filter(F.col("part") == d), 0.01) for d in range(3)]
    # days are cut at other digits when they are summed up alone, but the bounds hold all the same
    s = np.sort([r[3] for r in rows])
    for digits in (kept[0].unionByName(kept[1]).unionByName(kept[2]), P.daily_digits(values, 0.01)):
        assert digits.count() < 1500
        for r in P.percentiles_of(digits, targets).withColumn("a", P.value_of(F.col("lo"))).withColumn("b", P.value_of(F.col("hi"))).collect():
            assert r["a"] <= s[max(1, math.ceil(r["pct"] * len(s))) - 1] <= r["b"] and r["rank_error"] <= 0.01


def test_sizes_of_odd_records(spark):
    import datetime

    t = datetime.datetime(2025, 1, 2, 3)
    rows = [(1, "Train", 640, 480, t), (1, "Train", 640, 480, t), (2, "val", 0, 12000, t), (3, None, None, -1, None), (4, "?", 12001, 1, t), (None, "test", 5, 5, t)]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "record_id bigint, old_split string, width int, height int, scanned_at timestamp_ntz, grp string, key int")
    got = {(r["grp"], r["measure"], r["key"]) for r in P.sizes_by_day(df).withColumn("key", P.value_of(F.col("key"))).collect()}
    assert got == {("train", "width", 640), ("train", "height", 480), ("valid", "height", 12000), ("unassigned", "height", 1)}
    assert P.sizes_by_day(df).count() == 4 and P.sizes_by_day(df.limit(0)).count() == 0
