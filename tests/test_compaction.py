import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxloom.operators import compaction as C
from boxloom.operators.packing import best_fit_decreasing, first_fit_decreasing
from boxloom.operators.ranking import lookup, meet, ordered_rank, running


def bins_of(runs):
    out = {}
    for r in runs:
        for k in range(r.lo, r.hi):
            out.setdefault(r.first_bin + (k - r.lo) // r.per_bin, []).append(r.size)
    return out


def slow_fit(sizes, capacity, best):
    room = []
    for s in sorted((s for s, n in sizes.items() for _ in range(n)), reverse=True):
        fits = [i for i, r in enumerate(room) if r >= s]
        if fits:
            i = min(fits, key=lambda i: (room[i], i)) if best else fits[0]
            room[i] -= s
        else:
            room.append(capacity - s)
    return sorted(room)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 12), max_size=12), st.booleans())
def test_packing_equals_item_by_item(sizes, best):
    runs, opened = (best_fit_decreasing if best else first_fit_decreasing)(sizes, 30)
    bins = bins_of(runs)
    assert sorted(s for b in bins.values() for s in b) == sorted(s for s, n in sizes.items() for _ in range(n))
    assert all(sum(b) <= 30 for b in bins.values()) and set(bins) == set(range(opened))
    for size, n in sizes.items():
        assert sorted(k for r in runs if r.size == size for k in range(r.lo, r.hi)) == list(range(n))
    assert sorted(30 - sum(b) for b in bins.values()) == slow_fit(sizes, 30, best)


SCHEMA = "file_id bigint, label string, image string, body string, size_bytes bigint, dataset string, modified_at timestamp_ntz, path string, bin_id int"


def files(spark, rows):
    day = datetime.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, lab, img, body, 0, "d", day + datetime.timedelta(days=i or 0), "clash", 9) for i, lab, img, body in rows], SCHEMA)


ROWS = [
    (1, "d/train/labels/a.txt", None, "0 .1 .1 .1 .1\n0 .2 .2 .1 .1\n"),
    (2, "./d//train/labels/a.txt ", None, "0 .1 .1 .1 .1"),
    (3, None, "d/old/../train/images/a.jpg", "0 .1 .1 .1 .1\n0 .2 .2 .1 .1\n"),
    (4, "d/train/labels/A.txt", None, None),
    (5, None, None, "0 .3 .3 .1 .1"),
    (6, " ", None, "0 .3 .3 .1 .1"),
    (7, "d/train/labels/long.txt", None, "0 .3 .3 .1 .1\n" * 500),
    (8, "d\\train\\labels\\b.txt", "x", ""),
]


def test_pairs_and_choice(spark):
    listed = C.manifest(files(spark, ROWS))
    assert {tuple(r) for r in C.same_file_pairs(listed).collect()} == {(1, 2), (1, 3), (2, 3)}
    kept = {r["file_id"]: r for r in C.resolve_deliveries(listed).collect()}
    assert set(kept) == {3, 4, 5, 6, 7, 8} and kept[3]["deliveries"] == 3 and kept[4]["n_bytes"] == 0
    # without place or id rows are told apart by their bodies
    odd = C.resolve_deliveries(C.manifest(files(spark, [(None, None, None, "a"), (None, None, None, "b"), (None, None, None, "a"), (9, None, None, "a")]))).collect()
    assert sorted((r["file_id"] or 0, r["deliveries"]) for r in odd) == [(0, 1), (0, 2), (9, 1)]


@pytest.mark.parametrize("size", [64, 4096])
def test_rewrite_is_whole(spark, size):
    rows, report = C.compact(files(spark, ROWS), bin_bytes=size)
    assert {(r["file_id"], r["body"]) for r in rows.collect()} == {(i, body or "") for i, _, _, body in ROWS if i not in (1, 2)}
    assert rows.count() == 6 and rows.agg(F.sum("n_boxes")).first()[0] == 504
    assert report.filter("not (n_files_ok and n_bytes_ok and n_boxes_ok and checksum_ok)").isEmpty()
    full = rows.groupBy("bin_id").agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["b"] <= size or r["n"] == 1 for r in full)


def test_tiny_files_fill_a_bin_of_production_size(spark):
    sizes = spark.range(150_000).select(F.col("id").alias("file_id"), F.when(F.col("id") < 3, 100_000_000 + F.col("id")).when(F.col("id") == 3, 34_000_000).otherwise(F.col("id") % 90).alias("n_bytes"))
    got = C.assign_bins(sizes, 128 << 20).groupBy("bin_id").agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    # three files of 100 MB can't share; the one of 34 MB fits beside one of them, and so does every tiny one
    assert len(got) == 3 and sum(r["n"] for r in got) == 150_000 and all(r["b"] <= 128 << 20 for r in got)
    tiny = C.assign_bins(sizes.filter("file_id > 3"), 128 << 20)
    assert tiny.select("bin_id").distinct().count() == 1
    # a bin of tiny files is filled to its last bytes
    full = C.assign_bins(spark.range(70_000).select(F.col("id").alias("file_id"), F.lit(2000).cast("long").alias("n_bytes")), 128 << 20)
    assert full.groupBy("bin_id").count().orderBy("bin_id").first()["count"] == (128 << 20) // 2000


@pytest.mark.parametrize("room", [1, 64, 65_536, 65_537, 100_000, 300_000])
def test_size_classes_are_few(room):
    bits = C.exact_bits(room)
    step = [1 << max(0, s.bit_length() - bits) for s in range(1, room + 1)]
    rounded = [min(room, -(-s // k) * k) for s, k in enumerate(step, 1)]
    assert all(s <= r < s + k for s, (r, k) in enumerate(zip(rounded, step), 1)) and len(set(rounded)) <= C.SIZE_CLASSES
    assert room > 65_536 or rounded == list(range(1, room + 1))
    assert C.exact_bits(128 << 20) == 13


def test_empty_table(spark):
    rows, report = C.compact(files(spark, []))
    assert rows.count() == 0 and report.count() == 0
    assert C.same_file_pairs(C.manifest(files(spark, []))).count() == 0


def test_bad_copy_is_not_published(spark, monkeypatch, tmp_path):
    target = str(tmp_path / "out")
    real = C._sums
    calls = []

    def sums(df):
        calls.append(1)
        return real(df.filter("file_id <> 7") if len(calls) == 2 else df)

    monkeypatch.setattr(C, "_sums", sums)
    with pytest.raises(ValueError):
        C.compact(files(spark, ROWS), target)
    assert not list(tmp_path.iterdir())


def test_rows_without_id_are_rewritten(spark):
    rows, _ = C.compact(files(spark, [(None, "a.txt", None, "x"), (1, "b.txt", None, "y"), (1, "b.txt", None, "y"), (None, None, None, None)]))
    assert sorted(tuple(r) for r in rows.select("path", "body", "deliveries").fillna("-").collect()) == [("-", "", 1), ("a.txt", "x", 1), ("b.txt", "y", 2)]


def test_ranks_follow_the_order_in_hot_keys_too(spark):
    random.seed(1)
    df = spark.createDataFrame([(i, random.choice(["hot", "hot", "hot", "b", None])) for i in range(2000)], "i int, k string").repartition(7)
    rows = ordered_rank(df, ["k"], [F.desc("i")], "r", "n").collect()
    for k in ("hot", "b", None):
        got = sorted((r["r"], -r["i"]) for r in rows if r["k"] == k)
        assert [r for r, _ in got] == list(range(len(got))) and sorted(got, key=lambda x: x[1]) == got and {r["n"] for r in rows if r["k"] == k} == {len(got)}
    assert len(rows) == 2000 and ordered_rank(df.filter("i < 0"), ["k"], [F.col("i")]).count() == 0
    for r in running(df, ["k"], [F.col("i").asc()], "r", {"s": "i"}, {"m": "i"}).collect():
        before = [x["i"] for x in rows if x["k"] == r["k"] and x["i"] <= r["i"]]
        assert (r["r"], r["s"], r["m"]) == (len(before), sum(before), max(before))


def test_keys_hot_on_both_sides_meet(spark):
    a = spark.range(60).select(F.when(F.col("id") < 50, "hot").when(F.col("id") < 55, "b").alias("k"), F.col("id").alias("x"))
    b = spark.range(40).select(F.when(F.col("id") < 30, "hot").when(F.col("id") < 33, "b").alias("k"), F.col("id").alias("y"))
    got = [tuple(r) for r in meet(a, b, "k", rows_per_portion=7).collect()]
    assert len(got) == len(set(got)) == 50 * 30 + 5 * 3


def test_lookup_of_a_hot_key(spark):
    big = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").when(F.col("id") < 900, F.col("id").cast("string")).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("750", 2), ("none", 3)], "k string, v int")
    assert lookup(big, small, "k", "left", rows_per_salt=50).agg(F.count(F.lit(1)), F.sum("v")).first()[:] == (1000, 702)
    assert lookup(big, small, "k", "inner", rows_per_salt=50).count() == 701
