import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxloom.llm import containers as C
from boxloom.llm import tokens
from tests.test_compaction import bins_of


def least_bins(sizes, capacity):
    """Fewest bins by search."""
    items = sorted((s for s, n in sizes.items() for _ in range(n)), reverse=True)
    best = [len(items)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(items):
            best[0] = len(room)
            return
        for k in sorted(set(room)):
            if k >= items[i]:
                left = list(room)
                left.remove(k)
                go(i + 1, [*left, k - items[i]])
        go(i + 1, [*room, capacity - items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 2), max_size=6))
def test_dominance_keeps_the_optimum(sizes):
    runs, left, placed, fixed = C.dominance_reduction(sizes, 20)
    assert fixed + least_bins(left, 20) == least_bins(sizes, 20)
    assert {s: placed.get(s, 0) + left.get(s, 0) for s in sizes} == sizes


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=25))
def test_plan_places_every_item_once(sizes):
    runs, opened, fixed = C.fill(sizes, 50)
    bins = bins_of(runs)
    assert set(bins) == set(range(opened)) and all(sum(b) <= 50 for b in bins.values())
    for size, n in sizes.items():
        assert sorted(k for r in runs if r.size == size for k in range(r.lo, r.hi)) == list(range(n))


def test_packing_of_texts(spark):
    random.seed(2)
    texts = ["word " * random.randint(0, 60) for _ in range(80)] + [None, "", "x" * 40_000, "tail " * 700, "same text", "same text"]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, container_kind string, capacity int")
    kinds = spark.createDataFrame([("small", 40), ("large", 300)], "container_kind string, capacity_tokens int")
    packed, report = C.pack(docs, kinds)
    rows = packed.collect()
    for kind, capacity in (("small", 40), ("large", 300)):
        mine = [r for r in rows if r["container_kind"] == kind]
        fill = {}
        for r in mine:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
        assert max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))
        for i, t in enumerate(texts):
            n = tokens.count_tokens(t)
            own = sorted((r["first_token"], r["n_tokens"]) for r in mine if r["doc_id"] == i)
            assert sum(k for _, k in own) == n and len(own) == -(-n // capacity)
            assert own == [(a, min(capacity, n - a)) for a in range(0, n, capacity)]
    told = {r["container_kind"]: r for r in report.collect()}
    assert told["small"]["containers"] - told["small"]["least"] <= 1 and told["small"]["fill"] > 0.98


def test_odd_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    kinds = spark.createDataFrame([("small", 40)], "container_kind string, capacity_tokens int")
    assert C.pack(docs, kinds)[0].count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    assert C.pack(one, kinds.limit(0))[0].count() == 0
    with pytest.raises(ValueError):
        C.pack(one, spark.createDataFrame([("bad", 0)], "container_kind string, capacity_tokens int"))


def test_token_counts(spark):
    texts = ["a b", None, "", "<|endoftext|>", "漢字", "x" * 300_000]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(tokens.token_count(F.col("t"))).collect()]
    assert got == [tokens.count_tokens(t) for t in texts] and got[1:3] == [0, 0] and got[3] > 1
