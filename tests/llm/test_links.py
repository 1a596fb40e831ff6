import random

import pytest
from pyspark.sql import functions as F

from boxloom.llm import links

SCHEMA = "record_id bigint, old_split string, source_id string, capture_group string, component string, g string"


def records(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def brute(rows):
    """Union-find over (id, split, source, group) rows with plain names."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, _, s, g in rows:
        for k in (("s", s), ("g", g)):
            if k[1]:
                parent[find(("r", i))] = find(k)
    return {i: find(("r", i)) for i, *_ in rows}


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_union_find(spark, seed):
    random.seed(seed)
    rows = [(i, random.choice(["train", "valid", "test", None, "?"]), random.choice([None, *[f"s{k}" for k in range(60)]]), random.choice([None, None, *[f"g{k}" for k in range(25)]])) for i in range(150)]
    ties, forest = links.tied(records(spark, rows))
    want = brute(rows)
    got = {r["record_id"]: r["component"] for r in ties.collect()}
    assert len(got) == 150
    for a in range(150):
        for b in range(a):
            assert (want[a] == want[b]) == (got[a] == got[b])
    splits = {}
    for i, s, *_ in rows:
        splits.setdefault(want[i], set()).update({s} & {"train", "valid", "test"})
    assert {r[0] for r in links.torn(ties).collect()} == {i for i in want if len(splits[want[i]]) > 1}
    # a forest has no cycle: each edge joins two trees
    tree = {}

    def find(x):
        while tree.setdefault(x, x) != x:
            x = tree[x]
        return x

    for e in forest.collect():
        assert find(e["a"]) != find(e["b"])
        tree[find(e["a"])] = find(e["b"])


def test_long_chain(spark):
    rows = [(i, "train" if i else "test", f"s{i // 2}", f"g{(i + 1) // 2}") for i in range(200)]
    ties, forest = links.tied(records(spark, rows))
    assert ties.select("component").distinct().count() == 1 and forest.count() == 100
    assert links.torn(ties).count() == 200


def test_odd_rows(spark):
    rows = [(1, "train", None, None), (1, "train", None, None), (2, None, " ", "n/a"), (None, "test", "a", None), (3, "train", "A_jpg", None), (4, "valid", "a", "-")]
    ties, _ = links.tied(records(spark, rows))
    assert {r[0] for r in links.torn(ties).collect()} == {3, 4}
    targets = spark.createDataFrame([("train", 0.7), ("valid", 0.15), ("test", 0.15)], "split_name string, share double")
    dealt = {r["record_id"]: r["new_split"] for r in links.deal(ties, targets).collect()}
    assert set(dealt) == {1, 2, 3, 4} and dealt[3] == dealt[4]
    empty, forest = links.tied(records(spark, []))
    assert empty.count() == 0 and forest.count() == 0 and links.torn(empty).count() == 0 and links.deal(empty, targets).count() == 0
    with pytest.raises(ValueError):
        links.deal(ties, targets.limit(0))


def test_shares_and_togetherness(spark):
    random.seed(5)
    # a third of all rows in one group
    rows = [(i, "train", f"s{i}" if i % 3 else None, "hot" if i < 3000 else random.choice([None, f"g{random.randint(0, 900)}"])) for i in range(9000)]
    ties, _ = links.tied(records(spark, rows))
    targets = spark.createDataFrame([("train", 0.7), ("valid", 0.15), ("test", 0.15)], "split_name string, share double")
    dealt = links.deal(ties, targets).cache()
    assert dealt.count() == 9000 and dealt.groupBy("component").agg(F.count_distinct("new_split").alias("n")).filter("n > 1").isEmpty()
    share = {r["new_split"]: r["n"] / 9000 for r in dealt.groupBy("new_split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(share["train"] - 0.7) < 0.003 and abs(share["valid"] - 0.15) < 0.003
    band = dealt.filter("size_band = 1").groupBy("new_split").count().collect()
    assert len(band) == 3


def test_room_is_carried_on():
    assert links.quotas(1, {"train": 70.0, "valid": 15.0, "test": 15.0}) == {"train": 1, "valid": 0, "test": 0}
    assert sorted(links.quotas(10, {"train": 70.0, "valid": 15.0, "test": 15.0}).items(), key=lambda x: -x[1])[0] == ("train", 7)
    assert links.quotas(3, {"train": -5.0, "valid": 0.0}) in ({"train": 2, "valid": 1}, {"train": 1, "valid": 2})
    assert links.quotas(0, {"train": 1.0}) == {"train": 0}


def test_a_new_day_joins_old_components(spark, tmp_path):
    random.seed(9)
    rows = [(i, "train", random.choice([None, *[f"s{k}" for k in range(90)]]), random.choice([None, *[f"g{k}" for k in range(40)]])) for i in range(160)]
    links.tied(records(spark, rows[:90]), keep=str(tmp_path / "day1"))
    ties, _ = links.tied(records(spark, rows[90:]), known=str(tmp_path / "day1"), keep=str(tmp_path / "day2"))
    want, got = brute(rows), {r["record_id"]: r["component"] for r in ties.collect()}
    assert set(got) == set(range(90, 160))
    for a in got:
        for b in got:
            assert (want[a] == want[b]) == (got[a] == got[b])
    assert spark.read.parquet(str(tmp_path / "day2/forest")).count() >= 1
