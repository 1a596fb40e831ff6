import itertools
import random

import pytest
from pyspark.sql import functions as F

from boxloom.llm import overlaps
from tests.llm.test_survivors import audit, rec


def change(thumb, n):
    cells = list(thumb)
    for i in random.sample(range(64), n):
        cells[i] = random.choice([c for c in "0123456789abcdef" if c != cells[i]])
    return "".join(cells)


def brute(rows):
    out = set()
    flat = [(d, *r) for d, rs in rows for r in (rs or [])]
    for da, a, sa, _, _, la, _, ta, *_ in flat:
        for db, b, sb, _, _, lb, _, tb, *_ in flat:
            if sa != "train" or sb not in ("valid", "test"):
                continue
            near = ta and tb and sum(x != y for x, y in zip(ta.lower(), tb.lower())) <= 8 and agree(la, lb)
            if da == db or near:
                out.add((min(a, b), max(a, b)))
    return out


def parse(s):
    if s is None:
        return None
    try:
        return [tuple(map(float, line.split()[1:])) for line in s.split("\n") if line.strip()]
    except ValueError:
        return None


def agree(a, b):
    a, b = parse(a), parse(b)
    if a is None or b is None or any(len(x) != 4 for x in a + b):
        return False
    return overlaps.pair_off([dict(zip("xywh", x)) for x in a], [dict(zip("xywh", x)) for x in b])


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    random.seed(seed)
    base = ["".join(random.choice("0123456789abcdef") for _ in range(64)) for _ in range(12)] + ["0" * 64]
    label = ["", "0 .5 .5 .1 .1", "0 .505 .5 .1 .1", "0 .5 .5 .1 .1\n0 .2 .2 .1 .1", "0 .2 .2 .1 .1\n0 .51 .5 .1 .1", "bad", None, "0 .1 .1 .1 .1"]
    rows = []
    for i in range(140):
        d = f"{random.randint(0, 110):064x}"
        t = change(random.choice(base), random.choice([0, 0, 4, 7, 8, 9, 12]))
        rows.append((d, [rec(i, random.choice(["train", "train", "valid", "test", "none"]), random.choice(label), thumb=random.choice([t, t.upper(), None]) if random.random() < 0.2 else t)]))
    rows += [rows[3], (None, None), ("x", [])]
    got = {tuple(r) for r in overlaps.overlap_pairs(audit(spark, rows)).collect()}
    assert got == brute(rows)
    report = overlaps.overlap_report(audit(spark, rows)).collect()
    held = {r[0] for _, rs in rows for r in (rs or []) if r[1] in ("valid", "test")}
    assert sum(r["records"] for r in report) == len(held)
    assert sum(r["overlapping"] for r in report) == len({x for p in got for x in p} & held)


def test_pairing_needs_a_search():
    # the first box fits both, the second only one: greedy pairing would fail
    a = [dict(x=0.5, y=0.5, w=0.1, h=0.1), dict(x=0.508, y=0.5, w=0.1, h=0.1)]
    b = [dict(x=0.499, y=0.5, w=0.1, h=0.1), dict(x=0.507, y=0.5, w=0.1, h=0.1)]
    ask = overlaps.pair_off
    assert ask(a, b) and ask(a, b[::-1]) and ask([], []) and not ask(a, b[:1])
    assert ask([dict(x=0.52, y=0.5, w=0.1, h=0.1)], [dict(x=0.53, y=0.51, w=0.11, h=0.09)])
    random.seed(3)
    for _ in range(300):
        n = random.randint(1, 5)
        x = [dict(x=random.choice([0, 0.008, 0.016, 0.024]), y=0, w=0, h=0) for _ in range(n)]
        y = [dict(x=random.choice([0, 0.008, 0.016, 0.024]), y=0, w=0, h=0) for _ in range(n)]
        want = any(all(abs(p["x"] - q["x"]) <= 0.01 for p, q in zip(x, perm)) for perm in itertools.permutations(y))
        assert ask(x, y) == want


def ready_of(spark, rows):
    vecs, _ = overlaps.vectors(overlaps.split_records(audit(spark, rows)))
    n = F.size("boxes")
    return overlaps._weighed(vecs).select("vid", "in_train", "in_eval", "terms", n.alias("boxes_n"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"), *overlaps._halves())


def test_bound_of_the_index():
    # nine of twelve terms are indexed, and what is left can't make the least product
    order = sorted(overlaps.BLOCKS)
    assert sum(overlaps.BLOCKS) == 64 and sum(order[-3:]) < overlaps.LEAST_DOT <= sum(order[:4])


@pytest.mark.parametrize("seed", range(2))
def test_long_lists_are_split_and_lose_nothing(spark, seed):
    # images without boxes whose upper halves are plain: any two share a few blocks, hardly any qualify
    random.seed(seed)
    base = ["".join(random.choice("ab") * n for n in overlaps.BLOCKS[:6]) + "".join(random.choice("01234567") for _ in range(32)) for _ in range(60)]
    rows = [(f"{i:064x}", [rec(i, random.choice(["train", "test"]), "", thumb=change(random.choice(base)[:64], random.choice([0, 3, 8])))]) for i in range(240)]
    ready = ready_of(spark, rows).cache()
    near = lambda df: {tuple(r) for r in df.collect()}
    few, all_ = near(overlaps.candidates(ready, 5)), near(overlaps.candidates(ready, 10_000))
    assert few < all_ and len(few) < 0.7 * len(all_)
    cells = {r["record_id"]: r for r in overlaps.split_records(audit(spark, rows)).collect()}
    want = {(a, b) for a in cells for b in cells if cells[a]["split"] == "train" and cells[b]["split"] == "test" and sum(x != y for x, y in zip(cells[a]["thumb"].hex(), cells[b]["thumb"].hex())) <= 8}
    firsts = {}
    for r in sorted(cells):
        firsts.setdefault(bytes(cells[r]["thumb"]), r)
    assert {(firsts[bytes(cells[a]["thumb"])], firsts[bytes(cells[b]["thumb"])]) for a, b in want} <= few


def test_crowded_images_pair_off(spark):
    random.seed(6)
    box = lambda x: (x, 0.5, 0.1, 0.1)
    rows, want = [], {}
    for i in range(200):
        n = random.randint(0, 4)
        a, b = ([box(random.choice([0.0, 0.008, 0.016, 0.024])) for _ in range(n)] for _ in range(2))
        rows.append((i, i, sorted(a), sorted(b)))
        want[i] = overlaps.pair_off([dict(zip("xywh", p)) for p in a], [dict(zip("xywh", p)) for p in b])
    kind = "array<struct<x:double,y:double,w:double,h:double>>"
    got = {r[0] for r in overlaps.boxes_agree(spark.createDataFrame(rows, f"vid_train bigint, vid_eval bigint, boxes_a {kind}, boxes_b {kind}")).collect()}
    assert got == {i for i, yes in want.items() if yes}


def test_empty(spark):
    assert overlaps.overlap_pairs(audit(spark, [])).count() == 0 and overlaps.overlap_report(audit(spark, [])).count() == 0
