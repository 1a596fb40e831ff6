import datetime
import random

import pytest

from boxloom.llm import audits, survivors

RECORD = "struct<record_id:bigint,old_split:string,image:string,label:string,label_signature:string,source_id:string,thumb_sig:string,reviewer:string,reviewed_at:timestamp_ntz>"
SCHEMA = f"audit_id bigint, image_sha256 string, records array<{RECORD}>, digest string, mask int"
DAY = datetime.datetime(2025, 1, 1)


def rec(i, split="train", sig="", reviewer=None, day=None, source="s", thumb=None):
    return (i, split, "i", "l", sig, source, thumb, reviewer, None if day is None else DAY + datetime.timedelta(days=day))


def audit(spark, rows):
    return spark.createDataFrame([(i, d, r, "clash", 1) for i, (d, r) in enumerate(rows)], SCHEMA)


def trusts(spark, rows=(("a", 3), ("b", 2), ("c", 1), ("b", 1), (None, 9))):
    return spark.createDataFrame(list(rows), "reviewer string, trust int")


H = "ab" * 32


def found(spark, rows):
    return {tuple(r) for r in survivors.outstanding(survivors.copies(audit(spark, rows), trusts(spark))).collect()}


def test_cases(spark):
    # more trusted and later than the other: a case for both fields
    assert found(spark, [(H, [rec(1, reviewer="a", day=5), rec(2, reviewer="b", day=3)])]) == {(1, "label_signature", 1), (1, "old_split", 1)}
    # more trusted but earlier: none
    assert found(spark, [(H, [rec(1, reviewer="a", day=1), rec(2, reviewer="b", day=3)])]) == set()
    # equals: none; only one usable: that one
    assert found(spark, [(H, [rec(1, reviewer="a", day=1), rec(2, reviewer="a", day=1)])]) == set()
    assert found(spark, [(H, [rec(1, "?", "x", "c", 0), rec(2, "test", None, "a", 9)])]) == {(1, "old_split", 2)}
    # a cut digest, other notations, rows delivered twice, nulls and a lone record
    rows = [(H.upper(), [rec(1, reviewer="c", day=None)]), (H[:20], [rec(2, reviewer="zz", day=None)]), (H[:20], [rec(2, reviewer="zz", day=None)]), ("cd" * 32, [rec(3)]), (None, [rec(4), rec(5)]), (H, None), (H, [])]
    assert found(spark, rows) == {(1, "label_signature", 1), (1, "old_split", 1)}
    assert found(spark, []) == set()


def test_ambiguous_and_nested_cuts(spark):
    a, b = "1" * 20 + "a" * 44, "1" * 20 + "b" * 44
    told = {r["digest"]: r["whole"] for r in audits.whole_digests(spark.createDataFrame([(x,) for x in (a, b, "1" * 18, "1" * 20 + "a", "2" * 16, "2" * 24, None)], "digest string")).collect()}
    assert told == {"1" * 20 + "a": a, "2" * 16: "2" * 24}


def brute_layers(points):
    """Layers by peeling, and the fill policy, record by record."""
    left, layer, got = list(points), 0, {}

    def beats(q, p):
        ge = bin(q[1]).count("1") >= bin(p[1]).count("1") and q[2] >= p[2] and q[3] >= p[3]
        gt = bin(q[1]).count("1") > bin(p[1]).count("1") or q[2] > p[2] or q[3] > p[3]
        return ge and gt

    while left and len(got) < 2:
        layer += 1
        front = [p for p in left if not any(beats(q, p) for q in left)]
        for bit in (1, 2):
            has = [p for p in front if p[1] & bit]
            if bit not in got and has:
                got[bit] = (max(has, key=lambda p: (p[2], bin(p[1]).count("1"), p[3], -p[0]))[0], layer)
        left = [p for p in left if p not in front]
    return got


@pytest.mark.parametrize("seed,most", [(0, 20_000), (1, 20_000), (2, 3), (3, 2)])
def test_survivors_equal_peeling(spark, seed, most):
    random.seed(seed)
    rows, want = [], {}
    for g in range(12):
        n = random.randint(2, 30 if g == 0 else 9)
        only = random.choice([3, 1, 2, 0])
        points = [(g * 100 + k, random.randint(0, 3) & only, random.randint(0, 3), random.randint(0, 4)) for k in range(n)]
        name = {3: "a", 2: "b", 1: "c", 0: None}
        rows.append((f"{g:064x}", [rec(i, "test" if m & 2 else "?", "" if m & 1 else "bad", name[t], d) for i, m, t, d in points]))
        want[g * 100] = brute_layers(points)
    got = survivors.survivors(survivors.copies(audit(spark, rows), trusts(spark)), most).collect()
    assert len(got) == 12
    for r in got:
        w = want[r["first_record_id"]]
        assert (r["label_signature_from"], r["label_signature_layer"]) == w.get(1, (None, None))
        assert (r["old_split_from"], r["old_split_layer"]) == w.get(2, (None, None))


def test_hot_group(spark):
    random.seed(2)
    rows = [(H, [rec(i, "train", "", random.choice("abc"), random.randint(0, 50)) for i in range(k * 100, k * 100 + 100)]) for k in range(20)]
    best = max((t, d, -i) for _, rs in rows for i, _, _, _, _, _, _, v, at in rs for t, d in [({"a": 3, "b": 2, "c": 1}[v], at)])
    r = survivors.survivors(survivors.copies(audit(spark, rows), trusts(spark))).collect()
    assert len(r) == 1 and r[0]["n_records"] == 2000 and r[0]["old_split_from"] == -best[2]
    # the only split sits below a long chain of later records
    chain = [(H, [rec(i, "test" if i == 0 else "?", "" if i else "bad", "a", i) for i in range(k * 100, k * 100 + 100)]) for k in range(30)]

    def jobs(rows):
        group = survivors.copies(audit(spark, rows), trusts(spark))
        spark.sparkContext.setJobGroup(f"chain{len(rows)}", "")
        out = survivors.survivors(group, 500).collect()
        spark.sparkContext.setJobGroup("", "")
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain{len(rows)}"))

    (deep,), many = jobs(chain)
    assert (deep["old_split_from"], deep["old_split_layer"]) == (0, 3000) and (deep["label_signature_from"], deep["label_signature_layer"]) == (2999, 1)
    (short,), few = jobs(chain[:6])
    assert short["old_split_layer"] == 600 and many <= few + 2
    (flat,), fewest = jobs([(H, [rec(i, "test" if i == 0 else "?", "" if i else "bad", "a", i) for i in range(4)])])
    assert flat["old_split_layer"] == 4 and fewest <= few


def test_survivors_of_nothing(spark):
    assert survivors.survivors(survivors.copies(audit(spark, []), trusts(spark, []))).count() == 0
