import random

from pyspark.sql import functions as F

from boxloom.llm import mixing as M
from boxloom.llm import tokens

DOCS = "doc_id bigint, text string, source string, copies int, shares double"
GOALS = "source string, target_share double, max_repeats int"


def corpus(spark, seed=1):
    random.seed(seed)
    words = {"a": "red green blue", "b": "one two three", "c": "cat dog bird", "x": "far near wide"}
    rows, i = [], 0
    for name, n, spell in (("a", 200, ["A", " a ", "a"]), ("b", 60, ["b"]), ("c", 25, ["c"]), ("x", 40, ["x"])):
        for _ in range(n):
            i += 1
            rows.append((i, " ".join(random.choice(words[name].split()) for _ in range(random.randint(5, 120))) + f" {i}", random.choice(spell), 7, 0.5))
    rows += [(900 + k, " ".join(random.choice(words["b"].split()) for _ in range(50)) + f" n{k}", None, 7, 0.5) for k in range(10)]
    rows += [(950, None, "a", 7, 0.5), (951, "", "b", 7, 0.5), (952, rows[0][1], "b", 7, 0.5), (953, rows[0][1], None, 7, 0.5)]
    return rows, spark.createDataFrame(rows, DOCS)


def goals(spark, rows=(("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, 6), ("gone", 0.05, 2))):
    return spark.createDataFrame(list(rows), GOALS)


def test_shares_are_met(spark):
    rows, docs = corpus(spark)
    mixed, told = M.mix(docs, goals(spark))
    out = mixed.collect()
    caps = {s: c for s, _, c in told}
    assert all(1 <= r["copies"] <= caps[r["source"] or "b"] for r in out) and len({r["doc_id"] for r in out}) == len(out)
    total = sum(r["n_tokens"] * r["copies"] for r in out)
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        # the texts without source look like b
        got = sum(r["n_tokens"] * r["copies"] for r in out if (r["source"] or "b") == s) / total
        assert abs(got - share / 0.95) < 0.01
    # one text, one holder; its size is that of the tokenizer
    assert not {952, 953, 950, 951} & {r["doc_id"] for r in out}
    text = {i: t for i, t, *_ in rows}
    assert all(tokens.count_tokens(text[r["doc_id"]]) == r["n_tokens"] for r in out)
    report = {r["source"]: r for r in M.shares_reached(mixed, told).collect()}
    # what texts without a source hold is reached by no label, but expected of b
    assert report["gone"]["tokens"] == 0 and abs(sum(r["expected"] for r in report.values()) - 1) < 1e-9
    assert abs(sum(r["reached"] for r in report.values()) + sum(r["n_tokens"] * r["copies"] for r in out if r["source"] is None) / total - 1) < 1e-9
    assert all(abs(report[s]["expected"] - share / 0.95) < 0.01 for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)))


def test_predicted_members_fill_a_shortage(spark):
    _, docs = corpus(spark)
    small, told = M.mix(docs, goals(spark))
    base = M.shares_reached(small, told)
    size = base.agg(F.sum("tokens")).first()[0]
    texts = M.distinct_texts(docs, ["a", "b", "c"])
    guess = {r["doc_id"]: r["shares"] for r in M.posteriors(docs, texts, ["a", "b", "c"]).collect()}
    assert set(guess) == {953, *range(900, 910)} and all(max(range(4), key=lambda k: p[k]) == 1 for i, p in guess.items() if i < 950)
    assert all(abs(sum(p) - 1) < 1e-9 for p in guess.values())
    # they count by default, where b is the source that bounds the mix, and where more is asked for
    for size_of, ask in ((None, [("a", 0.2, 1), ("b", 0.8, 1)]), (size * 1.2, [("a", 0.05, 1), ("b", 0.95, 1)])):
        more, told = M.mix(docs, goals(spark, ask), size=size_of)
        report = {r["source"]: r for r in M.shares_reached(more, told).collect()}
        assert any(r["source"] is None for r in more.collect()) and report["b"]["expected"] > report["b"]["reached"]


def test_memberships_add_up(spark):
    shares = [[0.5, 0.3, 0.2, 0.0], [1 / 3, 1 / 3, 1 / 3, 0.0], [0.99, 0.004, 0.003, 0.003], [0.25, 0.25, 0.25, 0.25]]
    df = spark.createDataFrame([(None, p) for p in shares] + [("b", None)], "source string, soft array<double>")
    got = [r[0] for r in df.select(M._membership(F.col("source"), F.col("soft"), ["a", "b", "c"])).collect()]
    for p, g in zip(shares, got):
        assert len(g) == 3 and all(abs(x - y) <= 1 / 64 for x, y in zip(p, g)) and abs(sum(g) + p[3] - 1) <= 1 / 64
    assert sum(got[1]) == 1 and got[4] == [0.0, 1.0, 0.0]


def test_odd_tables(spark):
    _, docs = corpus(spark)
    assert M.mix(docs.limit(0), goals(spark))[0].count() == 0
    mixed, told = M.mix(docs, goals(spark).limit(0))
    assert mixed.count() == 0 and M.shares_reached(mixed, told).count() == 0
    mixed, _ = M.mix(docs, goals(spark, [("a", None, 2), ("b", 0.4, None), ("c", 1.0, 2), (None, 0.3, 1)]))
    assert {r["source"] for r in mixed.collect()} == {"c"}


def test_rates_stay_in_bounds(spark):
    rows = [([1.0, 0.0], 1, 100), ([0.0, 1.0], 3, 50), ([0.5, 0.5], 1, 80)]
    fitted = M.fit_rates(spark.createDataFrame(rows, "shares array<double>, cap int, tokens bigint"), [130.0, 60.0]).collect()
    rate = {tuple(r["shares"]): r["rate"] for r in fitted}
    assert all(0 <= r["rate"] <= r["cap"] for r in fitted)
    assert abs(100 * rate[1.0, 0.0] + 40 * rate[0.5, 0.5] - 130) < 0.2 and abs(50 * rate[0.0, 1.0] + 40 * rate[0.5, 0.5] - 60) < 0.2
