import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from boxloom.llm import reading as R


def test_prose_only():
    text = "# Title\nOverview\nThe cat sat on the mat. It ran\nhome fast.\n\n- kite\n- fixed-wing\n* One list meets the light\n\n| a | b |\n|---|---|\n0 0.1 0.2 0.3 0.4\n2025-01-01T10:00 WARN x[1] skipped y\nframe=1;iou=0.1\nnames: ['x']\nnc: 1\nTraceback (most recent call last):\n  File \"a.py\", line 1, in f\n\n```\nThis is code text here now.\n```\n\n1. Capture\n晚上红的车比较小鸟。\n"
    assert R.passages(text) == ["The cat sat on the mat. It ran\nhome fast.", "One list meets the light", "晚上红的车比较小鸟。"]
    assert R.passages("<p>We found&nbsp;36 boxes. All good.</p>\r\n") == ["We found 36 boxes. All good."]
    for empty in (None, "", " \n ", "# Only\n\n| t |", "```\nopen fence"):
        assert R.passages(empty) == []
    assert R.terms("The 12 Cats, 0.5 don't 红的车") == ["the", "0", "cats", "0", "don't", "红的", "的车"]


def test_shares_of_a_mixed_text():
    model = R.Model({("en", 1): {"cat": 50, "the": 50}, ("en", 5): {"epistemology": 50, "the": 50}, ("de", 1): {"katze": 50, "die": 60}})
    langs, shares, words = model.read([["the cat the cat", "the cat"], ["the epistemology the epistemology the", "the cat"], [], ["die katze"]])
    assert langs == ["en", "en", None, "de"] and list(words) == [6, 7, 0, 2]
    assert shares[0].argmax() == 0 and shares[1].argmax() == 4 and 0.6 < shares[1][4] < 0.85 and shares[3].argmax() == 0


def corpus(spark):
    easy = "The cat sat. The dog ran. We saw a bird. "
    hard = "Notwithstanding methodological considerations, epistemological heterogeneity necessitates counterfactual stratification. "
    rows = [(i, (easy if i % 2 else hard) * (2 + i % 3), "en" if i % 7 else None) for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, easy * 3000, "de"), (103, "# head\n\n| x |", "en"), (104, hard + "\n\n" + easy * 8, "en")]
    docs = spark.createDataFrame([(i, t, lang, 5, 0.1) for i, t, lang in rows], "doc_id bigint, text string, lang string, level int, share double")
    grades = spark.createDataFrame([(i, 1 if i % 2 else 5, "g") for i in range(0, 60, 3)] + [(3, 2, "h"), (None, 1, "g"), (7, None, "g"), (8, 9, "g"), (999, 1, "g")], "doc_id bigint, grade int, grader string")
    return docs, grades


def test_levels(spark):
    docs, grades = corpus(spark)
    got = {r["doc_id"]: r for r in R.levels(docs, grades).collect()}
    assert len(got) == 65 and all(got[i]["level"] == (1 if i % 2 else 5) for i in range(60))
    assert all(got[i]["level"] is None and got[i]["prose_words"] == 0 for i in (100, 101, 103))
    assert got[102]["level"] == 1 and got[104]["level"] == 1 and got[104]["share"] < 0.95
    found = {tuple(r) for r in R.extremes(R.levels(docs, grades)).collect()}
    assert (102, 1) in found and (0, 5) in found and not {i for i, _ in found} & {100, 101, 103}


def test_rare_and_unknown_languages(spark):
    docs, grades = corpus(spark)
    finnish = "Kissa istui pihalla. Koira juoksi kotiin. Me katsoimme lintua. "
    english = docs.filter("doc_id < 60").select((F.col("doc_id") + 2000).alias("doc_id"), "text", F.lit("qq").alias("lang"), "level", "share").limit(12)
    rare = spark.createDataFrame([(500 + i, finnish * (1 + i % 3), "fi", 5, 0.1) for i in range(8)] + [(600, "Vaso mira lenta, porto siva nulmo qeta. " * 5, None, 5, 0.1)], docs.schema)
    got = {r["doc_id"]: r for r in R.levels(docs.unionByName(rare).unionByName(english), grades).collect()}
    # one text in eight is enough for a language; a code for texts of another one is none; what nobody knows has no level
    assert {got[i]["language"] for i in range(500, 508)} == {"fi"} and {got[i]["language"] for i in got if i >= 2000} == {"en"}
    assert got[600]["language"] is None and got[600]["level"] is None and got[600]["prose_words"] > 0
    assert all(got[i]["level"] == (1 if i % 2 else 5) for i in range(60))


def test_without_grades_the_formula_seeds(spark):
    docs, grades = corpus(spark)
    got = {r["doc_id"]: r["level"] for r in R.levels(docs, grades.limit(0)).collect()}
    assert max(got[i] for i in range(1, 60, 2)) < min(got[i] for i in range(0, 60, 2))
    assert R.levels(docs.limit(0), grades).count() == 0
    assert R.levels(docs.filter("text is null"), grades).filter("level is not null").count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out_grades(spark):
    docs, grades = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "reading_grades"))
    given = defaultdict(set)
    for r in grades.collect():
        given[r["doc_id"]].add(r["grade"])
    got = {r["doc_id"]: r["level"] for r in R.levels(docs, grades.filter("doc_id % 3 <> 0")).collect()}
    held = [i for i in given if i % 3 == 0 and got[i]]
    assert sum(min(abs(got[i] - g) for g in given[i]) <= 1 for i in held) >= 0.9 * len(held)


def own_word(i):
    """A word that no other number has."""
    return "w" + "".join("abcdefghij"[int(d)] for d in str(i)) + "x"


@pytest.mark.parametrize("n, graded", [(2_500, False), (20_500, True)])
def test_every_text_trains(spark, n, graded):
    # four of the five words of a text are in no other text, so a text that is left out of training has no language
    docs = spark.createDataFrame([(i, f"Seen {own_word(i)} {own_word(i)} {own_word(i)} {own_word(i)}.", "en") for i in range(n)], "doc_id bigint, text string, lang string")
    grades = spark.createDataFrame([(i, 1 + i % 5, "g") for i in range(n if graded else 0)], "doc_id bigint, grade int, grader string")
    got = R.levels(docs, grades)
    assert got.groupBy("language").count().collect() == [("en", n)]
    if graded:
        assert got.filter(F.col("level") != 1 + F.col("doc_id") % 5).count() == 0
