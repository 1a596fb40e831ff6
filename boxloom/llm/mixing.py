"""Mixing sources to target weights: soft membership, bounded least squares, whole copies.

Every distinct text belongs to sources with certain shares: wholly to its own where the table names it, else as a
naive Bayes classifier, trained on texts that the table labels, tells from its words. Rates (copies per text, at
least 0, at most what the source allows) are fitted to all texts together by projected gradient steps, so that the
expected tokens per source, predicted members included, match the targets; texts with equal membership share a rate, so
each step is one aggregation over a table of memberships. Then rates become whole copies, with the error carried along
from long to short texts, so that sources hit their share to within a short text.

The size of the mix (``size``, in tokens) is by default the largest at which every source that has any expected tokens
can reach its target within its repeats, predicted members counted. A source without texts reaches 0; its share falls to
the others in proportion.

Defined results: spellings of a source count as one. A text delivered several times is one text, held by the source
with a target, then by the smallest document. Null and empty texts hold no tokens and take no part. Texts of
sources without a target get no copies. A text that may belong to several sources keeps to the strictest of their
repeats. A null or negative target or repeat counts as 0. No targets, no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.names import plain_name
from boxloom.llm.tokens import VOCABULARY, token_count
from boxloom.operators.ranking import lookup
from boxloom.runtime import settle

#: About so many labelled texts per source train the classifier (picked by hash, the same at every size).
MOST_PER_SOURCE = 400
#: Words are hashed into so many features, so a model has at most (sources + 1) times as many numbers.
FEATURES = 1 << 13
#: Memberships are told in so many parts; parts go to the largest remainders, so that they add up to a whole.
PARTS = 64
#: The fit ends when the worst source is within this share of its target, or after ``STEPS`` steps.
CLOSE, STEPS = 1e-3, 60
OTHER = "(other)"
_WORD = re.compile(r"[^\W\d_]+")


def _features(text: str) -> dict[int, int]:
    """Word counts by hashed feature; text without blanks is taken by pairs of signs."""
    from zlib import crc32

    out: dict[int, int] = {}
    for word in _WORD.findall(text.lower()):
        for part in [word[i : i + 2] for i in range(len(word) - 1)] if word[0] >= "㐀" and len(word) > 1 else [word]:
            k = crc32(part.encode()) % FEATURES
            out[k] = out.get(k, 0) + 1
    return out


def distinct_texts(documents: DataFrame, wanted: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens``: one row per distinct text with any tokens; ``source`` null where unknown.

    Copies are told by two hashes of the whole text, 128 bits in all; only the hashes and sizes are shuffled.
    """
    sized = documents.select("doc_id", plain_name(F.col("source")).alias("source"), token_count(F.col("text"), vocabulary).alias("n_tokens"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(17), "text").alias("h2"))
    order = F.struct(F.when(F.col("source").isin(wanted), 0).when(F.col("source").isNotNull(), 1).otherwise(2).alias("o"), "doc_id", "source", "n_tokens")
    return sized.filter("n_tokens > 0").groupBy("h1", "h2").agg(F.min(order).alias("m")).select("m.doc_id", "m.source", "m.n_tokens")


def posteriors(documents: DataFrame, texts: DataFrame, wanted: list[str]) -> DataFrame:
    """``doc_id, shares``: membership of documents that name no source in ``wanted`` and, last, any other source.

    Texts are read where they are: for training those of the sample, whose ids are few (``MOST_PER_SOURCE`` per class)
    and sent to the readers, for telling those whose own row names no source. No text is moved.
    """
    classes = [*wanted, OTHER]
    spark = documents.sparkSession
    label = F.when(F.col("source").isin(wanted), F.col("source")).when(F.col("source").isNotNull(), F.lit(OTHER))
    labelled = texts.select("doc_id", label.alias("label"))
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if None not in sizes or len(sizes) < 2:
        return spark.createDataFrame([], "doc_id bigint, shares array<double>")
    part = reduce(lambda out, k: F.when(F.col("label") == k, min(1.0, MOST_PER_SOURCE / sizes[k])).otherwise(out), [k for k in sizes if k is not None], F.lit(0.0))
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1_000_000)) < part * 1_000_000)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, int], int] = {}
        for batch in batches:
            for name, text in zip(batch["label"], batch["text"]):
                for k, n in _features(text).items():
                    total[name, k] = total.get((name, k), 0) + n
        yield pd.DataFrame([(a, k, n) for (a, k), n in total.items()], columns=["label", "feature", "n"])

    words = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id").select("label", "text").mapInPandas(count, "label string, feature int, n bigint")
    table = np.full((len(classes), FEATURES), 0.5)
    for r in words.groupBy("label", "feature").agg(F.sum("n").alias("n")).toLocalIterator():
        table[classes.index(r["label"]), r["feature"]] += r["n"]
    logs = np.log(table / table.sum(axis=1, keepdims=True))
    prior = np.array([float(sizes.get(k, 0)) for k in classes])
    prior = np.log(np.maximum(prior, 1e-9) / prior.sum())
    shared = spark.sparkContext.broadcast((logs, prior))

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs, prior = shared.value
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                bag = _features(text)
                n = np.array(list(bag.values()), dtype=float)
                score = prior.copy()
                if len(n):
                    # words of a text aren't independent: n of them weigh as the root of n
                    score += (logs[:, list(bag)] * n).sum(axis=1) / np.sqrt(n.sum())
                p = np.exp(score - score.max())
                out.append((doc_id, (p / p.sum()).tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "shares"])

    unnamed = documents.filter(plain_name(F.col("source")).isNull() & (F.col("text") != ""))
    return unnamed.select("doc_id", "text").mapInPandas(tell, "doc_id bigint, shares array<double>")


def fit_rates(profiles: DataFrame, targets: list[float]) -> DataFrame:
    """``profiles`` (``shares, cap, tokens``) with ``rate`` in 0..cap so that expected tokens per source meet ``targets``.

    Projected gradient least squares over relative errors. Each step sums expected tokens per source in one
    aggregation; the gradient of a profile is scaled by the most that one step can move (its row sum), which keeps
    steps from overshooting, and the new rate is clipped to its bounds. Steps carry momentum, which is dropped when the
    error grows.
    """
    n = len(targets)
    weight = [1 / t if t > 0 else 0.0 for t in targets]
    share = lambda i: F.get("shares", F.lit(i))
    add = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0.0))
    sums = lambda df, cols: df.agg(*[F.sum(share(i) * F.col("tokens") * c).alias(f"{name}{i}") for i in range(n) for name, c in cols.items()]).first()
    whole = sums(profiles, {"all": F.lit(1.0)})
    scale = add([share(i) * F.lit(weight[i] ** 2 * (whole[f"all{i}"] or 0.0)) for i in range(n)])
    fitted, pace, before = profiles.withColumn("rate", F.lit(0.0)).withColumn("ahead", F.lit(0.0)), 1.0, float("inf")
    for _ in range(STEPS):
        at = sums(fitted, {"rate": F.col("rate"), "ahead": F.col("ahead")})
        off = [(targets[i] - (at[f"rate{i}"] or 0.0)) * weight[i] for i in range(n)]
        error = sum(x * x for x in off)
        if max(map(abs, off), default=0.0) < CLOSE or abs(before - error) < 1e-12:
            break
        pace = 1.0 if error > before else pace
        before = error
        miss = [targets[i] - (at[f"ahead{i}"] or 0.0) for i in range(n)]
        step = F.coalesce(F.try_divide(add([share(i) * F.lit(weight[i] ** 2 * miss[i]) for i in range(n)]), scale), F.lit(0.0))
        moved = F.least(F.greatest(F.col("ahead") + step, F.lit(0.0)), F.col("cap").cast("double"))
        # the next gradient is taken a little ahead on the way of the last two steps
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        push, pace = (pace - 1) / faster, faster
        fitted = fitted.withColumn("new", moved)
        fitted = settle(fitted.withColumn("ahead", F.col("new") + F.lit(push) * (F.col("new") - F.col("rate"))).withColumn("rate", F.col("new")).drop("new"))
    return fitted.drop("ahead")


def _membership(source: Column, soft: Column, wanted: list[str]) -> Column:
    """Shares of the wanted sources in whole parts; what belongs to any other source is left out."""
    sure = F.array(*[F.when(source == s, 1.0).otherwise(0.0) for s in wanted])
    scaled = F.transform(soft, lambda p, i: F.struct((F.floor(p * PARTS) - p * PARTS).alias("minus_rest"), i.alias("i"), F.floor(p * PARTS).cast("int").alias("parts")))
    missing = F.lit(PARTS) - F.aggregate(scaled, F.lit(0), lambda n, x: n + x["parts"])
    # the parts still missing go one by one to the largest remainders
    given = F.transform(F.array_sort(scaled), lambda x, k: F.struct(x["i"].alias("i"), (x["parts"] + F.when(k < missing, 1).otherwise(0)).alias("parts")))
    rounded = F.transform(F.slice(F.array_sort(given), 1, len(wanted)), lambda x: x["parts"] / F.lit(float(PARTS)))
    return F.when(source.isNotNull(), sure).otherwise(F.coalesce(rounded, sure))


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, size: float | None = None, rows_per_bucket: int = 50_000) -> tuple[DataFrame, list[tuple]]:
    """(``doc_id, source, shares, n_tokens, rate, copies`` of all texts with copies, the targets as (source, share, repeats))."""
    rows = targets.select(plain_name(F.col("source")).alias("s"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("cap")).filter("s is not null")
    goals = [(r["s"], max(0.0, r["share"]), max(0, r["cap"])) for r in rows.groupBy("s").agg(F.sum("share").alias("share"), F.max("cap").alias("cap")).orderBy("s").collect()]
    spark = documents.sparkSession
    if not goals:
        return spark.createDataFrame([], "doc_id bigint, source string, shares array<double>, n_tokens bigint, rate double, copies int"), goals
    wanted = [g[0] for g in goals]
    texts = settle(distinct_texts(documents, wanted, vocabulary))
    soft = posteriors(documents, texts, wanted)
    member = texts.join(soft, "doc_id", "left").withColumn("shares", _membership(F.col("source"), F.col("shares"), wanted))
    strict = F.array_min(F.array(*[F.when(F.get("shares", F.lit(i)) > 0, F.lit(cap)) for i, (_, _, cap) in enumerate(goals)]))
    member = settle(member.withColumn("cap", F.coalesce(strict, F.lit(0))).filter("cap > 0"))
    profiles = settle(member.groupBy("shares", "cap").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")))
    # the most that each source can give, predicted members counted
    most = profiles.agg(*[F.sum(F.get("shares", F.lit(i)) * F.col("tokens") * F.col("cap")).alias(f"m{i}") for i in range(len(goals))]).first()
    have = [most[f"m{i}"] or 0.0 for i in range(len(goals))]
    size = size or min((m / share for m, (_, share, _) in zip(have, goals) if share > 0 and m > 0), default=0.0)
    aims = [share * size if m > 0 else 0.0 for m, (_, share, _) in zip(have, goals)]
    # texts meet the rate of their membership; a source with a tenth of all texts is one membership
    profile = F.xxhash64("shares", "cap").alias("profile")
    rates = fit_rates(profiles, aims)
    rated = lookup(member.select("*", profile), rates.select(profile, "rate"), "profile", "inner")
    # whole copies are carried along among texts of one main source, sure and predicted members apart
    rated = settle(rated.select("doc_id", "source", "shares", "n_tokens", "cap", "rate", F.array_position("shares", F.array_max("shares")).alias("main"), F.col("source").isNull().alias("guessed")))
    buckets = rated.groupBy("main", "guessed").agg(F.ceil(F.count(F.lit(1)) / rows_per_bucket).cast("bigint").alias("_b"))
    slim = rated.join(F.broadcast(buckets), ["main", "guessed"]).select("main", "guessed", F.pmod(F.xxhash64("doc_id"), F.col("_b")).alias("bucket"), "doc_id", "n_tokens", "rate", "cap")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True])
        owed, out = 0.0, []
        for n, rate, cap in zip(pdf["n_tokens"], pdf["rate"], pdf["cap"]):
            owed += rate * n
            k = min(cap, max(0, round(owed / n)))
            owed -= k * n
            out.append(k)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "copies": out}).astype({"copies": "int32"})

    copies = slim.groupBy("main", "guessed", "bucket").applyInPandas(whole, "doc_id bigint, copies int")
    mixed = rated.select("doc_id", "source", "shares", "n_tokens", "rate").join(copies, "doc_id").filter("copies > 0")
    return mixed, goals


def shares_reached(mixed: DataFrame, goals: list[tuple]) -> DataFrame:
    """Per source: target, tokens and share by the table's own labels, share expected by membership, texts and most copies."""
    mixed = settle(mixed)
    spark = mixed.sparkSession
    tokens = F.col("n_tokens") * F.col("copies")
    n = len(goals)
    if not n:
        return spark.createDataFrame([], "source string, target_share double, max_repeats int, tokens bigint, reached double, expected double, texts bigint, most_copies int")
    sums = mixed.agg(F.sum(tokens).alias("all"), *[F.sum(F.get("shares", F.lit(i)) * tokens).alias(f"e{i}") for i in range(n)]).first()
    soft_total = sum(sums[f"e{i}"] or 0.0 for i in range(n))
    own = mixed.groupBy("source").agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("copies").alias("most_copies"))
    base = spark.createDataFrame([(s, share, cap, (sums[f"e{i}"] or 0.0) / soft_total if soft_total else 0.0) for i, (s, share, cap) in enumerate(goals)], "source string, target_share double, max_repeats int, expected double")
    total = F.lit(sums["all"] or 0)
    return base.join(own, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)).alias("reached"), "expected", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
