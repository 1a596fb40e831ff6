"""Seeded trials of dealing whole components to splits so that several totals come out in proportion."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.operators.ranking import ordered_rank

#: Kinds of components (equal metrics) that a trial can hold; if there are more, metrics are told apart in bands only.
MOST_KINDS = 200_000
#: Places of a kind in the order of a trial.
PORTIONS = 16
# Fixed value: the penalty of a split without any capture sequence.
UNCOVERED = 100.0


def counted_trial(metrics: np.ndarray, counts: np.ndarray, shares: np.ndarray, weights: np.ndarray, seed: int, noise: float = 0.08, cover: int | None = None) -> tuple[float, np.ndarray]:
    """(weighted squared relative error, components of each kind per split): large kinds first, each to where the error stays least.

    With ``cover``, the number of a metric, a trial in which a split besides the first has nothing of it has an error of
    ``UNCOVERED`` more for each.

    The order is disturbed a little by the seed, so that trials differ. A kind with many components is cut into
    ``PORTIONS`` with a place of their own each, so that kinds mix; of a portion a part of what is left goes at once, in
    the end one by one.
    """
    rng = random.Random(seed)
    parts = np.minimum(counts, PORTIONS)
    kind = np.repeat(np.arange(len(metrics)), parts)
    place = np.arange(len(kind)) - np.repeat(np.cumsum(parts) - parts, parts)
    lefts = (counts // parts)[kind] + (place < (counts % parts)[kind])
    goal = shares[:, None] * (metrics * counts[:, None]).sum(0)[None]
    dealt, metrics = np.zeros((len(metrics), len(shares)), int), metrics[kind]
    jitter = np.array([rng.random() for _ in range(len(metrics))])
    order = np.argsort(-(metrics[:, 0] + jitter * np.maximum(1.0, metrics[:, 0] * noise)), kind="stable")
    target = np.maximum(goal, 1.0)
    now = np.zeros_like(goal)
    for i in order:
        left = int(lefts[i])
        while left:
            n = max(1, left // 4)
            # only one split changes, so the change of its error decides
            before = weights * ((now - goal) / target) ** 2
            after = weights * ((now + n * metrics[i] - goal) / target) ** 2
            k = int(np.argmin((after - before).sum(1)))
            now[k] += n * metrics[i]
            dealt[kind[i], k] += n
            left -= n
    bare = 0 if cover is None else int((now[1:, cover] <= 0).sum())
    return float((weights * ((now - goal) / target) ** 2).sum()) + UNCOVERED * bare, dealt


def one_trial(metrics: np.ndarray, shares: np.ndarray, weights: np.ndarray, seed: int, noise: float = 0.08) -> tuple[float, np.ndarray]:
    """(error, split per component) of a trial in which every component is a kind of its own."""
    error, dealt = counted_trial(metrics, np.ones(len(metrics), int), shares, weights, seed, noise)
    return error, dealt.argmax(1)


def _kinds(components: DataFrame, metrics: list[str]) -> tuple[DataFrame, list]:
    """(``components`` with ``_kind``, the rows ``_kind, _n`` and mean metrics of the kinds), whatever the number of components."""
    exact = [F.coalesce(F.col(m), F.lit(0)).cast("double") for m in metrics]
    bands = lambda per: [F.signum(v) * F.floor(per * F.log2(1 + F.abs(v))) for v in exact]
    for parts in (exact, bands(4), bands(1)):
        told = components.withColumn("_kind", F.array(*parts))
        found = told.groupBy("_kind").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(v).alias(f"_m{i}") for i, v in enumerate(exact)])
        rows = found.limit(MOST_KINDS + 1).collect()
        if len(rows) <= MOST_KINDS:
            return told, sorted(rows, key=lambda r: r["_kind"])
    raise ValueError(f"more than {MOST_KINDS} kinds of components even in whole doublings; use fewer metrics")


def allocate(components: DataFrame, key: str, metrics: list[str], shares: dict[str, float], trials: int = 64, seed: int = 0, weights: list[float] | None = None, cover: str | None = None) -> DataFrame:
    """``key, split, error`` of the best of ``trials`` seeded trials, run side by side; equal errors go to the lower seed.

    Components with equal metrics are interchangeable: trials deal their numbers, and components take the splits of
    their kind by rank in a pseudo-random order. ``cover`` names a metric of which every split needs some.
    """
    spark = components.sparkSession
    need = metrics.index(cover) if cover else None
    told, rows = _kinds(components, metrics)
    names = list(shares)
    held = spark.sparkContext.broadcast((np.array([[r[f"_m{i}"] for i in range(len(metrics))] for r in rows]).reshape(-1, len(metrics)), np.array([r["_n"] for r in rows], int), np.array([shares[n] for n in names]) / sum(shares.values()), np.array(weights or [1.0] * len(metrics))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(int(i), counted_trial(*held.value, seed + int(i), cover=need)[0]) for i in batch["id"]], columns=["trial", "error"])

    tried = spark.range(0, trials, 1, min(trials, spark.sparkContext.defaultParallelism)).mapInPandas(run, "trial bigint, error double")
    best = tried.agg(F.min(F.struct("error", "trial")).alias("m")).select("m.*").first()
    _, dealt = counted_trial(*held.value, seed + best["trial"], cover=need)
    plan = spark.createDataFrame([(r["_kind"], [int(e) for e in ends]) for r, ends in zip(rows, dealt.cumsum(1))], "_plan array<double>, _ends array<bigint>")
    ranked = ordered_rank(told, ["_kind"], [F.xxhash64(key), F.col(key)], "_rank")
    # the plan has a row per kind, so at most MOST_KINDS
    placed = ranked.join(F.broadcast(plan), F.col("_kind") == F.col("_plan"))
    at = F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))) + 1
    return placed.select(key, F.element_at(F.array(*[F.lit(n) for n in names]), at).alias("split"), F.lit(best["error"]).alias("error"))


def class_split(rows: DataFrame, key: str, label: str, share: float) -> DataFrame:
    """``first`` for the leading ``share`` of each class in the order of the key's hash, else ``second``."""
    placed = rows.withColumn("_order", F.sha2(F.col(key).cast("string"), 256))
    ranked = ordered_rank(placed, [label], [F.col("_order"), F.col(key)], "_k", "_n")
    return ranked.withColumn("split", F.when(F.col("_k") < F.floor(F.col("_n") * share), "first").otherwise("second")).select(*rows.columns, "split")
