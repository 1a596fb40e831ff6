"""Search over numeric settings: blend crossover and mutation of the best trials."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_trials(trials: DataFrame, fitness: str, n: int) -> DataFrame:
    """The ``n`` fittest trials."""
    return trials.filter(F.col(fitness).isNotNull()).orderBy(F.desc(fitness)).limit(n)


def blend(parents: np.ndarray, fitness: np.ndarray, rng: np.random.Generator, alpha: float = 0.2) -> np.ndarray:
    """A child within the span of two parents, widened by ``alpha`` on both sides; fitter parents are drawn more often."""
    weight = fitness - fitness.min() + 1e-6
    i, j = rng.choice(len(parents), 2, p=weight / weight.sum())
    lo, hi = np.minimum(parents[i], parents[j]), np.maximum(parents[i], parents[j])
    span = hi - lo
    return rng.uniform(lo - alpha * span, hi + alpha * span)


def mutate(values: np.ndarray, gains: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator, chance: float = 0.5, sigma: float = 0.2) -> np.ndarray:
    """Values times random factors around 1 (between 0.3 and 3), clipped to their bounds, five digits; at least one moves if any may."""
    factor = np.ones(len(values))
    while np.all(factor == 1) and np.any(gains > 0):
        factor = np.clip(gains * (rng.random(len(values)) < chance) * rng.standard_normal(len(values)) * rng.random() * sigma + 1, 0.3, 3.0)
    return np.round(np.clip(values * factor, low, high), 5)
