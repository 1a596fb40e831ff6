"""Precision, recall and average precision from matched predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.operators.ranking import running
from boxloom.runtime import settle

_EPS = 1e-16
_CURVE = ["run_id", "cls", "threshold"]


def labelled_hits(predictions: DataFrame, matches: DataFrame, thresholds: list[float]) -> DataFrame:
    """``run_id, cls, threshold, score, image_id, det, tp``: each prediction at each threshold, matched or not."""
    every = predictions.select("run_id", "image_id", "det", "cls", "score").withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    hit = matches.select("run_id", "image_id", "det", "threshold", F.lit(1).alias("tp"))
    return every.join(hit, ["run_id", "image_id", "det", "threshold"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))


def class_counts(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Truth boxes per run and class over the images that the run looked at: ``run_id, cls, n_truth, n_images``."""
    seen = predictions.select("run_id", "image_id").distinct()
    return seen.join(truth.select("image_id", "cls"), "image_id").groupBy("run_id", "cls").agg(F.count(F.lit(1)).alias("n_truth"), F.countDistinct("image_id").alias("n_images"))


def pr_curve(hits: DataFrame, counts: DataFrame) -> DataFrame:
    """Cumulative precision and recall by falling score within run, class and threshold.

    Equal scores are ordered by image and rank, which is a choice; any order of ties is as good. A curve of any length is
    summed up range by range.
    """
    ranked = hits.join(counts.select("run_id", "cls", "n_truth"), ["run_id", "cls"])
    both = running(ranked, _CURVE, [F.desc("score"), F.col("image_id").asc(), F.col("det").asc()], "k", {"tps": "tp"})
    return both.select("run_id", "cls", "threshold", "k", "score", "n_truth", "tps", (F.col("tps") / (F.col("n_truth") + _EPS)).alias("recall"), (F.col("tps") / F.col("k")).alias("precision"))


def envelope(curve: DataFrame) -> DataFrame:
    """``best``: the greatest precision from this recall on."""
    return running(curve, _CURVE, [F.desc("k")], "_from_end", maxima={"best": "precision"}).drop("_from_end")


def average_precision(curve: DataFrame, counts: DataFrame, thresholds: list[float]) -> DataFrame:
    """``run_id, cls, threshold, ap``: area under the envelope sampled at 101 recalls (trapezoids).

    The curve starts at (0, 1) and ends at (1, 0); between points it is linear. A class with truth but no
    predictions has 0. Samples fall into segments by an equi-join on whole hundredths, not by comparing all pairs.
    """
    keys = _CURVE
    top = settle(envelope(curve).select(*keys, "k", "recall", "best"))
    # each point meets the one before by its number
    before = top.select(*keys, (F.col("k") + 1).alias("k"), F.col("recall").alias("r0"), F.col("best").alias("p0"))
    points = top.join(before, [*keys, "k"], "left").select(*keys, "recall", "best", F.coalesce("r0", F.lit(0.0)).alias("r0"), F.coalesce("p0", F.greatest(F.lit(1.0), "best")).alias("p0"))
    # the last point goes on to (1, 0)
    tail = top.groupBy(*keys).agg(F.max(F.struct("k", "recall", "best")).alias("m")).select(*keys, F.lit(1.0).alias("recall"), F.lit(0.0).alias("best"), F.col("m.recall").alias("r0"), F.col("m.best").alias("p0"))
    segments = points.unionByName(tail)
    # samples i/100 with r0 < i/100 <= recall; recall 0 belongs to the first point
    lo, hi = F.floor(F.col("r0") * 100 + 1e-9) + 1, F.floor(F.col("recall") * 100 + 1e-9)
    sampled = segments.filter(lo <= hi).select(*keys, "recall", "best", "r0", "p0", F.explode(F.sequence(lo, hi)).alias("i"))
    x = F.col("i") / 100
    value = F.col("p0") + (F.col("best") - F.col("p0")) * (x - F.col("r0")) / (F.col("recall") - F.col("r0"))
    # sample 0 has value 1, samples 1..99 count whole, sample 100 counts half
    part = F.when(F.col("i") == 100, 0.5).otherwise(1.0) * value
    sums = sampled.groupBy(*keys).agg(F.sum(part).alias("s"))
    area = sums.select(*keys, ((F.col("s") + 0.5) / 100).alias("ap"))
    every = counts.select("run_id", "cls").withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return every.join(area, keys, "left").select(*keys, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def summary(ap: DataFrame) -> DataFrame:
    """Per run: mean AP at 0.5, at 0.75 and over all thresholds, over classes with truth; fitness is the last."""
    at = lambda t: F.avg(F.when(F.round("threshold", 2) == t, F.col("ap")))
    return ap.groupBy("run_id").agg(at(0.5).alias("map50"), at(0.75).alias("map75"), F.avg("ap").alias("map"))


def operating_point(curve: DataFrame) -> DataFrame:
    """Per run and class the point of the curve with the greatest F1: ``precision, recall, f1, score``; the first one of equals."""
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + _EPS)
    best = F.max_by(F.struct("precision", "recall", "f1", "score"), F.struct("f1", (-F.col("k")).alias("i"))).alias("m")
    return curve.withColumn("f1", f1).groupBy(*_CURVE).agg(best).select(*_CURVE, "m.*")


def confusion_rates(confusion: DataFrame) -> DataFrame:
    """True and false positives per run and class from confusion counts, and the share of each truth class (column-normalised)."""
    w = Window.partitionBy("run_id", "actual")
    return confusion.select("run_id", "predicted", "actual", "n", (F.col("n") / (F.sum("n").over(w) + 1e-9)).alias("share"))


def smoothed(values: DataFrame, keys: list[str], order: str, value: str, half: int) -> DataFrame:
    """Centred mean over ``2 * half + 1`` rows where the ends are padded with the end values, not shortened."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, final = F.first(value).over(whole), F.last(value).over(whole)
    at: list[Column] = [F.col(value)]
    for i in range(1, half + 1):
        at += [F.coalesce(F.lag(value, i).over(w), first), F.coalesce(F.lead(value, i).over(w), final)]
    return values.withColumn("smooth", reduce(lambda a, b: a + b, at) / (2 * half + 1))


def gaussian(values: DataFrame, keys: list[str], order: str, value: str, sigma: float, reach: float = 3.0) -> DataFrame:
    """Weighted mean over a Gaussian of ``sigma`` rows, cut at ``reach`` deviations, mirrored at the ends.

    Rows meet their neighbours by an equi-join on the mirrored position, so cost is linear in the rows.
    """
    half = int(reach * sigma + 0.5)
    w = Window.partitionBy(*keys)
    numbered = values.withColumn("_i", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count(F.lit(1)).over(w))
    spread = numbered.select(*keys, order, "_n", "_i", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("_o"))
    at = F.col("_i") + F.col("_o")
    mirrored = F.when(at < 1, 1 - at).when(at > F.col("_n"), 2 * F.col("_n") + 1 - at).otherwise(at)
    spread = spread.withColumn("_at", mirrored.cast("int")).withColumn("_g", F.exp(-0.5 * F.pow(F.col("_o") / sigma, 2)))
    other = numbered.select(*keys, F.col("_i").alias("_at"), F.col(value).alias("_v"))
    both = spread.join(other, [*keys, "_at"])
    return both.groupBy(*keys, order).agg((F.sum(F.col("_g") * F.col("_v")) / F.sum("_g")).alias("smooth"))


#: Places of the score axis at which curves are read.
PLACES = 1000


def score_curves(curve: DataFrame) -> DataFrame:
    """Precision and recall at ``PLACES`` even scores from 0 to 1: ``run_id, cls, threshold, i, precision, recall``.

    Linear between the scores of neighbouring predictions; above the highest score recall is 0 and precision 1,
    below the lowest one both stay. Every stretch between two predictions yields its own places.
    """
    keys = ["run_id", "cls", "threshold"]
    w = Window.partitionBy(*keys).orderBy("k")
    # of predictions with equal scores the last one speaks
    p = curve.withColumn("next", F.lead("score").over(w)).filter("next is null or next < score").drop("next")
    p = p.select(*keys, "k", "score", "precision", "recall", F.lag("score").over(w).alias("s0"), F.lag("precision").over(w).alias("p0"), F.lag("recall").over(w).alias("r0"), F.lead("k").over(w).isNull().alias("last"))
    step = PLACES - 1
    top = F.when(F.col("s0").isNull(), F.lit(step)).otherwise(F.ceil(F.col("s0") * step - 1e-9) - 1)
    low = F.when(F.col("last"), F.lit(0)).otherwise(F.ceil(F.col("score") * step - 1e-9))
    at = p.withColumn("a", low.cast("int")).withColumn("b", F.least(top, F.lit(step)).cast("int")).filter("a <= b").withColumn("i", F.explode(F.sequence("a", "b")))
    x = F.col("i") / step
    share = (x - F.col("score")) / (F.col("s0") - F.col("score"))

    def value(now: str, before: str, head: float) -> Column:
        between = F.col(now) + (F.col(before) - F.col(now)) * share
        return F.when(x <= F.col("score"), F.col(now)).when(F.col("s0").isNull(), F.lit(head)).otherwise(between)

    return at.select(*keys, "i", value("precision", "p0", 1.0).alias("precision"), value("recall", "r0", 0.0).alias("recall"))


def common_operating_point(curve: DataFrame, width: float = 0.1) -> DataFrame:
    """``run_id, cls, threshold, score, precision, recall, f1`` at one score per run and threshold.

    The score is where the mean F1 over classes, smoothed by a centred mean over ``width`` of the axis with padded
    ends, is greatest (the lowest of equals). The smoothed curve has ``PLACES`` rows, however many predictions there are.
    """
    grid = score_curves(curve).withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + _EPS))
    mean = grid.groupBy("run_id", "threshold", "i").agg(F.avg("f1").alias("f1"))
    half = round(PLACES * width * 2) // 2 // 2
    span = F.sequence(F.lit(-half), F.lit(half))
    spread = mean.select("run_id", "threshold", "i", F.explode(span).alias("o")).withColumn("at", F.least(F.greatest(F.col("i") + F.col("o"), F.lit(0)), F.lit(PLACES - 1)))
    smooth = spread.join(mean.select("run_id", "threshold", F.col("i").alias("at"), "f1"), ["run_id", "threshold", "at"]).groupBy("run_id", "threshold", "i").agg(F.avg("f1").alias("s"))
    best = smooth.groupBy("run_id", "threshold").agg(F.max(F.struct(F.round("s", 12).alias("s"), (-F.col("i")).alias("minus"))).alias("m")).select("run_id", "threshold", (-F.col("m.minus")).alias("i"))
    return grid.join(best, ["run_id", "threshold", "i"]).select("run_id", "cls", "threshold", (F.col("i") / (PLACES - 1)).alias("score"), "precision", "recall", "f1")


def format_report(runs: DataFrame, form: str, score: str, seconds: str) -> DataFrame:
    """Per format: runs, best and mean score, runs without a score, and mean time in milliseconds."""
    per = runs.groupBy(form).agg(F.count(F.lit(1)).alias("runs"), F.max(score).alias("best"), F.avg(score).alias("mean"), F.count_if(F.col(score).isNull()).alias("failed"), (1000 * F.avg(seconds)).alias("ms"))
    return per.select(form, "runs", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"), "failed", F.round("ms", 4).alias("ms"))
