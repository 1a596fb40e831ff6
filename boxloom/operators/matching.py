"""Overlap joins, suppression and one-to-one matching of boxes.

Every pairwise step joins on the image (and class), so pairs form only inside an image, and a pair of boxes of one
image is the most that a task compares. Ties are broken by explicit columns, never by the order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.functions import boxes as B

THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def overlap_pairs(predictions: DataFrame, truth: DataFrame, by_class: bool = True, kernel: Callable = B.iou, shape: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """Predictions joined with the truth of their image: ``run_id, image_id, det, gt, cls, gt_cls, score, iou``.

    ``predictions`` needs ``det`` (an id that orders by falling score within run and image), ``truth`` needs ``gt``.
    ``shape`` names the columns that tell the shape on both sides; ``kernel`` gets those of the truth and of the
    prediction and gives their overlap, so masks, keypoints and turned boxes are matched as boxes are.
    """
    p = predictions.select("run_id", "image_id", "det", "cls", "score", *[F.col(c).alias(f"p_{c}") for c in shape])
    t = truth.select("image_id", "gt", F.col("cls").alias("gt_cls"), *[F.col(c).alias(f"t_{c}") for c in shape])
    pairs = p.join(t, "image_id")
    if by_class:
        pairs = pairs.filter("cls = gt_cls")
    return pairs.select("run_id", "image_id", "det", "gt", "cls", "gt_cls", "score", kernel(tuple(F.col(f"t_{c}") for c in shape), tuple(F.col(f"p_{c}") for c in shape)).alias("iou"))


def ranked_predictions(predictions: DataFrame) -> DataFrame:
    """``det``: 1, 2, ... by falling score within run and image; equal scores by class and corners."""
    w = Window.partitionBy("run_id", "image_id").orderBy(F.desc("score"), "cls", "x1", "y1", "x2", "y2")
    return predictions.withColumn("det", F.row_number().over(w))


def evaluation_match(pairs: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """The evaluation matcher: ``run_id, image_id, det, threshold`` of matched predictions.

    For each threshold: pairs at or above it; each prediction keeps its best truth box; then each truth box goes to
    the first prediction in rank order (the most confident one), not to the best overlap.
    """
    each = pairs.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).filter("iou >= threshold")
    best = Window.partitionBy("run_id", "image_id", "threshold", "det").orderBy(F.desc("iou"), "gt")
    one = each.withColumn("r", F.row_number().over(best)).filter("r = 1")
    first = Window.partitionBy("run_id", "image_id", "threshold", "gt").orderBy("det")
    return one.withColumn("r", F.row_number().over(first)).filter("r = 1").select("run_id", "image_id", "det", "gt", "threshold")


def confusion_match(pairs: DataFrame, iou: float = 0.45, score: float = 0.25) -> DataFrame:
    """The matcher of the confusion matrix: strictly above both limits, and the best overlap wins on both sides."""
    each = pairs.filter((F.col("iou") > iou) & (F.col("score") > score))
    by_det = Window.partitionBy("run_id", "image_id", "det").orderBy(F.desc("iou"), "gt")
    by_gt = Window.partitionBy("run_id", "image_id", "gt").orderBy(F.desc("iou"), "det")
    one = each.withColumn("r", F.row_number().over(by_det)).filter("r = 1")
    return one.withColumn("r", F.row_number().over(by_gt)).filter("r = 1").drop("r")


def confusion_counts(predictions: DataFrame, truth: DataFrame, iou: float = 0.45, score: float = 0.25) -> DataFrame:
    """``run_id, predicted, actual, n``; the background is class -1. Truth counts for every run that looked at its image."""
    strong = predictions.filter(F.col("score") > score)
    hit = confusion_match(overlap_pairs(strong, truth, by_class=False), iou, score)
    seen = predictions.select("run_id", "image_id").distinct()
    wanted = seen.join(truth.select("image_id", "gt", F.col("cls").alias("actual")), "image_id")
    missed = wanted.join(hit.select("run_id", "image_id", "gt"), ["run_id", "image_id", "gt"], "left_anti").select("run_id", F.lit(-1).alias("predicted"), "actual")
    false = strong.join(hit.select("run_id", "image_id", "det"), ["run_id", "image_id", "det"], "left_anti").select("run_id", F.col("cls").alias("predicted"), F.lit(-1).alias("actual"))
    matched = hit.select("run_id", F.col("cls").alias("predicted"), F.col("gt_cls").alias("actual"))
    return matched.unionByName(missed).unionByName(false).groupBy("run_id", "predicted", "actual").agg(F.count(F.lit(1)).alias("n"))


def fast_nms(ranked: DataFrame, limit: float) -> DataFrame:
    """Drops a box if any box of its class ranked higher overlaps it by ``limit`` or more; dropped boxes drop others too."""
    keys = ["run_id", "image_id", "cls"]
    corners = ("x1", "y1", "x2", "y2")
    higher = ranked.select(*keys, F.col("det").alias("h_det"), *[F.col(c).alias(f"h_{c}") for c in corners])
    beaten = ranked.join(higher, keys).filter((F.col("h_det") < F.col("det")) & (B.iou(B.columns("h_"), B.columns()) >= limit))
    return ranked.join(beaten.select(*keys, "det").distinct(), [*keys, "det"], "left_anti")


def _iou_matrix(a: np.ndarray, b: np.ndarray, eps: float = 1e-7) -> np.ndarray:
    w = np.clip(np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]), 0, None)
    h = np.clip(np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]), 0, None)
    inter = w * h
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return inter / (area(a)[:, None] + area(b)[None, :] - inter + eps)


def greedy_nms(ranked: DataFrame, limit: float, most: int | None = 300, candidates: int | None = 30_000) -> DataFrame:
    """Sequential suppression per run, image and class, then at most ``most`` boxes per image by score.

    What overlaps a kept box by more than ``limit`` goes. The order is inherent, so the boxes of one image and class
    (of the first ``candidates`` of the image, as in the original) are folded in rank order; the fold stays in the JVM
    and stops keeping after ``most`` boxes, as no more can survive the limit per image. None lifts either limit.
    """
    keys = ["run_id", "image_id", "cls"]
    box = F.struct("det", "score", "x1", "y1", "x2", "y2")
    kind = "array<struct<det:int,score:double,x1:double,y1:double,x2:double,y2:double>>"
    ranked = ranked if candidates is None else ranked.filter(F.col("det") <= candidates)
    listed = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    corners = lambda b: (b["x1"], b["y1"], b["x2"], b["y2"])

    def take(kept, b):
        beaten = F.exists(kept, lambda k: B.iou(corners(k), corners(b)) > limit)
        return F.when(beaten if most is None else beaten | (F.size(kept) >= most), kept).otherwise(F.concat(kept, F.array(b)))

    kept = listed.select(*keys, F.explode(F.aggregate("boxes", F.array().cast(kind), take)).alias("b")).select(*keys, "b.*")
    if most is None:
        return kept
    w = Window.partitionBy("run_id", "image_id").orderBy("det")
    return kept.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).drop("r")


def suppress(predictions: DataFrame, score: float = 0.25, iou: float = 0.7, classes: list[int] | None = None, most: int = 300) -> DataFrame:
    """The whole pipeline: strong boxes, wanted classes, rank, candidates, suppression per class, limit per image."""
    strong = predictions.filter(F.col("score") > score)
    if classes is not None:
        strong = strong.filter(F.col("cls").isin(classes))
    return greedy_nms(ranked_predictions(strong), iou, most)


def confident_match(ious: np.ndarray, limit: float, ignored: np.ndarray | None = None) -> list[int]:
    """Greedy by confidence: rows (predictions in rank order) take their best free column at or above ``limit``.

    Columns in the group come before ignored ones; -1 is unmatched, -2 matched to an ignored column.
    """
    free = np.ones(ious.shape[1], bool)
    ignored = np.zeros(ious.shape[1], bool) if ignored is None else ignored
    out = []
    for row in ious:
        take = -1
        for group in (~ignored, ignored):
            open_ = np.flatnonzero(free & group & (row >= limit))
            if len(open_):
                take = int(open_[np.argmax(row[open_])])
                break
        if take >= 0:
            free[take] = False
            out.append(-2 if ignored[take] else take)
        else:
            out.append(-1)
    return out


def overlap_first_match(ious: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Greedy by overlap over all pairs, falling; ties go to the larger (column, row). Gives (row, column)."""
    pairs = sorted(((float(ious[i, j]), j, i) for i in range(ious.shape[0]) for j in range(ious.shape[1]) if ious[i, j] >= limit), reverse=True)
    rows, cols, out = set(), set(), []
    for _, j, i in pairs:
        if i not in rows and j not in cols:
            rows.add(i)
            cols.add(j)
            out.append((i, j))
    return out


def assign(cost: np.ndarray, limit: float = np.inf) -> list[tuple[int, int]]:
    """Optimal one-to-one assignment of least total cost, pairs above ``limit`` left out (shortest augmenting paths)."""
    if not cost.size:
        return []
    cost = np.nan_to_num(np.asarray(cost, float), nan=0.0, posinf=0.0, neginf=0.0)
    finite = np.isfinite(limit)
    n, m = cost.shape
    # with a limit, each row may also stay alone at half the limit on either side
    if finite:
        big = np.full((n + m, n + m), limit / 2)
        big[:n, :m] = np.where(cost > limit, limit + 1e6, cost)
        big[n:, m:] = 0.0
        work = big
    else:
        work = cost if n <= m else cost.T
    rows, cols = work.shape
    u, v, way_row = np.zeros(rows + 1), np.zeros(cols + 1), np.zeros(cols + 1, int)
    for i in range(1, rows + 1):
        way_row[0], j0 = i, 0
        least, came, done = np.full(cols + 1, np.inf), np.zeros(cols + 1, int), np.zeros(cols + 1, bool)
        while True:
            done[j0] = True
            i0 = way_row[j0]
            open_ = np.flatnonzero(~done[1:]) + 1
            slack = work[i0 - 1, open_ - 1] - u[i0] - v[open_]
            better = slack < least[open_]
            least[open_[better]] = slack[better]
            came[open_[better]] = j0
            j1 = int(open_[np.argmin(least[open_])])
            delta = least[j1]
            u[way_row[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            j0 = j1
            if way_row[j0] == 0:
                break
        while j0:
            way_row[j0] = way_row[came[j0]]
            j0 = came[j0]
    pairs = [(int(way_row[j]) - 1, j - 1) for j in range(1, cols + 1) if way_row[j]]
    if not finite:
        return sorted(pairs if n <= m else [(j, i) for i, j in pairs])
    return sorted((i, j) for i, j in pairs if i < n and j < m and cost[i, j] <= limit)


def per_image(predictions: DataFrame, truth: DataFrame, fn: Callable, columns: list[str], schema: str, boxes_per_task: int = 50_000) -> DataFrame:
    """``fn(predictions, truth)`` over the boxes of each run and image, for sequential matchers.

    ``fn`` gets two frames ordered by ``det`` and ``gt`` and gives rows without the two keys. About
    ``boxes_per_task`` predictions travel together, as a batch per image would cost more than its work; a bucket holds
    whole images, so a task gets more only if a single image does.
    """
    seen = predictions.select("run_id", "image_id").distinct()
    buckets = max(1, -(-predictions.count() // boxes_per_task))
    bucket = F.pmod(F.xxhash64("run_id", "image_id"), F.lit(buckets)).alias("bucket")
    p = predictions.select("*", bucket)
    both = seen.join(truth, "image_id").select("*", bucket)
    # fresh names, as both sides of the cogroup come from the same table
    t = both.select(*[F.col(c).alias(f"_{c}") for c in both.columns]).toDF(*both.columns)

    def each(p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        truths = {k: v.sort_values("gt") for k, v in g.groupby(["run_id", "image_id"])} if len(g) else {}
        none = g.iloc[:0]
        out = []
        for k, v in p.groupby(["run_id", "image_id"]):
            out += [(*k, *row) for row in fn(v.sort_values("det"), truths.get(k, none))]
        return pd.DataFrame(out, columns=["run_id", "image_id", *columns])

    return p.groupBy("bucket").cogroup(t.groupBy("bucket")).applyInPandas(each, schema)


def greedy_hits(predictions: DataFrame, truth: DataFrame, limit: float = 0.5) -> DataFrame:
    """``run_id, image_id, tp, fp, fn`` by the confidence-greedy matcher, and ``tp_overlap`` by the overlap-first one."""

    def count(p: pd.DataFrame, g: pd.DataFrame) -> list[tuple]:
        cols = ["x1", "y1", "x2", "y2"]
        ious = _iou_matrix(p[cols].to_numpy(float), g[cols].to_numpy(float)) if len(p) and len(g) else np.zeros((len(p), len(g)))
        tp = sum(k >= 0 for k in confident_match(ious, limit))
        return [(tp, len(p) - tp, len(g) - tp, len(overlap_first_match(ious, limit)))]

    return per_image(predictions, truth, count, ["tp", "fp", "fn", "tp_overlap"], "run_id string, image_id string, tp int, fp int, fn int, tp_overlap int")


def set_match(predictions: DataFrame, truth: DataFrame, width: float = 5.0, overlap: float = 2.0) -> DataFrame:
    """Optimal assignment per image with cost = ``width`` x mean corner distance / 1000 + ``overlap`` x (1 - IoU): ``run_id, image_id, det, gt``."""

    def match(p: pd.DataFrame, g: pd.DataFrame) -> list[tuple]:
        cols = ["x1", "y1", "x2", "y2"]
        a, b = p[cols].to_numpy(float), g[cols].to_numpy(float)
        pairs = assign(width * np.abs(a[:, None] - b[None]).mean(2) / 1000 + overlap * (1 - _iou_matrix(a, b))) if len(a) and len(b) else []
        return [(int(p["det"].iloc[i]), int(g["gt"].iloc[j])) for i, j in pairs]

    return per_image(predictions, truth, match, ["det", "gt"], "run_id string, image_id string, det int, gt int")


def best_prediction(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Per run and truth box the prediction that overlaps most: ``run_id, image_id, gt, best_iou, best_score``; zeros if none."""
    seen = predictions.select("run_id", "image_id").distinct()
    pairs = overlap_pairs(predictions, truth, by_class=False)
    best = pairs.groupBy("run_id", "image_id", "gt").agg(F.max(F.struct("iou", (-F.col("det")).alias("d"), "score")).alias("m"))
    every = seen.join(truth.select("image_id", "gt"), "image_id")
    return every.join(best, ["run_id", "image_id", "gt"], "left").select("run_id", "image_id", "gt", F.coalesce("m.iou", F.lit(0.0)).alias("best_iou"), F.coalesce("m.score", F.lit(0.0)).alias("best_score"))


def fixed_errors(predictions: DataFrame, truth: DataFrame, score: float = 0.25, iou: float = 0.5, near: float = 0.1) -> DataFrame:
    """Per run: hits, misses, and false boxes that lie near a truth box or on background (confidence-greedy hits via windows)."""
    strong = predictions.filter(F.col("score") >= score)
    pairs = overlap_pairs(strong, truth, by_class=False)
    hit = evaluation_match(pairs, [iou])
    best = pairs.groupBy("run_id", "image_id", "det").agg(F.max("iou").alias("best"))
    marked = strong.join(hit.select("run_id", "image_id", "det", F.lit(1).alias("hit")), ["run_id", "image_id", "det"], "left").join(best, ["run_id", "image_id", "det"], "left")
    counts = marked.groupBy("run_id").agg(
        F.count_if(F.expr("hit = 1")).alias("hits"),
        F.count_if(F.expr(f"hit is null and best >= {near}")).alias("localisation"),
        F.count_if(F.expr(f"hit is null and coalesce(best, 0) < {near}")).alias("background"),
    )
    wanted = predictions.select("run_id", "image_id").distinct().join(truth.select("image_id", "gt"), "image_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("wanted"))
    both = wanted.join(counts, "run_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("run_id", zero("hits").alias("hits"), (zero("wanted") - zero("hits")).alias("misses"), zero("localisation").alias("localisation"), zero("background").alias("background"))


def sized_hits(predictions: DataFrame, truth: DataFrame, limits: dict[str, tuple[float, float]], iou: float = 0.5) -> DataFrame:
    """``run_id, image_id, det, size_group, tp, ignored``: the confidence-greedy matcher once per size group.

    Truth of other sizes is ignored: a prediction that only fits such truth counts neither way, as does an unmatched
    prediction that is itself of another size.
    """
    cols = ["x1", "y1", "x2", "y2"]

    def each(p: pd.DataFrame, g: pd.DataFrame) -> list[tuple]:
        a, b = p[cols].to_numpy(float), g[cols].to_numpy(float)
        area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
        ious, out = _iou_matrix(a, b) if len(a) and len(b) else np.zeros((len(a), len(b))), []
        for name, (low, high) in limits.items():
            other = (area(b) < low) | (area(b) >= high) if len(b) else np.zeros(0, bool)
            got = confident_match(ious, iou, other)
            away = (area(a) < low) | (area(a) >= high)
            out += [(int(d), name, int(k >= 0), bool(k == -2 or (k == -1 and away[i]))) for i, (d, k) in enumerate(zip(p["det"], got))]
        return out

    return per_image(predictions, truth, each, ["det", "size_group", "tp", "ignored"], "run_id string, image_id string, det int, size_group string, tp int, ignored boolean")
