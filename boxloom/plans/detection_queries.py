"""Queries over truth and predicted boxes: overlap joins, matching, suppression, precision and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions import boxes as B
from boxloom.operators import detections as D
from boxloom.operators import matching as M
from boxloom.operators import metrics as E
from boxloom.plans import shared_sql as S
from boxloom.plans.registry import Registry
from boxloom.runtime import read_table, settle

query = Registry()
QUERIES, SQL = query.queries, query.sql
_T = [0.5, 0.75]


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.truth_boxes(read_table(spark, sf_dir, "image_records")).withColumn("gt", F.col("box_no"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ranked_predictions(D.predicted_boxes(read_table(spark, sf_dir, "detections")))


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query(f"WITH {S.GT} SELECT image_id, box_no, cls, round(x1 + 1e-9, 6) AS x1, round(y1 + 1e-9, 6) AS y1, round(x2 + 1e-9, 6) AS x2, round(y2 + 1e-9, 6) AS y2 FROM gt")
def truth_boxes(spark, d):
    """Label text to corner boxes in pixels."""
    return truth(spark, d).select("image_id", "box_no", "cls", *[r6(F.col(c) + 1e-9, c) for c in ("x1", "y1", "x2", "y2")])


@query(f"""WITH {S.DET} SELECT run_id, image_id, det, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h,
 round((x1 + x2) / 2 / 640 + 1e-9, 6) AS ux, round(greatest(0.0, least(x1, 640.0)), 6) AS kx1, round(greatest(0.0, least(y2, 640.0)), 6) AS ky2, CAST(ceil((x2 - x1) / 32) * 32 AS BIGINT) AS divisible FROM det""")
def box_forms(spark, d):
    """Conversions between corner, centre and left-top form, unit shares, clipping, rounding up to a multiple."""
    p = predictions(spark, d)
    cx, cy, w, h = B.corners_to_center(B.columns())
    l, t, lw, lh = B.corners_to_ltwh(B.columns())
    back = B.center_to_corners(B.ltwh_to_center((l, t, lw, lh)))
    clipped = B.clip(B.columns(), F.lit(640.0), F.lit(640.0))
    unit = B.pixels_to_unit(B.columns(), F.lit(640.0), F.lit(640.0))
    return p.select("run_id", "image_id", "det", r6(B.corners_to_center(back)[0], "cx"), r6(cy, "cy"), r6(w, "w"), r6(lh, "h"), r6(unit[0] + 1e-9, "ux"), r6(clipped[0], "kx1"), r6(clipped[3], "ky2"), (F.ceil(w / 32) * 32).alias("divisible"))


@query(f"""WITH {S.GT}, g AS (SELECT *, least(640.0 / height, 640.0 / width) AS gain FROM gt),
p AS (SELECT *, round_even((640.0 - round_even(width * gain, 0)) / 2 - 0.1, 0) AS px, round_even((640.0 - round_even(height * gain, 0)) / 2 - 0.1, 0) AS py FROM g)
SELECT image_id, box_no, round(greatest(0.0, least((x1 - px) / gain, width)) + 1e-8, 5) AS x1, round(greatest(0.0, least((y2 - py) / gain, height)) + 1e-8, 5) AS y2 FROM p""")
def letterbox_undone(spark, d):
    """Boxes taken as lying on a padded 640 square, brought back onto their image and clipped."""
    b = B.from_letterbox(B.columns(), 640.0, F.col("width"), F.col("height"))
    return truth(spark, d).select("image_id", "box_no", F.round(b[0] + 1e-8, 5).alias("x1"), F.round(b[3] + 1e-8, 5).alias("y2"))


@query(f"""WITH {S.GT}, t AS (SELECT image_id, box_no, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, (box_no * 0.7) AS r FROM gt),
m AS (SELECT *, r - floor(r / pi()) * pi() AS q FROM t)
SELECT image_id, box_no, round(x + w / 2 * cos(r) - h / 2 * sin(r) + 1e-8, 5) AS ax, round(y + w / 2 * sin(r) + h / 2 * cos(r) + 1e-8, 5) AS ay, round(CASE WHEN q >= pi() / 2 THEN h ELSE w END + 1e-8, 5) AS rw, round(q - floor(q / (pi() / 2)) * (pi() / 2), 5) AS rr FROM m""")
def rotated_boxes(spark, d):
    """Corners of turned boxes and their regular form with the angle below a right one."""
    t = truth(spark, d).withColumn("r", F.col("box_no") * 0.7)
    x, y, w, h = B.corners_to_center(B.columns())
    ax, ay = B.rotated_corners(x, y, w, h, F.col("r"))[0]
    rw, _, rr = B.regular_rotation(w, h, F.col("r"))
    return t.select("image_id", "box_no", F.round(ax + 1e-8, 5).alias("ax"), F.round(ay + 1e-8, 5).alias("ay"), F.round(rw + 1e-8, 5).alias("rw"), F.round(rr, 5).alias("rr"))


@query(f"WITH {S.GT}, {S.DET}, {S.PAIRS} SELECT run_id, image_id, det, gt, round(iou, 6) AS iou FROM pairs WHERE iou > 0")
def box_iou(spark, d):
    """Overlap of every prediction with every truth box of its image."""
    return M.overlap_pairs(predictions(spark, d), truth(spark, d), by_class=False).filter("iou > 0").select("run_id", "image_id", "det", "gt", r6("iou", "iou"))


@query(f"WITH {S.GT}, {S.DET} SELECT d.run_id, d.image_id, d.det, g.gt, round({S.inter('g', 'd')} / ({S.area('d')} + 1e-7), 6) AS ioa FROM det d JOIN gt g ON g.image_id = d.image_id WHERE {S.inter('g', 'd')} > 0")
def box_ioa(spark, d):
    """Intersection over the prediction's own area."""
    return M.overlap_pairs(predictions(spark, d), truth(spark, d), by_class=False, kernel=B.ioa).filter("iou > 0").select("run_id", "image_id", "det", "gt", r6("iou", "ioa"))


@query(f"""WITH {S.GT}, {S.DET}, j AS (SELECT d.run_id, d.image_id, d.det, g.gt, {S.inter('g', 'd')} AS i, g.x2 - g.x1 AS w1, g.y2 - g.y1 + 1e-7 AS h1, d.x2 - d.x1 AS w2, d.y2 - d.y1 + 1e-7 AS h2,
 greatest(g.x2, d.x2) - least(g.x1, d.x1) AS hw, greatest(g.y2, d.y2) - least(g.y1, d.y1) AS hh, d.x1 + d.x2 - g.x1 - g.x2 AS dx, d.y1 + d.y2 - g.y1 - g.y2 AS dy FROM det d JOIN gt g ON g.image_id = d.image_id),
k AS (SELECT *, w1 * h1 + w2 * h2 - i + 1e-7 AS u, hw * hh + 1e-7 AS hull, hw * hw + hh * hh + 1e-7 AS diag FROM j),
f AS (SELECT *, i / u AS plain, (dx * dx + dy * dy) / 4 / diag AS apart, 4 / pi() ^ 2 * (atan(w2 / h2) - atan(w1 / h1)) ^ 2 AS v FROM k)
SELECT run_id, image_id, det, gt, round(plain, 6) AS iou, round(plain - (hull - u) / hull, 6) AS giou, round(plain - apart, 6) AS diou, round(plain - (apart + v * (v / (v - plain + (1 + 1e-7)))), 6) AS ciou FROM f WHERE i > 0""")
def box_iou_family(spark, d):
    """Plain, generalised, distance and complete overlap, element by element."""
    p = predictions(spark, d).select("run_id", "image_id", "det", *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    t = truth(spark, d).select("image_id", "gt", *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    a, b = B.columns("t_"), B.columns("p_")
    pairs = p.join(t, "image_id").filter(B.intersection(a, b) > 0)
    return pairs.select("run_id", "image_id", "det", "gt", *[r6(c, n) for n, c in B.iou_family(a, b).items()])


@query(f"""WITH {S.GT}, {S.DET}, j AS (SELECT d.run_id, d.image_id, d.det, g.gt, (g.x2 - g.x1) ^ 2 / 12 AS a1, (g.y2 - g.y1) ^ 2 / 12 AS b1, (d.x2 - d.x1) ^ 2 / 12 AS a2, (d.y2 - d.y1) ^ 2 / 12 AS b2,
 (g.x1 + g.x2) / 2 - (d.x1 + d.x2) / 2 AS dx, (g.y1 + g.y2) / 2 - (d.y1 + d.y2) / 2 AS dy FROM det d JOIN gt g ON g.image_id = d.image_id WHERE {S.inter('g', 'd')} > 0),
k AS (SELECT *, ((a1 + a2) * dy * dy + (b1 + b2) * dx * dx) / ((a1 + a2) * (b1 + b2) + 1e-7) * 0.25 + ln((a1 + a2) * (b1 + b2) / (4 * sqrt(a1 * b1 * a2 * b2) + 1e-7) + 1e-7) * 0.5 AS dist FROM j)
SELECT run_id, image_id, det, gt, round(1 - sqrt(1 - exp(-least(greatest(dist, 1e-7), 100.0)) + 1e-7), 5) AS overlap FROM k""")
def rotated_overlap(spark, d):
    """Gaussian overlap of boxes as turned boxes with angle 0."""
    p = predictions(spark, d).select("run_id", "image_id", "det", *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    t = truth(spark, d).select("image_id", "gt", *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    a, b = B.columns("t_"), B.columns("p_")
    pairs = p.join(t, "image_id").filter(B.intersection(a, b) > 0)
    turned = lambda x: (*B.corners_to_center(x), F.lit(0.0))
    return pairs.select("run_id", "image_id", "det", "gt", F.round(B.rotated_overlap(turned(a), turned(b)), 5).alias("overlap"))


@query(f"""WITH {S.GT}, k AS (SELECT image_id, box_no, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS a FROM gt)
SELECT l.image_id, l.box_no AS a_no, r.box_no AS b_no, round((exp(-((l.x1 - r.x1) ^ 2 + (l.y1 - r.y1) ^ 2) / ((2 * 0.1) * (2 * 0.1) * (l.a + 1e-7) * 2)) + exp(-((l.x2 - r.x2) ^ 2 + (l.y2 - r.y2) ^ 2) / ((2 * 0.2) * (2 * 0.2) * (l.a + 1e-7) * 2))) / 2, 6) AS oks
FROM k l JOIN k r ON l.image_id = r.image_id AND l.box_no < r.box_no""")
def keypoint_similarity(spark, d):
    """Keypoint similarity of two objects of an image with their corners as keypoints of different sigma."""
    t = truth(spark, d).select("image_id", "box_no", "x1", "y1", "x2", "y2")
    l = t.select("image_id", *[F.col(c).alias(f"l_{c}") for c in t.columns[1:]])
    r = t.select("image_id", *[F.col(c).alias(f"r_{c}") for c in t.columns[1:]])
    pairs = l.join(r, "image_id").filter("l_box_no < r_box_no")
    square = lambda i: (F.col(f"l_x{i}") - F.col(f"r_x{i}")) * (F.col(f"l_x{i}") - F.col(f"r_x{i}")) + (F.col(f"l_y{i}") - F.col(f"r_y{i}")) * (F.col(f"l_y{i}") - F.col(f"r_y{i}"))
    size = B.area(B.columns("l_"))
    oks = (B.keypoint_similarity(square(1), F.lit(0.1), size) + B.keypoint_similarity(square(2), F.lit(0.2), size)) / 2
    return pairs.select("image_id", F.col("l_box_no").alias("a_no"), F.col("r_box_no").alias("b_no"), r6(oks, "oks"))


_MATCH = f"""{S.GT}, {S.DET}, {S.PAIRS}, th AS (SELECT CAST(unnest([0.5, 0.75]) AS DOUBLE) AS threshold),
e AS (SELECT p.*, threshold, row_number() OVER (PARTITION BY run_id, image_id, threshold, det ORDER BY iou DESC, gt) AS r1 FROM pairs p JOIN th ON iou >= threshold WHERE cls = gt_cls),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, image_id, threshold, gt ORDER BY det) AS r2 FROM e WHERE r1 = 1) WHERE r2 = 1)"""


def _matches(spark, d):
    return M.evaluation_match(M.overlap_pairs(predictions(spark, d), truth(spark, d)), _T)


@query(f"WITH {_MATCH} SELECT run_id, image_id, det, gt, threshold FROM m")
def evaluation_match(spark, d):
    """The evaluation matcher at two thresholds."""
    return _matches(spark, d)


_HITS = f"""{_MATCH}, hits AS (SELECT d.run_id, d.image_id, d.det, d.cls, d.score, t.threshold, CASE WHEN m.det IS NULL THEN 0 ELSE 1 END AS tp FROM det d CROSS JOIN th t LEFT JOIN m ON m.run_id = d.run_id AND m.image_id = d.image_id AND m.det = d.det AND m.threshold = t.threshold),
counts AS (SELECT s.run_id, g.cls, count(*) AS n_truth, count(DISTINCT g.image_id) AS n_images FROM (SELECT DISTINCT run_id, image_id FROM det) s JOIN gt g ON g.image_id = s.image_id GROUP BY ALL),
curve AS (SELECT h.run_id, h.cls, h.threshold, row_number() OVER w AS k, score, n_truth, sum(tp) OVER (w ROWS UNBOUNDED PRECEDING) AS tps FROM hits h JOIN counts c ON c.run_id = h.run_id AND c.cls = h.cls WINDOW w AS (PARTITION BY h.run_id, h.cls, h.threshold ORDER BY score DESC, image_id, det)),
pr AS (SELECT *, tps / (n_truth + 1e-16) AS recall, tps / k AS precision FROM curve)"""


def _curve(spark, d):
    # ranked once: overlaps, hits and counts all read it
    p, t = settle(predictions(spark, d)), settle(truth(spark, d))
    counts = E.class_counts(p, t)
    return E.pr_curve(E.labelled_hits(p, M.evaluation_match(M.overlap_pairs(p, t), _T), _T), counts), counts


@query(f"WITH {_HITS} SELECT run_id, cls, n_truth, n_images FROM counts")
def class_counts(spark, d):
    """Truth boxes and images per run and class."""
    return E.class_counts(predictions(spark, d), truth(spark, d))


@query(f"WITH {_HITS} SELECT run_id, cls, threshold, k, round(recall, 6) AS recall, round(precision, 6) AS precision, round(max(precision) OVER (PARTITION BY run_id, cls, threshold ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 6) AS best FROM pr")
def pr_curve(spark, d):
    """Cumulative precision and recall with the precision envelope."""
    return E.envelope(_curve(spark, d)[0]).select("run_id", "cls", "threshold", "k", r6("recall", "recall"), r6("precision", "precision"), r6("best", "best"))


_AP = f"""{_HITS}, env AS (SELECT *, max(precision) OVER (PARTITION BY run_id, cls, threshold ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS best FROM pr),
pts AS (SELECT run_id, cls, threshold, k, recall AS r, best AS p FROM env UNION ALL SELECT run_id, cls, threshold, 0, 0.0, greatest(1.0, max(best)) FROM env GROUP BY ALL UNION ALL SELECT run_id, cls, threshold, 2147483647, 1.0, 0.0 FROM env GROUP BY ALL),
seg AS (SELECT *, lag(r) OVER w AS r0, lag(p) OVER w AS p0 FROM pts WINDOW w AS (PARTITION BY run_id, cls, threshold ORDER BY k)),
smp AS (SELECT s.*, i, p0 + (p - p0) * (i / 100 - r0) / (r - r0) AS v FROM seg s, range(1, 101) x(i) WHERE i / 100 > r0 + 1e-11 AND i / 100 <= r + 1e-11),
ap AS (SELECT run_id, cls, threshold, (sum(CASE WHEN i = 100 THEN 0.5 ELSE 1.0 END * v) + 0.5) / 100 AS ap FROM smp GROUP BY ALL),
full_ap AS (SELECT c.run_id, c.cls, t.threshold, coalesce(ap, 0.0) AS ap FROM counts c CROSS JOIN th t LEFT JOIN ap ON ap.run_id = c.run_id AND ap.cls = c.cls AND ap.threshold = t.threshold)"""


@query(f"WITH {_AP} SELECT run_id, cls, threshold, round(ap, 6) AS ap FROM full_ap")
def average_precision(spark, d):
    """Average precision per run, class and threshold, sampled at 101 recalls."""
    return E.average_precision(*_curve(spark, d), _T).select("run_id", "cls", "threshold", r6("ap", "ap"))


@query(f"WITH {_AP} SELECT run_id, round(avg(ap) FILTER (threshold = 0.5), 6) AS map50, round(avg(ap) FILTER (threshold = 0.75), 6) AS map75, round(avg(ap), 6) AS map FROM full_ap GROUP BY run_id")
def map_summary(spark, d):
    """Mean average precision per run."""
    return E.summary(E.average_precision(*_curve(spark, d), _T)).select("run_id", r6("map50", "map50"), r6("map75", "map75"), r6("map", "map"))


@query(f"WITH {_HITS}, f AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-16) AS f1 FROM pr), r AS (SELECT *, row_number() OVER (PARTITION BY run_id, cls, threshold ORDER BY f1 DESC, k) AS rk FROM f) SELECT run_id, cls, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, score FROM r WHERE rk = 1")
def operating_point(spark, d):
    """The point of greatest F1."""
    return E.operating_point(_curve(spark, d)[0]).select("run_id", "cls", "threshold", r6("precision", "precision"), r6("recall", "recall"), r6("f1", "f1"), "score")


_CONF = f"""{S.GT}, {S.DET}, {S.PAIRS}, e AS (SELECT *, row_number() OVER (PARTITION BY run_id, image_id, det ORDER BY iou DESC, gt) AS r1 FROM pairs WHERE iou > 0.45 AND score > 0.25),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, image_id, gt ORDER BY iou DESC, det) AS r2 FROM e WHERE r1 = 1) WHERE r2 = 1),
conf AS (SELECT run_id, predicted, actual, count(*) AS n FROM (SELECT run_id, cls AS predicted, gt_cls AS actual FROM m
 UNION ALL SELECT s.run_id, -1, g.cls FROM (SELECT DISTINCT run_id, image_id FROM det) s JOIN gt g ON g.image_id = s.image_id WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.run_id = s.run_id AND m.image_id = s.image_id AND m.gt = g.gt)
 UNION ALL SELECT d.run_id, d.cls, -1 FROM det d WHERE score > 0.25 AND NOT EXISTS (SELECT 1 FROM m WHERE m.run_id = d.run_id AND m.image_id = d.image_id AND m.det = d.det)) GROUP BY ALL)"""


@query(f"WITH {_CONF} SELECT run_id, predicted, actual, n, round(n / (sum(n) OVER (PARTITION BY run_id, actual) + 1e-9), 6) AS share FROM conf")
def confusion_matrix(spark, d):
    """Confusion counts with the background, and shares per true class."""
    return E.confusion_rates(M.confusion_counts(predictions(spark, d), truth(spark, d))).select("run_id", "predicted", "actual", "n", r6("share", "share"))


@query(f"WITH {S.DET} SELECT d.run_id, d.image_id, d.cls, d.det, d.score FROM det d WHERE NOT EXISTS (SELECT 1 FROM det h WHERE h.run_id = d.run_id AND h.image_id = d.image_id AND h.cls = d.cls AND h.det < d.det AND {S.iou('h', 'd')} >= 0.5)")
def fast_nms(spark, d):
    """One-shot suppression."""
    return M.fast_nms(predictions(spark, d), 0.5).select("run_id", "image_id", "cls", "det", "score")


_NMS = f"""WITH RECURSIVE {S.DET}, s AS (SELECT *, row_number() OVER (PARTITION BY run_id, image_id, cls ORDER BY det) AS k FROM det WHERE score > 0.25),
walk(run_id, image_id, cls, k, kept) AS (
  SELECT run_id, image_id, cls, k, [struct_pack(det := det, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] FROM s WHERE k = 1
  UNION ALL
  SELECT s.run_id, s.image_id, s.cls, s.k, CASE WHEN len(list_filter(w.kept, lambda h: (greatest(least(h.x2, s.x2) - greatest(h.x1, s.x1), 0.0) * greatest(least(h.y2, s.y2) - greatest(h.y1, s.y1), 0.0)) / ((h.x2 - h.x1) * (h.y2 - h.y1) + (s.x2 - s.x1) * (s.y2 - s.y1) - (greatest(least(h.x2, s.x2) - greatest(h.x1, s.x1), 0.0) * greatest(least(h.y2, s.y2) - greatest(h.y1, s.y1), 0.0)) + 1e-7) > 0.5)) = 0
    THEN list_append(w.kept, struct_pack(det := s.det, x1 := s.x1, y1 := s.y1, x2 := s.x2, y2 := s.y2)) ELSE w.kept END
  FROM walk w JOIN s ON s.run_id = w.run_id AND s.image_id = w.image_id AND s.cls = w.cls AND s.k = w.k + 1),
last AS (SELECT run_id, image_id, cls, arg_max(kept, k) AS kept FROM walk GROUP BY ALL)
SELECT run_id, image_id, cls, unnest(list_transform(kept, lambda h: h.det)) AS det FROM last"""


@query(_NMS)
def greedy_nms(spark, d):
    """Sequential suppression per class after a score limit."""
    kept = M.greedy_nms(predictions(spark, d).filter("score > 0.25"), 0.5, most=None, candidates=None)
    return kept.select("run_id", "image_id", "cls", "det")


_PIPE = _NMS.replace("SELECT *, row_number() OVER (PARTITION BY run_id, image_id, cls ORDER BY det) AS k FROM det WHERE score > 0.25", "SELECT *, row_number() OVER (PARTITION BY run_id, image_id, cls ORDER BY det) AS k FROM strong").replace("s AS (SELECT", "strong AS (SELECT * EXCLUDE det, row_number() OVER (PARTITION BY run_id, image_id ORDER BY score DESC, cls, x1, y1, x2, y2) AS det FROM det WHERE score > 0.1 AND cls = 0), s AS (SELECT", 1).replace("+ 1e-7) > 0.5", "+ 1e-7) > 0.7")
_PIPE = f"SELECT k.*, s.score FROM ({_PIPE}) k JOIN (SELECT run_id, image_id, row_number() OVER (PARTITION BY run_id, image_id ORDER BY score DESC, cls, x1, y1, x2, y2) AS det, score FROM (WITH {S.DET} SELECT * FROM det WHERE score > 0.1 AND cls = 0)) s USING (run_id, image_id, det) QUALIFY row_number() OVER (PARTITION BY k.run_id, k.image_id ORDER BY k.det) <= 300"


@query(_PIPE)
def suppression_pipeline(spark, d):
    """Score limit, class choice, rank, suppression and limit per image in one plan."""
    return M.suppress(D.predicted_boxes(read_table(spark, d, "detections")), 0.1, 0.7, [0], 300).select("run_id", "image_id", "cls", "det", "score")


_GREEDY = f"""WITH RECURSIVE {S.GT}, {S.DET}, {S.PAIRS}, ok AS (SELECT * FROM pairs WHERE iou >= 0.5),
cand AS (SELECT d.run_id, d.image_id, d.det, coalesce(list(o.gt ORDER BY o.iou DESC, o.gt) FILTER (o.gt IS NOT NULL), []) AS gts FROM det d LEFT JOIN ok o ON o.run_id = d.run_id AND o.image_id = d.image_id AND o.det = d.det GROUP BY ALL),
walk(run_id, image_id, k, used) AS (
  SELECT run_id, image_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM (SELECT DISTINCT run_id, image_id FROM det)
  UNION ALL
  SELECT w.run_id, w.image_id, c.det, list_concat(w.used, list_filter(c.gts, lambda g: NOT list_contains(w.used, g))[1:1]) FROM walk w JOIN cand c ON c.run_id = w.run_id AND c.image_id = w.image_id AND c.det = w.k + 1),
hit AS (SELECT run_id, image_id, len(arg_max(used, k)) AS tp FROM walk GROUP BY ALL),
ord AS (SELECT *, row_number() OVER (PARTITION BY run_id, image_id ORDER BY iou DESC, gt DESC, det DESC) AS r FROM ok),
turn(run_id, image_id, r, dets, gts) AS (
  SELECT run_id, image_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM (SELECT DISTINCT run_id, image_id FROM det)
  UNION ALL
  SELECT t.run_id, t.image_id, o.r, CASE WHEN list_contains(t.dets, o.det) OR list_contains(t.gts, o.gt) THEN t.dets ELSE list_append(t.dets, o.det) END, CASE WHEN list_contains(t.dets, o.det) OR list_contains(t.gts, o.gt) THEN t.gts ELSE list_append(t.gts, o.gt) END
  FROM turn t JOIN ord o ON o.run_id = t.run_id AND o.image_id = t.image_id AND o.r = t.r + 1),
over AS (SELECT run_id, image_id, len(arg_max(dets, r)) AS tp_overlap FROM turn GROUP BY ALL),
nd AS (SELECT run_id, image_id, count(*) AS n FROM det GROUP BY ALL), ng AS (SELECT image_id, count(*) AS n FROM gt GROUP BY ALL)
SELECT run_id, image_id, CAST(tp AS INT) AS tp, CAST(nd.n - tp AS INT) AS fp, CAST(coalesce(ng.n, 0) - tp AS INT) AS fn, CAST(tp_overlap AS INT) AS tp_overlap FROM hit JOIN over USING (run_id, image_id) JOIN nd USING (run_id, image_id) LEFT JOIN ng USING (image_id)"""


@query(_GREEDY)
def greedy_matches(spark, d):
    """Hits per image by the confidence-greedy and the overlap-first matcher."""
    return M.greedy_hits(predictions(spark, d), truth(spark, d))


@query()
def optimal_assignment(spark, d):
    """Optimal one-to-one assignment of predictions to truth per image."""
    return M.set_match(predictions(spark, d), truth(spark, d))


@query(f"WITH {S.GT}, {S.DET}, nd AS (SELECT run_id, image_id, count(*) AS n FROM det GROUP BY ALL), ng AS (SELECT image_id, count(*) AS n FROM gt GROUP BY ALL) SELECT run_id, image_id, least(nd.n, ng.n) AS pairs, 0 AS repeated, true AS no_swap FROM nd JOIN ng USING (image_id)")
def assignment_checks(spark, d):
    """Per image what must hold for the optimal assignment: all of the smaller side is assigned, nothing twice, and no two pairs gain by swapping."""
    p, t = settle(predictions(spark, d)), settle(truth(spark, d))
    made = settle(M.set_match(p, t))
    side = lambda df, n: df.select(*(["run_id"] if n == "det" else []), "image_id", n, *[F.col(c).alias(f"{n}_{c}") for c in ("x1", "y1", "x2", "y2")])
    whole = made.join(side(p, "det"), ["run_id", "image_id", "det"]).join(side(t, "gt"), ["image_id", "gt"])
    box = lambda n, k: tuple(F.col(f"{n}.{k}_{c}") for c in ("x1", "y1", "x2", "y2"))

    def cost(x, y):
        a, b = box(x, "det"), box(y, "gt")
        return 5.0 * sum((F.abs(u - v) for u, v in zip(a, b)), F.lit(0.0)) / 4 / 1000 + 2.0 * (1 - B.iou(a, b))

    two = whole.alias("a").join(whole.alias("b"), (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.det") < F.col("b.det")))
    gain = two.select(F.col("a.run_id").alias("run_id"), F.col("a.image_id").alias("image_id"), (cost("a", "a") + cost("b", "b") - cost("a", "b") - cost("b", "a") > 1e-9).alias("gain")).groupBy("run_id", "image_id").agg(F.count_if("gain").alias("swaps"))
    per = made.groupBy("run_id", "image_id").agg(F.count(F.lit(1)).alias("pairs"), (2 * F.count(F.lit(1)) - F.count_distinct("det") - F.count_distinct("gt")).alias("repeated"))
    return per.join(gain, ["run_id", "image_id"], "left").select("run_id", "image_id", "pairs", "repeated", (F.coalesce("swaps", F.lit(0)) == 0).alias("no_swap"))


_BEST = f"{S.GT}, {S.DET}, {S.PAIRS}, b AS (SELECT s.run_id, s.image_id, g.gt, coalesce(max(p.iou), 0.0) AS best_iou, coalesce(first(p.score ORDER BY p.iou DESC, p.det), 0.0) AS best_score FROM (SELECT DISTINCT run_id, image_id FROM det) s JOIN gt g ON g.image_id = s.image_id LEFT JOIN pairs p ON p.run_id = s.run_id AND p.image_id = s.image_id AND p.gt = g.gt GROUP BY ALL)"


@query(f"WITH {_BEST} SELECT run_id, image_id, gt, round(best_iou, 6) AS best_iou, best_score FROM b")
def best_prediction(spark, d):
    """The best overlapping prediction per run and truth box, zeros if there is none."""
    return M.best_prediction(predictions(spark, d), truth(spark, d)).select("run_id", "image_id", "gt", r6("best_iou", "best_iou"), "best_score")


@query(f"""WITH {_BEST} SELECT a.image_id, a.gt, count(*) AS runs, count_if(best_iou >= 0.5) AS hit_runs, round(max(best_iou) - min(best_iou), 6) AS spread,
 count_if(best_iou >= 0.5 AND best_score >= 0.5) AS sure_hits, count_if(best_iou < 0.1) AS lost FROM b a GROUP BY ALL""")
def target_transitions(spark, d):
    """Per truth box over all runs: hits, sure hits, losses and the spread of the best overlap."""
    b = M.best_prediction(predictions(spark, d), truth(spark, d))
    return b.groupBy("image_id", "gt").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.expr("best_iou >= 0.5")).alias("hit_runs"), r6(F.max("best_iou") - F.min("best_iou"), "spread"), F.count_if(F.expr("best_iou >= 0.5 and best_score >= 0.5")).alias("sure_hits"), F.count_if(F.expr("best_iou < 0.1")).alias("lost"))


@query(f"""WITH {S.GT}, {S.DET}, {S.PAIRS}, e AS (SELECT *, row_number() OVER (PARTITION BY run_id, image_id, det ORDER BY iou DESC, gt) AS r1 FROM pairs WHERE iou >= 0.5 AND score >= 0.25),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, image_id, gt ORDER BY det) AS r2 FROM e WHERE r1 = 1) WHERE r2 = 1),
x AS (SELECT d.run_id, m.det IS NOT NULL AS hit, coalesce((SELECT max(iou) FROM pairs p WHERE p.run_id = d.run_id AND p.image_id = d.image_id AND p.det = d.det), 0.0) AS best FROM det d LEFT JOIN m ON m.run_id = d.run_id AND m.image_id = d.image_id AND m.det = d.det WHERE d.score >= 0.25),
c AS (SELECT run_id, count_if(hit) AS hits, count_if(NOT hit AND best >= 0.1) AS localisation, count_if(NOT hit AND best < 0.1) AS background FROM x GROUP BY run_id),
w AS (SELECT s.run_id, count(*) AS wanted FROM (SELECT DISTINCT run_id, image_id FROM det) s JOIN gt g ON g.image_id = s.image_id GROUP BY s.run_id)
SELECT coalesce(w.run_id, c.run_id) AS run_id, coalesce(hits, 0) AS hits, coalesce(wanted, 0) - coalesce(hits, 0) AS misses, coalesce(localisation, 0) AS localisation, coalesce(background, 0) AS background FROM w FULL JOIN c ON w.run_id = c.run_id""")
def fixed_threshold_errors(spark, d):
    """Hits, misses, badly placed and background boxes per run at fixed limits."""
    return M.fixed_errors(predictions(spark, d), truth(spark, d))


@query(f"""WITH {S.GT}, s AS (SELECT image_id, sqrt((x2 - x1) * (y2 - y1)) AS side, sqrt((x2 - x1) * least(640.0 / width, 640.0 / height) * ((y2 - y1) * least(640.0 / width, 640.0 / height))) AS side640, width, height FROM gt),
n AS (SELECT 'native' AS space, CASE WHEN side < 16 THEN 'tiny' WHEN side < 32 THEN 'small' WHEN side < 96 THEN 'medium' ELSE 'large' END AS size_group FROM s UNION ALL SELECT 'at640', CASE WHEN side640 < 16 THEN 'tiny' WHEN side640 < 32 THEN 'small' WHEN side640 < 96 THEN 'medium' ELSE 'large' END FROM s)
SELECT space, size_group, count(*) AS boxes FROM n GROUP BY ALL""")
def size_groups(spark, d):
    """Boxes per size group in native pixels and at side 640."""
    t = truth(spark, d)
    x, y, w, h = B.corners_to_center(B.columns())
    fit = F.least(F.lit(640.0) / F.col("width"), F.lit(640.0) / F.col("height"))
    kinds = F.explode(F.array(F.struct(F.lit("native").alias("space"), B.size_name(F.sqrt(w * h)).alias("size_group")), F.struct(F.lit("at640").alias("space"), B.size_name(F.sqrt(w * fit * (h * fit))).alias("size_group"))))
    return t.select(kinds.alias("k")).select("k.*").groupBy("space", "size_group").agg(F.count(F.lit(1)).alias("boxes"))


@query(f"WITH {S.DET} SELECT image_id, cls AS category_id, [round(x1 + 1e-9, 3), round(y1 + 1e-9, 3), round(x2 - x1 + 1e-9, 3), round(y2 - y1 + 1e-9, 3)] AS bbox, round(score + 1e-9, 5) AS score FROM det")
def coco_records(spark, d):
    """Predictions in the interchange form."""
    return D.coco_records(predictions(spark, d))


@query(f"""WITH {S.GT}, {S.DET} SELECT d.run_id, d.image_id, d.det, g.gt FROM det d JOIN gt g ON g.image_id = d.image_id
 WHERE least((d.x1 + d.x2) / 2 - g.x1, (d.y1 + d.y2) / 2 - g.y1, g.x2 - (d.x1 + d.x2) / 2, g.y2 - (d.y1 + d.y2) / 2) > 1e-9""")
def centers_in_truth(spark, d):
    """Predictions whose centre lies strictly inside a truth box."""
    p = predictions(spark, d)
    cx, cy, _, _ = B.corners_to_center(B.columns())
    c = p.select("run_id", "image_id", "det", cx.alias("cx"), cy.alias("cy"))
    t = truth(spark, d).select("image_id", "gt", "x1", "y1", "x2", "y2")
    deep = F.least(F.col("cx") - F.col("x1"), F.col("cy") - F.col("y1"), F.col("x2") - F.col("cx"), F.col("y2") - F.col("cy"))
    return c.join(t, "image_id").filter(deep > 1e-9).select("run_id", "image_id", "det", "gt")


@query(f"WITH {S.DET}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, image_id, det) AS k FROM det WHERE x2 - x1 > 0 AND y2 - y1 > 0) SELECT run_id, k, image_id, det, score FROM r WHERE k <= 10")
def top_scores(spark, d):
    """The ten best boxes of each run with an area."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("run_id").orderBy(F.desc("score"), "image_id", "det")
    return predictions(spark, d).filter("x2 - x1 > 0 and y2 - y1 > 0").withColumn("k", F.row_number().over(w)).filter("k <= 10").select("run_id", "k", "image_id", "det", "score")


@query(f"""WITH {S.GT}, {S.DET} SELECT run_id, image_id, det, CASE WHEN {S.inter('f', 'd').replace('f.x1', '0.0').replace('f.y1', '0.0').replace('f.x2', 'width').replace('f.y2', 'height')} / (width * height + {S.area('d')} - {S.inter('f', 'd').replace('f.x1', '0.0').replace('f.y1', '0.0').replace('f.x2', 'width').replace('f.y2', 'height')} + 1e-7) > 0.9 THEN true ELSE false END AS whole_frame,
 (abs(x1 - 0) <= 20 OR abs(y1 - 0) <= 20 OR abs(x2 - width) <= 20 OR abs(y2 - height) <= 20) AS near_border FROM det d JOIN (SELECT DISTINCT image_id AS i, width, height FROM gt) z ON z.i = d.image_id""")
def border_boxes(spark, d):
    """Boxes that as good as fill the frame, and boxes within 20 px of its border."""
    frames = truth(spark, d).select("image_id", "width", "height").distinct()
    p = predictions(spark, d).join(frames, "image_id")
    frame = (F.lit(0.0), F.lit(0.0), F.col("width").cast("double"), F.col("height").cast("double"))
    near = lambda a, b: F.abs(F.col(a) - b) <= 20
    return p.select("run_id", "image_id", "det", (B.iou(frame, B.columns()) > 0.9).alias("whole_frame"), (near("x1", 0) | near("y1", 0) | near("x2", F.col("width")) | near("y2", F.col("height"))).alias("near_border"))


_AREAS = {"small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, float("inf"))}


@query()
def average_precision_by_size(spark, d):
    """Average precision per run and size group at 0.5, truth of other sizes ignored."""
    p, t = predictions(spark, d), truth(spark, d)
    hits = M.sized_hits(p, t, _AREAS).filter("not ignored").join(p.select("run_id", "image_id", "det", "score"), ["run_id", "image_id", "det"])
    x, y, w, h = B.corners_to_center(B.columns())
    group = F.when(w * h < 32.0**2, 0).when(w * h < 96.0**2, 1).otherwise(2)
    counts = E.class_counts(p, t.withColumn("cls", group))
    # the size group takes the place of the class
    sized = hits.withColumn("cls", F.when(F.col("size_group") == "small", 0).when(F.col("size_group") == "medium", 1).otherwise(2)).withColumn("threshold", F.lit(0.5))
    ap = E.average_precision(E.pr_curve(sized, counts), counts, [0.5])
    return ap.select("run_id", F.element_at(F.array(*[F.lit(n) for n in _AREAS]), F.col("cls") + 1).alias("size_group"), r6("ap", "ap"))


@query()
def common_operating_point(spark, d):
    """Precision, recall and F1 of each class at the score where the smoothed mean F1 peaks."""
    out = E.common_operating_point(_curve(spark, d)[0])
    return out.select("run_id", "cls", "threshold", r6("score", "score"), r6("precision", "precision"), r6("recall", "recall"), r6("f1", "f1"))
