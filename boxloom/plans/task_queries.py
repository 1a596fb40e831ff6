"""Average precision of turned boxes, keypoints and masks, soft labels, image files and reports per format.

The tables hold boxes only, so turned boxes get an angle from their number, keypoints are two corners, and masks are
the cells of a coarse grid that a box covers; what is matched and scored are these shapes and not the boxes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.functions import boxes as B
from boxloom.functions import digests as D
from boxloom.operators import matching as M
from boxloom.operators import metrics as E
from boxloom.plans import shared_sql as S
from boxloom.plans.detection_queries import _AP, _T, predictions, r6, truth
from boxloom.plans.more_queries import thumbs
from boxloom.plans.registry import Registry
from boxloom.runtime import read_table, scratch_path, settle
from boxloom.sources import readers

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _ap_sql(overlap: str, extra: str = "") -> str:
    pairs = f"{extra}pairs AS (SELECT d.run_id, d.image_id, d.det, g.gt, d.cls, g.cls AS gt_cls, d.score, {overlap} AS iou FROM det d JOIN gt g ON g.image_id = d.image_id)"
    return f"WITH {_AP.replace(S.PAIRS, pairs)} SELECT run_id, cls, threshold, round(ap, 6) AS ap FROM full_ap"


def _ap(p, t, kernel, shape):
    """Average precision where ``kernel`` over the columns ``shape`` takes the place of the overlap of boxes."""
    p, t = settle(p), settle(t)
    counts = E.class_counts(p, t)
    hits = E.labelled_hits(p, M.evaluation_match(M.overlap_pairs(p, t, True, kernel, shape), _T), _T)
    return E.average_precision(E.pr_curve(hits, counts), counts, _T).select("run_id", "cls", "threshold", r6("ap", "ap"))


def _gauss(side: str, n: int) -> str:
    w, h, r = f"(({side}.x2 - {side}.x1) ^ 2 / 12)", f"(({side}.y2 - {side}.y1) ^ 2 / 12)", f"({side}.{n} % 4 * 0.3)"
    return f"{w} * cos({r}) ^ 2 + {h} * sin({r}) ^ 2", f"{w} * sin({r}) ^ 2 + {h} * cos({r}) ^ 2", f"({w} - {h}) * cos({r}) * sin({r})"


_A1, _B1, _C1 = _gauss("g", "gt")
_A2, _B2, _C2 = _gauss("d", "det")
_TURNED = f"""j AS (SELECT d.run_id, d.image_id, d.det, g.gt, {_A1} AS a1, {_B1} AS b1, {_C1} AS c1, {_A2} AS a2, {_B2} AS b2, {_C2} AS c2, (g.x1 + g.x2 - d.x1 - d.x2) / 2 AS dx, (g.y1 + g.y2 - d.y1 - d.y2) / 2 AS dy FROM det d JOIN gt g ON g.image_id = d.image_id),
j2 AS (SELECT *, (a1 + a2) * (b1 + b2) - (c1 + c2) ^ 2 AS dt FROM j),
j3 AS (SELECT run_id, image_id, det, gt, ((a1 + a2) * dy * dy + (b1 + b2) * dx * dx) / (dt + 1e-7) * 0.25 + (c1 + c2) * -dx * dy / (dt + 1e-7) * 0.5 + ln(dt / (4 * sqrt(greatest(a1 * b1 - c1 * c1, 0.0) * greatest(a2 * b2 - c2 * c2, 0.0)) + 1e-7) + 1e-7) * 0.5 AS dist FROM j2), """


@query(_ap_sql("(SELECT 1 - sqrt(1 - exp(-least(greatest(dist, 1e-7), 100.0)) + 1e-7) FROM j3 WHERE j3.run_id = d.run_id AND j3.image_id = d.image_id AND j3.det = d.det AND j3.gt = g.gt)", _TURNED))
def average_precision_turned(spark, d):
    """Average precision of turned boxes by their Gaussian overlap."""
    turned = lambda df, n: df.withColumn("angle", F.col(n) % 4 * 0.3)
    shape = lambda b: (*B.corners_to_center(b[:4]), b[4])
    kernel = lambda a, b: B.rotated_overlap(shape(a), shape(b))
    return _ap(turned(predictions(spark, d), "det"), turned(truth(spark, d), "gt"), kernel, ("x1", "y1", "x2", "y2", "angle"))


_OKS = " + ".join(f"exp(-((g.x{i} - d.x{i}) ^ 2 + (g.y{i} - d.y{i}) ^ 2) / ((2 * {s}) * (2 * {s}) * ((g.x2 - g.x1) * (g.y2 - g.y1) * 0.53 + 1e-7) * 2))" for i, s in ((1, 0.1), (2, 0.2)))


@query(_ap_sql(f"({_OKS}) / 2"))
def average_precision_keypoints(spark, d):
    """Average precision of keypoints by their similarity, with about half of the box as the object's area."""

    def kernel(a, b):
        size = B.area(a) * 0.53
        far = lambda x, y: (a[x] - b[x]) * (a[x] - b[x]) + (a[y] - b[y]) * (a[y] - b[y])
        return (B.keypoint_similarity(far(0, 1), F.lit(0.1), size) + B.keypoint_similarity(far(2, 3), F.lit(0.2), size)) / 2

    return _ap(predictions(spark, d), truth(spark, d), kernel, ("x1", "y1", "x2", "y2"))


#: Side of a mask cell in pixels; masks have 8 x 8 cells.
CELL = 240


def _in(side: str, a: str, b: str) -> str:
    return f"len(list_filter(range(0, 8), lambda i: {CELL} * i + {CELL // 2} >= {side}.{a} AND {CELL} * i + {CELL // 2} <= {side}.{b}))"


def _both(a: str, b: str) -> str:
    return f"len(list_filter(range(0, 8), lambda i: {CELL} * i + {CELL // 2} >= greatest(g.{a}, d.{a}) AND {CELL} * i + {CELL // 2} <= least(g.{b}, d.{b})))"


_INTER = f"({_both('x1', 'x2')} * {_both('y1', 'y2')})"


@query(_ap_sql(f"{_INTER} / ({_in('g', 'x1', 'x2')} * {_in('g', 'y1', 'y2')} + {_in('d', 'x1', 'x2')} * {_in('d', 'y1', 'y2')} - {_INTER} + 1e-7)"))
def average_precision_masks(spark, d):
    """Average precision of masks, each a number with a bit per cell, by common and joint bits."""
    middle = lambda i: i * CELL + CELL // 2
    bits = lambda a, b: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("bigint"), lambda n, i: n + F.when((middle(i) >= F.col(a)) & (middle(i) <= F.col(b)), F.pow(F.lit(2), i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    rows = lambda df: df.withColumn("_x", bits("x1", "x2")).withColumn("_y", bits("y1", "y2"))
    # the rows of the mask that the box covers hold its columns
    mask = sum((F.shiftleft(F.when(F.col("_y").bitwiseAND(1 << k) > 0, F.col("_x")).otherwise(F.lit(0).cast("bigint")), 8 * k) for k in range(1, 8)), F.when(F.col("_y").bitwiseAND(1) > 0, F.col("_x")).otherwise(F.lit(0).cast("bigint")))
    masked = lambda df: rows(df).withColumn("mask", mask).drop("_x", "_y")

    def kernel(a, b):
        common = F.bit_count(a[0].bitwiseAND(b[0]))
        return common / (F.bit_count(a[0]) + F.bit_count(b[0]) - common + 1e-7)

    return _ap(masked(predictions(spark, d)), masked(truth(spark, d)), kernel, ("mask",))


@query(f"WITH {S.GT} SELECT image_id, box_no, c AS cls, CASE WHEN c = cls THEN 0.95 ELSE 0.05 END AS target FROM gt, range(0, 3) r(c)")
def soft_labels(spark, d):
    """Smoothed targets of three classes for every truth box."""
    positive, negative = B.smoothed_pair(0.1)
    t = truth(spark, d).select("image_id", "box_no", F.col("cls").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("cls"))
    return t.select("image_id", "box_no", "cls", F.when(F.col("own") == F.col("cls"), positive).otherwise(negative).alias("target"))


_TH = "th AS (SELECT DISTINCT r.record_id AS record_id, lower(r.thumb_sig) AS t FROM (SELECT unnest(records) AS r FROM audit) WHERE regexp_full_match(r.thumb_sig, '[0-9a-fA-F]{64}'))"


@query(f"WITH {_TH} SELECT record_id, sha256('8x8:' || t) AS pixel_hash FROM th")
def pixel_hashes(spark, d):
    """A digest of size and pixels of each thumbnail: equal for equal pictures, whatever file they are in."""
    return thumbs(spark, d).select("record_id", D.pixel_hash(F.lit(8), F.lit(8), F.encode("thumb", "UTF-8")).alias("pixel_hash"))


@query(f"""WITH {_TH}, c AS (SELECT record_id, list_transform(range(1, 65), lambda i: CAST(('0x' || t[i]) AS INT)) AS v FROM th),
l AS (SELECT record_id, v, list_transform(list_filter(range(0, 64), lambda i: i // 8 BETWEEN 1 AND 6 AND i % 8 BETWEEN 1 AND 6), lambda i: v[i - 7] + v[i + 9] + v[i] + v[i + 2] - 4 * v[i + 1]) AS lap FROM c),
g AS (SELECT *, list_transform(list_filter(range(0, 64), lambda i: i // 8 BETWEEN 1 AND 6 AND i % 8 BETWEEN 1 AND 6), lambda i: (v[i - 6] + 2 * v[i + 2] + v[i + 10] - v[i - 8] - 2 * v[i] - v[i + 8]) ^ 2 + (v[i + 8] + 2 * v[i + 9] + v[i + 10] - v[i - 8] - 2 * v[i - 7] - v[i - 6]) ^ 2) AS sobel FROM l)
SELECT record_id, round(list_var_pop(lap), 6) AS laplacian, round(list_avg(sobel), 6) AS tenengrad FROM g""")
def sharpness(spark, d):
    """Variance of the Laplacian and mean squared gradient of each thumbnail's inner cells."""
    cells = F.transform(F.filter(F.split("thumb", ""), lambda c: c != ""), lambda c: F.conv(c, 16, 10).cast("int"))
    lap, ten = D.sharpness(F.col("v"), 8, 8)
    return thumbs(spark, d).withColumn("v", cells).select("record_id", r6(lap, "laplacian"), r6(ten, "tenengrad"))


@query("""WITH e AS (SELECT DISTINCT * FROM epoch_log), m AS (SELECT run_id, list_extract(['onnx', 'torchscript', 'engine'], CAST(right(run_id, 1) AS INT) % 3 + 1) AS format, max(metric_map50_95) AS score, avg(elapsed_s) AS seconds FROM e GROUP BY run_id)
SELECT format, count(*) AS runs, round(max(score), 6) AS best, round(avg(score), 6) AS mean, count_if(score IS NULL) AS failed, round(1000 * avg(seconds), 4) AS ms FROM m GROUP BY format""")
def format_report(spark, d):
    """Score, time and failures per export format, with runs in the place of exported models."""
    log = read_table(spark, d, "epoch_log").distinct()
    runs = log.groupBy("run_id").agg(F.max("metric_map50_95").alias("score"), F.avg("elapsed_s").alias("seconds"))
    named = runs.withColumn("format", F.element_at(F.array(*[F.lit(x) for x in ("onnx", "torchscript", "engine")]), F.right("run_id", F.lit(1)).cast("int") % 3 + 1))
    return E.format_report(named, "format", "score", "seconds")


_IMAGES = f"""{_TH}, im AS (SELECT record_id, t, CASE record_id % 4 WHEN 0 THEN 'ffd8ff' WHEN 1 THEN '89504e470d0a1a0a' WHEN 2 THEN '424d' ELSE '474946' END AS magic, record_id % 5 <> 0 AS whole, 1 + record_id % 8 AS turn FROM th)"""


@query(f"WITH {_IMAGES} SELECT record_id, CASE record_id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'bmp' END AS kind, CASE record_id % 4 WHEN 0 THEN whole WHEN 3 THEN false ELSE true END AS ok, CASE WHEN turn IN (6, 8) THEN 3 ELSE 4 END AS width, CASE WHEN turn IN (6, 8) THEN 4 ELSE 3 END AS height FROM im")
def image_headers(spark, d):
    """Kind, wholeness and turned size of image files made of the thumbnails, some of them cut or of no known kind."""
    n = F.col("record_id")
    magic = F.element_at(F.array(*[F.lit(x) for x in ("FFD8FF", "89504E470D0A1A0A", "424D", "474946")]), (n % 4 + 1).cast("int"))
    files = thumbs(spark, d).select("record_id", F.unhex(F.concat(magic, "thumb", F.when(n % 5 != 0, "FFD9").otherwise("00"))).alias("content"))
    header = readers.image_header(F.col("content"))
    width, height = readers.turned_size(F.lit(4), F.lit(3), 1 + n % 8)
    return files.select("record_id", header["kind"].alias("kind"), header["ok"].alias("ok"), width.alias("width"), height.alias("height"))


@query(f"WITH {S.GT} SELECT image_id || '_' || box_no AS name, [round(x1, 3), round(y1, 3), round(x2, 3), round(y1, 3), round(x2, 3), round(y2, 3), round(x1, 3), round(y2, 3)] AS corners FROM gt")
def rotated_round_trip(spark, d):
    """Truth boxes as files of eight coordinates and a name per line, written and read again."""
    path = scratch_path(spark, "rotated")
    r = lambda c: F.round(c, 3)
    line = F.concat_ws(" ", *[r(c).cast("string") for c in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")], F.concat("image_id", F.lit("_"), "box_no"))
    truth(spark, d).select(line.alias("value")).write.text(path)
    return readers.read_rotated(spark, path).select("name", F.transform("corners", lambda c: F.round(c, 3)).alias("corners"))


@query(f"WITH {S.GT} SELECT image_id AS filename, CAST(width AS INT) AS width, CAST(height AS INT) AS height, CAST(box_no AS VARCHAR) AS name, round(x1, 3) AS x1, round(y1, 3) AS y1, round(x2, 3) AS x2, round(y2, 3) AS y2 FROM gt")
def voc_round_trip(spark, d):
    """Truth boxes as annotation files in XML, one element per image, written and read again."""
    path = scratch_path(spark, "voc")
    r = lambda c: F.round(c, 3)
    box = F.struct(r("x1").alias("xmin"), r("y1").alias("ymin"), r("x2").alias("xmax"), r("y2").alias("ymax"))
    objects = truth(spark, d).groupBy(F.col("image_id").alias("filename"), F.struct("width", "height").alias("size")).agg(F.collect_list(F.struct(F.col("box_no").cast("string").alias("name"), box.alias("bndbox"))).alias("object"))
    objects.write.format("xml").option("rowTag", "annotation").save(path)
    return readers.read_voc(spark, path)
