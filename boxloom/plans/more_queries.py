"""Further queries over boxes, thumbnails, runs and records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.functions import boxes as B
from boxloom.functions import classes as K
from boxloom.functions import geometry as G
from boxloom.functions import text as X
from boxloom.functions.names import digest_hex, source_name
from boxloom.operators import allocation, ids, near_duplicates, tiling
from boxloom.operators import audit as A
from boxloom.operators import experiments as E
from boxloom.operators import matching as M
from boxloom.operators import metrics
from boxloom.operators.ranking import lookup, ordered_rank
from boxloom.plans import shared_sql as S
from boxloom.plans.dataset_queries import _I as INVENTORY
from boxloom.plans.dataset_queries import _name_sql, inv
from boxloom.plans.detection_queries import _BEST as BEST
from boxloom.plans.detection_queries import predictions, r6, truth
from boxloom.plans.experiment_queries import _B as BEST_EPOCH
from boxloom.plans.experiment_queries import _E as EPOCHS
from boxloom.plans.experiment_queries import best, log
from boxloom.plans.registry import Registry
from boxloom.runtime import read_table, settle

query = Registry()
QUERIES, SQL = query.queries, query.sql

_TILES = f"""{S.GT}, im AS (SELECT DISTINCT image_id, width, height FROM gt),
s1 AS (SELECT *, unnest(range(0, CASE WHEN width <= 1024 THEN 1 ELSE CAST(ceil((width - 1024) / 824.0 + 1) AS BIGINT) END)) AS i FROM im),
s2 AS (SELECT image_id, width, height, CASE WHEN width > 1024 AND i * 824 + 1024 > width THEN width - 1024 ELSE i * 824 END AS tx1, unnest(range(0, CASE WHEN height <= 1024 THEN 1 ELSE CAST(ceil((height - 1024) / 824.0 + 1) AS BIGINT) END)) AS j FROM s1),
s3 AS (SELECT image_id, width, height, tx1, CASE WHEN height > 1024 AND j * 824 + 1024 > height THEN height - 1024 ELSE j * 824 END AS ty1 FROM s2),
s4 AS (SELECT *, (least(tx1 + 1024, width) - tx1) * (least(ty1 + 1024, height) - ty1) / (1024 * 1024) AS rate FROM s3),
s5 AS (SELECT *, max(rate) OVER (PARTITION BY image_id) AS best FROM s4),
tl AS (SELECT image_id, CAST(tx1 AS INT) AS tx1, CAST(ty1 AS INT) AS ty1, CAST(tx1 + 1024 AS INT) AS tx2, CAST(ty1 + 1024 AS INT) AS ty2 FROM s5 WHERE rate > 0.6 OR (best <= 0.6 AND best - rate < 0.01))"""


def _tiles(spark, d):
    return tiling.tiles(truth(spark, d).select("image_id", "width", "height").distinct())


@query(f"WITH {_TILES} SELECT * FROM tl")
def tile_windows(spark, d):
    """Tiles of every labelled image that lie mostly inside it."""
    return _tiles(spark, d)


@query(f"WITH {_TILES} SELECT g.image_id, box_no, tx1, ty1, round(x1 - tx1 + 1e-8, 5) AS x1, round(y1 - ty1 + 1e-8, 5) AS y1, round(x2 - tx1 + 1e-8, 5) AS x2, round(y2 - ty1 + 1e-8, 5) AS y2 FROM gt g JOIN tl t ON g.image_id = t.image_id WHERE greatest(least(tx2, x2) - greatest(tx1, x1), 0.0) * greatest(least(ty2, y2) - greatest(ty1, y1), 0.0) / greatest((x2 - x1) * (y2 - y1), 1e-7) >= 0.7")
def tile_objects(spark, d):
    """Boxes in every tile that holds most of them."""
    held = tiling.tile_objects(truth(spark, d), _tiles(spark, d))
    return held.select("image_id", "box_no", "tx1", "ty1", *[F.round(F.col(c) + 1e-8, 5).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"WITH {S.GT} SELECT image_id, box_no, round(CASE WHEN x1 < 20 THEN 0.0 ELSE x1 END + 1e-8, 5) AS x1, round(CASE WHEN y1 < 20 THEN 0.0 ELSE y1 END + 1e-8, 5) AS y1, round(CASE WHEN x2 > width - 20 THEN width ELSE x2 END + 1e-8, 5) AS x2, round(CASE WHEN y2 > height - 20 THEN height ELSE y2 END + 1e-8, 5) AS y2 FROM gt")
def snapped_boxes(spark, d):
    """Boxes with corners near the border moved onto it."""
    return tiling.snapped(truth(spark, d)).select("image_id", "box_no", *[F.round(F.col(c) + 1e-8, 5).alias(c) for c in ("x1", "y1", "x2", "y2")])


_THUMB = "th AS (SELECT DISTINCT r.record_id AS record_id, lower(r.thumb_sig) AS t FROM (SELECT unnest(records) AS r FROM audit) WHERE regexp_full_match(r.thumb_sig, '[0-9a-fA-F]{64}')), cell AS (SELECT record_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(('0x' || t[i + 1]) AS INT) AS v FROM th, range(0, 64) g(i))"


def thumbs(spark, d):
    rows = read_table(spark, d, "audit").select(F.explode("records").alias("r")).filter(F.col("r.thumb_sig").rlike(r"^[0-9a-fA-F]{64}\z"))
    return rows.select("r.record_id", F.lower("r.thumb_sig").alias("thumb")).distinct()


@query(f"WITH {_THUMB} SELECT record_id, coalesce(min(x) FILTER (v >= 14), 0) AS x1, coalesce(min(y) FILTER (v >= 14), 0) AS y1, coalesce(max(x) FILTER (v >= 14), 0) AS x2, coalesce(max(y) FILTER (v >= 14), 0) AS y2, count_if(v >= 14) AS cells FROM cell GROUP BY record_id")
def mask_boxes(spark, d):
    """The box around the bright cells of each thumbnail, zeros if there are none."""
    cells = thumbs(spark, d).select("record_id", F.posexplode(F.split("thumb", "")).alias("i", "c")).filter("c <> ''").withColumn("v", F.conv("c", 16, 10).cast("int"))
    on = F.col("v") >= 14
    x, y = F.when(on, F.col("i") % 8), F.when(on, F.floor(F.col("i") / 8).cast("int"))
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return cells.groupBy("record_id").agg(zero(F.min(x), "x1"), zero(F.min(y), "y1"), zero(F.max(x), "x2"), zero(F.max(y), "y2"), F.count_if(on).alias("cells"))


@query(f"WITH {INVENTORY}, {_THUMB}, m AS (SELECT record_id, list(x + 8 * y) FILTER (v >= 8) AS on_ FROM cell GROUP BY record_id), s AS (SELECT m.record_id, on_, source FROM m JOIN iv USING (record_id) WHERE len(on_) > 0 AND source IS NOT NULL), f AS (SELECT source, min(record_id) AS a FROM s GROUP BY source) SELECT f.a, b.record_id AS b, round(len(list_intersect(x.on_, b.on_)) / (len(x.on_) + len(b.on_) - len(list_intersect(x.on_, b.on_)) + 1e-7), 6) AS iou FROM f JOIN s x ON x.record_id = f.a JOIN s b ON b.source = f.source AND b.record_id > f.a")
def mask_overlaps(spark, d):
    """Overlap of the bright half of each thumbnail with that of the first record of its source, by counting common bits."""
    bits = F.aggregate(F.split("thumb", ""), F.lit(0).cast("bigint"), lambda a, c: F.when(c == "", a).otherwise(F.shiftleft(a, 1).bitwiseOR(F.when(c >= "8", F.lit(1)).otherwise(F.lit(0)).cast("bigint"))))
    masks = thumbs(spark, d).select("record_id", bits.alias("m")).filter("m <> 0")
    named = masks.join(inv(spark, d).select("record_id", "source").filter("source is not null"), "record_id")
    first = named.groupBy("source").agg(F.min(F.struct("record_id", "m")).alias("f")).select("source", F.col("f.record_id").alias("a"), F.col("f.m").alias("ma"))
    both = F.bit_count(F.col("ma").bitwiseAND(F.col("m")))
    either = F.bit_count(F.col("ma")) + F.bit_count(F.col("m")) - both
    return lookup(named, first, "source", "inner").filter("record_id > a").select("a", F.col("record_id").alias("b"), r6(both / (either + 1e-7), "iou"))


_NEAR = f"""WITH RECURSIVE im AS (SELECT DISTINCT r.record_id AS k, CASE WHEN regexp_full_match(r.thumb_sig, '[0-9a-fA-F]{{64}}') THEN lower(r.thumb_sig) END AS t, {S.digest('image_sha256')} AS d, {_name_sql('r.source_id', 'r.old_split')[1]} AS s FROM (SELECT image_sha256, unnest(records) AS r FROM audit) WHERE r.record_id IS NOT NULL),
im2 AS (SELECT *, coalesce(regexp_full_match(s, 'video\\d+_\\d+'), false) AS numbered FROM im),
th AS (SELECT t, list_transform(range(1, 65), lambda i: CAST(('0x' || t[i]) AS INT)) AS c, min(k) AS first, bool_or(NOT numbered OR s IS NULL) AS free, list(DISTINCT s) FILTER (s IS NOT NULL) AS sources FROM im2 WHERE t IS NOT NULL GROUP BY t),
ts AS (SELECT *, list_sum(c) AS total FROM th),
pr AS (SELECT a.first AS x, b.first AS y, a.free OR b.free AS free, len(list_intersect(coalesce(a.sources, []), coalesce(b.sources, []))) > 0 AS shared, list_reverse_sort(list_transform(range(1, 65), lambda i: abs(a.c[i] - b.c[i]))) AS g FROM ts a JOIN ts b ON a.t < b.t AND abs(a.total - b.total) <= 32),
vf AS (SELECT *, list_sum(g) / 64.0 AS mean, g[2] + 0.37 * (g[1] - g[2]) AS p99 FROM pr WHERE list_sum(g) <= 32),
e AS (SELECT x, y FROM vf WHERE mean <= 0.5 AND p99 <= 4.0 AND (shared OR free AND mean <= 0.1 AND p99 <= 2.0)
 UNION SELECT first, k FROM th JOIN im2 USING (t) UNION SELECT f.k, i.k FROM im2 i JOIN (SELECT d, min(k) AS k FROM im2 WHERE d IS NOT NULL GROUP BY d) f ON f.d = i.d),
u AS (SELECT x, y FROM e WHERE x <> y UNION SELECT y, x FROM e WHERE x <> y),
reach(x, y) AS (SELECT DISTINCT x, x FROM u UNION SELECT r.x, u.y FROM reach r JOIN u ON r.y = u.x)
SELECT x AS record_id, min(y) AS component FROM reach GROUP BY x"""


@query(_NEAR)
def near_identical_groups(spark, d):
    """Records whose files, thumbnails or nearly equal thumbnails tie them, in components; limits are tighter across sources."""
    r = read_table(spark, d, "audit").select(digest_hex(F.col("image_sha256")).alias("digest"), F.explode("records").alias("r")).filter("r.record_id is not null")
    source = source_name(F.col("r.source_id"))
    images = r.select(F.col("r.record_id").alias("key"), F.when(F.col("r.thumb_sig").rlike(r"^[0-9a-fA-F]{64}\z"), F.lower("r.thumb_sig")).alias("thumb"), "digest", source.alias("source"), F.coalesce(source.rlike(r"^video\d+_\d+\z"), F.lit(False)).alias("numbered")).distinct()
    return near_duplicates.groups(settle(images)).select(F.col("node").alias("record_id"), "component")


@query(f"WITH {S.GT}, o AS (SELECT image_id, box_no, cls, row_number() OVER (ORDER BY image_id, box_no) AS annotation_id FROM gt) SELECT * FROM o")
def ground_truth_ids(spark, d):
    """Truth boxes with running annotation numbers."""
    return ids.running_ids(truth(spark, d).select("image_id", "box_no", "cls"), ["image_id", "box_no"], "annotation_id")


@query(f"WITH {INVENTORY}, r AS (SELECT record_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY sha256(CAST(record_id AS VARCHAR)), record_id) AS k, count(*) OVER (PARTITION BY dataset) AS n FROM iv) SELECT record_id, dataset, CASE WHEN k <= floor(n * 0.8) THEN 'first' ELSE 'second' END AS split FROM r")
def class_split(spark, d):
    """The same share of every class on each side."""
    return allocation.class_split(inv(spark, d).select("record_id", "dataset"), "record_id", "dataset", 0.8)


def _dealt(spark, d):
    """(records with their component, the split of each component)."""
    rows = settle(inv(spark, d).select("record_id", "source", "video", "instances"))
    tied = A.components(A.component_edges(rows, "record_id", ["source", "video"])).select(F.col("node").alias("record_id"), "component")
    named = settle(rows.join(tied, "record_id", "left").withColumn("component", F.coalesce("component", "record_id")))
    sizes = settle(named.groupBy("component").agg(F.count(F.lit(1)).alias("images"), F.sum("instances").alias("boxes"), F.count_if(F.col("instances") == 0).alias("empty"), F.count_if(F.col("video").isNotNull()).alias("frames")))
    return named, allocation.allocate(sizes, "component", ["images", "boxes", "empty", "frames"], {"train": 0.7, "valid": 0.15, "test": 0.15}, 16, 7, [5.0, 2.0, 0.5, 1.0], "frames").select("component", "split")


@query()
def split_trials(spark, d):
    """Components of records with a common source or video, loose records included, dealt to splits by the best of 16 seeded trials over images and boxes."""
    return _dealt(spark, d)[1]


@query(f"WITH {INVENTORY} SELECT count(*) AS records, 0 AS torn_sources, 0 AS torn_videos, 0 AS far_splits, 3 AS covered FROM iv")
def split_checks(spark, d):
    """What must hold for these: all records dealt, no source or video in two splits, shares within two percent, frames of videos in each split."""
    named, made = _dealt(spark, d)
    whole = settle(lookup(named, made, "component", "inner"))
    torn = lambda c: whole.filter(F.col(c).isNotNull()).groupBy(c).agg((F.min("split") != F.max("split")).alias("t")).agg(F.count_if("t").alias(f"torn_{c}s"))
    goal = F.when(F.col("split") == "train", 0.7).otherwise(0.15)
    total = whole.agg(F.count(F.lit(1)).alias("records"))
    per = whole.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("video").isNotNull()).alias("frames")).join(F.broadcast(total))
    shares = per.agg(F.count_if(F.abs(F.col("n") / F.col("records") - goal) > 0.02).alias("far_splits"), F.count_if(F.col("frames") > 0).alias("covered"))
    return total.join(F.broadcast(torn("source"))).join(F.broadcast(torn("video"))).join(F.broadcast(shares))


@query(f"WITH {INVENTORY}, f AS (SELECT image_sha256, min(record_id) AS first FROM iv WHERE image_sha256 IS NOT NULL GROUP BY 1) SELECT i.record_id, CASE WHEN f.first <> i.record_id THEN f.first END AS reused_from FROM iv i LEFT JOIN f ON f.image_sha256 = i.image_sha256")
def reused_results(spark, d):
    """Which record's evaluation a record takes over, as it has the same digest."""
    rows = inv(spark, d).select("record_id", "image_sha256")
    first = rows.filter("image_sha256 is not null").groupBy("image_sha256").agg(F.min("record_id").alias("first"))
    return rows.join(first, "image_sha256", "left").select("record_id", F.when(F.col("first") != F.col("record_id"), F.col("first")).alias("reused_from"))


@query(f"WITH {INVENTORY}, a AS (SELECT split, record_id, width * height AS area, row_number() OVER (PARTITION BY split ORDER BY width * height, record_id) AS k, count(*) OVER (PARTITION BY split) AS n FROM iv WHERE width BETWEEN 1 AND 12000 AND height BETWEEN 1 AND 12000) SELECT split, record_id, area, CASE WHEN k = 1 THEN 'least' WHEN k = n THEN 'most' ELSE 'middle' END AS place FROM a WHERE k IN (1, n // 2 + 1, n)")
def area_extremes(spark, d):
    """The smallest, the middle and the largest image of each split."""
    rows = inv(spark, d).filter("width between 1 and 12000 and height between 1 and 12000").select("split", "record_id", (F.col("width") * F.col("height")).alias("area"))
    ranked = ordered_rank(rows, ["split"], [F.col("area"), F.col("record_id")], "k", "n").withColumn("k", F.col("k") + 1)
    place = F.when(F.col("k") == 1, "least").when(F.col("k") == F.col("n"), "most").otherwise("middle")
    return ranked.filter((F.col("k") == 1) | (F.col("k") == F.col("n")) | (F.col("k") == F.floor(F.col("n") / 2) + 1)).select("split", "record_id", "area", place.alias("place"))


@query(f"WITH {INVENTORY} SELECT record_id, greatest(3, CAST(round_even(15 * greatest(width, height) / 640.0, 0) AS INT)) + CASE WHEN greatest(3, CAST(round_even(15 * greatest(width, height) / 640.0, 0) AS INT)) % 2 = 0 THEN 1 ELSE 0 END AS kernel FROM iv WHERE width BETWEEN 1 AND 12000 AND height BETWEEN 1 AND 12000")
def blur_kernels(spark, d):
    """An odd blur kernel per image, scaled from side 640."""
    return inv(spark, d).filter("width between 1 and 12000 and height between 1 and 12000").select("record_id", B.odd_kernel(F.lit(15), F.col("width"), F.col("height")).alias("kernel"))


@query("WITH c AS (SELECT DISTINCT CAST(event_id % 95 AS INT) AS n FROM events), u AS (SELECT unnest([12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91]) AS n) SELECT n, CASE WHEN n BETWEEN 1 AND 91 AND n NOT IN (SELECT n FROM u) THEN CAST(n - 1 - (SELECT count(*) FROM u WHERE u.n < c.n) AS INT) END AS short, (SELECT list_sort(list(x))[c.n + 1] FROM range(1, 92) r(x) WHERE x NOT IN (SELECT n FROM u)) AS long FROM c")
def class_numbers(spark, d):
    """Numbers of the long catalogue as short ones and back."""
    n = read_table(spark, d, "events").select((F.col("event_id") % 95).cast("int").alias("n")).distinct()
    return n.select("n", K.long_to_short(F.col("n")).alias("short"), K.short_to_long(F.col("n")).alias("long"))


@query(f"WITH {BEST}, v AS (SELECT image_id, run_id, count_if(best_iou >= 0.5) AS hits, count(*) AS n, avg(best_iou) AS mean_iou FROM b GROUP BY ALL) SELECT image_id, count(*) AS runs, count_if(hits = n) AS full_votes, count_if(hits = 0) AS empty_votes, round(avg(mean_iou), 5) AS mean_iou FROM v GROUP BY image_id")
def image_votes(spark, d):
    """How many runs find everything or nothing in each image."""
    b = M.best_prediction(predictions(spark, d), truth(spark, d))
    v = b.groupBy("image_id", "run_id").agg(F.count_if(F.col("best_iou") >= 0.5).alias("hits"), F.count(F.lit(1)).alias("n"), F.avg("best_iou").alias("mean_iou"))
    return v.groupBy("image_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("hits") == F.col("n")).alias("full_votes"), F.count_if(F.col("hits") == 0).alias("empty_votes"), F.round(F.avg("mean_iou"), 5).alias("mean_iou"))


@query(f"WITH {BEST}, s AS (SELECT b.*, CASE WHEN side < 16 THEN 'tiny' WHEN side < 32 THEN 'small' WHEN side < 96 THEN 'medium' ELSE 'large' END AS size_group FROM b JOIN (SELECT image_id, gt, sqrt((x2 - x1) * (y2 - y1)) AS side FROM gt) g USING (image_id, gt)) SELECT size_group, count(*) AS targets, count_if(best_iou >= 0.5) AS matched, round(median(best_score), 6) AS median_score FROM s GROUP BY size_group")
def score_by_size(spark, d):
    """Targets, matches and the median score per size group."""
    t = truth(spark, d)
    x, y, w, h = B.corners_to_center(B.columns())
    sized = t.select("image_id", "gt", B.size_name(F.sqrt(w * h)).alias("size_group"))
    b = M.best_prediction(predictions(spark, d), t).join(sized, ["image_id", "gt"])
    return b.groupBy("size_group").agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("best_iou") >= 0.5).alias("matched"), r6(F.percentile("best_score", 0.5), "median_score"))


@query(f"WITH {S.GT}, {S.DET}, {S.PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id, image_id, gt ORDER BY iou * score DESC, det) AS r FROM pairs WHERE iou > 0), m AS (SELECT *, row_number() OVER (PARTITION BY run_id, image_id, det ORDER BY iou DESC, gt) AS o FROM k WHERE r <= 3) SELECT run_id, image_id, det, gt, round(iou, 6) AS iou FROM m WHERE o = 1")
def assigned_candidates(spark, d):
    """The three best candidates of each truth box, each candidate with the box that it overlaps most."""
    pairs = M.overlap_pairs(predictions(spark, d), truth(spark, d), by_class=False).filter("iou > 0")
    best3 = Window.partitionBy("run_id", "image_id", "gt").orderBy(F.desc(F.col("iou") * F.col("score")), "det")
    own = Window.partitionBy("run_id", "image_id", "det").orderBy(F.desc("iou"), "gt")
    kept = pairs.withColumn("r", F.row_number().over(best3)).filter("r <= 3").withColumn("o", F.row_number().over(own)).filter("o = 1")
    return kept.select("run_id", "image_id", "det", "gt", r6("iou", "iou"))


@query(f"WITH {BEST_EPOCH}, a AS (SELECT run_id, 'precision' AS kind, precision AS v FROM best ORDER BY precision DESC NULLS LAST, run_id LIMIT 3), b AS (SELECT run_id, 'recall' AS kind, recall AS v FROM best WHERE run_id NOT IN (SELECT run_id FROM a) ORDER BY recall DESC NULLS LAST, run_id LIMIT 3), c AS (SELECT run_id, 'map50' AS kind, map50 AS v FROM best WHERE run_id NOT IN (SELECT run_id FROM a) AND run_id NOT IN (SELECT run_id FROM b) ORDER BY map50 DESC NULLS LAST, run_id LIMIT 3) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c")
def distinct_examples(spark, d):
    """Three runs per category, none in two categories."""
    rows, out = best(spark, d), None
    for kind in ("precision", "recall", "map50"):
        left = rows if out is None else rows.join(out.select("run_id"), "run_id", "left_anti")
        pick = left.orderBy(F.desc_nulls_last(kind), "run_id").limit(3).select("run_id", F.lit(kind).alias("kind"), F.col(kind).alias("v"))
        out = pick if out is None else out.unionByName(pick)
    return out


@query(f"WITH {BEST_EPOCH}, p AS (SELECT min(run_id) AS parent FROM best), q AS (SELECT b.run_id, b.map50_95 FROM best b, p WHERE b.map50_95 >= (SELECT map50_95 + 0.001 FROM best WHERE run_id = p.parent) AND b.recall >= (SELECT avg(recall) FROM best) ORDER BY b.map50_95 DESC, b.run_id LIMIT 1) SELECT parent, run_id AS chosen, map50_95 FROM p LEFT JOIN q ON true")
def qualified_choice(spark, d):
    """The best run that beats the first one and the mean recall, null if there is none."""
    rows = best(spark, d)
    first = rows.agg(F.min(F.struct("run_id", "map50_95")).alias("m"), F.avg("recall").alias("r")).select(F.col("m.run_id").alias("parent"), (F.col("m.map50_95") + 0.001).alias("need"), "r")
    able = rows.join(F.broadcast(first), (F.col("map50_95") >= F.col("need")) & (F.col("recall") >= F.col("r")))
    top = able.orderBy(F.desc("map50_95"), "run_id").limit(1).select("run_id", "map50_95")
    return first.join(top, F.lit(True), "left").select("parent", F.col("run_id").alias("chosen"), "map50_95")


@query(f"WITH {EPOCHS} SELECT run_id, count(*) AS epochs, min(epoch) = 1 AND max(epoch) = count(*) AS whole, count(*) = 60 AS full_length, count_if(metric_map50_95 IS NULL OR train_box_loss IS NULL) AS gaps FROM ep GROUP BY run_id")
def run_validity(spark, d):
    """Whether a run has all its epochs, the expected number of them, and values throughout."""
    return log(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("epochs"), ((F.min("epoch") == 1) & (F.max("epoch") == F.count(F.lit(1)))).alias("whole"), (F.count(F.lit(1)) == 60).alias("full_length"), F.count_if(F.col("metric_map50_95").isNull() | F.col("train_box_loss").isNull()).alias("gaps"))


@query(f"WITH {EPOCHS}, s AS (SELECT run_id, elapsed_s - lag(elapsed_s) OVER (PARTITION BY run_id ORDER BY epoch) AS v FROM ep) SELECT run_id, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0.0), 6) AS sd, round(min(v), 6) AS least, round(max(v), 6) AS most FROM s GROUP BY run_id")
def step_statistics(spark, d):
    """Time per epoch: mean, deviation (0 for a single one), least and most."""
    w = Window.partitionBy("run_id").orderBy("epoch")
    s = log(spark, d).select("run_id", (F.col("elapsed_s") - F.lag("elapsed_s").over(w)).alias("v"))
    return s.groupBy("run_id").agg(r6(F.avg("v"), "mean"), r6(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), "sd"), r6(F.min("v"), "least"), r6(F.max("v"), "most"))


@query(f"WITH {EPOCHS}, z AS (SELECT * FROM ep WHERE metric_map50_95 > 0), a AS (SELECT * FROM z WHERE metric_map50_95 >= (SELECT avg(metric_map50_95) - 3 * stddev_pop(metric_map50_95) FROM z)), b AS (SELECT * FROM a WHERE metric_map50_95 >= (SELECT avg(metric_map50_95) - 3 * stddev_pop(metric_map50_95) FROM a)), c AS (SELECT * FROM b WHERE metric_map50_95 >= (SELECT avg(metric_map50_95) - 3 * stddev_pop(metric_map50_95) FROM b)) SELECT run_id, epoch, metric_map50_95 FROM c")
def plausible_epochs(spark, d):
    """Epochs left after three rounds of rejecting fitness below three deviations under the mean."""
    return E.reject_low(log(spark, d).filter("metric_map50_95 > 0"), "metric_map50_95").select("run_id", "epoch", "metric_map50_95")


@query(f"""WITH {EPOCHS}, k AS (SELECT CAST(o AS BIGINT) AS o, exp(-0.5 * (o / 3.0) ^ 2) AS g FROM range(-9, 10) r(o)), n AS (SELECT run_id, epoch, metric_map50 AS v, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS i, count(*) OVER (PARTITION BY run_id) AS n FROM ep WHERE metric_map50 IS NOT NULL)
SELECT a.run_id, a.epoch, round(sum(g * b.v) / sum(g), 6) AS smooth FROM n a, k JOIN n b ON b.run_id = a.run_id AND b.i = CASE WHEN a.i + o < 1 THEN 2 - (a.i + o) - 1 WHEN a.i + o > a.n THEN 2 * a.n + 1 - (a.i + o) ELSE a.i + o END GROUP BY ALL""")
def gaussian_curve(spark, d):
    """Each run's curve smoothed by a Gaussian of three epochs, mirrored at its ends."""
    return metrics.gaussian(log(spark, d).filter("metric_map50 is not null"), ["run_id"], "epoch", "metric_map50", 3.0).select("run_id", "epoch", F.round("smooth", 6).alias("smooth"))


@query(f"WITH {INVENTORY} SELECT record_id, list_transform(list_slice(regexp_extract_all(image, '\\d+'), 1, 3), lambda v: TRY_CAST(v AS INT)) AS parts FROM iv")
def number_parts(spark, d):
    """The first three numbers of a text, as a version has them."""
    return inv(spark, d).select("record_id", F.transform(F.slice(F.regexp_extract_all("image", F.lit(r"(\d+)"), 1), 1, 3), lambda v: v.try_cast("int")).alias("parts"))


@query("SELECT file_id, strftime(modified_at, '%Y.%-m.%-d') AS day, date_diff('day', CAST(modified_at AS DATE), DATE '2026-01-01') AS age FROM label_files")
def file_ages(spark, d):
    """Day of change and age at a stated day of every label file."""
    return read_table(spark, d, "label_files").select("file_id", F.date_format("modified_at", "y.M.d").alias("day"), F.datediff(F.lit("2026-01-01").cast("date"), F.col("modified_at").cast("date")).alias("age"))
