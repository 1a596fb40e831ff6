"""Queries over image records, label files and documents: scans, audits, duplicates, leakage, splits, search, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions import geometry as G
from boxloom.functions import text as X
from boxloom.functions.names import label_path_of, source_name, usable_split
from boxloom.operators import audit as A
from boxloom.operators import search as V
from boxloom.operators.ranking import ordered_rank
from boxloom.plans import shared_sql as S
from boxloom.plans.registry import Registry
from boxloom.runtime import read_table, scratch_path

query = Registry()
QUERIES, SQL = query.queries, query.sql

_BL = f"""bl AS (SELECT file_id, generate_subscripts({S.lines("coalesce(body, '')")}, 1) AS line_no, unnest({S.lines("coalesce(body, '')")}) AS line FROM label_files),
bp AS (SELECT file_id, line_no, string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ') AS p FROM bl),
bx AS (SELECT file_id, line_no, len(p) AS fields, TRY_CAST(p[1] AS DOUBLE) AS cls, TRY_CAST(p[2] AS DOUBLE) AS x, TRY_CAST(p[3] AS DOUBLE) AS y, TRY_CAST(p[4] AS DOUBLE) AS w, TRY_CAST(p[5] AS DOUBLE) AS h FROM bp),
bv AS (SELECT *, coalesce(fields = 5 AND cls = floor(cls) AND cls BETWEEN 0 AND 0 AND w > 0 AND h > 0 AND x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND x - w / 2 >= 0 AND y - h / 2 >= 0 AND x + w / 2 <= 1 AND y + h / 2 <= 1, false) AS strict,
 coalesce(fields = 5 AND cls = floor(cls) AND cls BETWEEN 0 AND 0 AND w > 0 AND h > 0 AND x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND x - w / 2 >= -1e-6 AND y - h / 2 >= -1e-6 AND x + w / 2 <= 1 + 1e-6 AND y + h / 2 <= 1 + 1e-6, false) AS tight,
 coalesce(fields = 5 AND greatest(x, y, w, h) <= 1.01 AND least(cls, x, y, w, h) >= -0.01 AND cls < 1 AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL AND cls IS NOT NULL, false) AS loose FROM bx)"""

_INV = f"""one AS (SELECT record_id, max(struct_pack(image := image, s := old_split, d := image_sha256, l := label_signature, src := source_id, ds := dataset, n := instances, w := width, h := height)) AS r FROM image_records WHERE record_id IS NOT NULL GROUP BY record_id),
inv AS (SELECT record_id, r.image AS image, {{split}} AS split, {{source}} AS source, r.ds AS dataset, r.d AS image_sha256, r.l AS label_signature, r.n AS instances, r.w AS width, r.h AS height FROM one),
iv AS (SELECT *, nullif(regexp_extract(source, '^(video\\d+)_\\d+$', 1), '') AS video, CAST(nullif(regexp_extract(source, '^(video\\d+)_(\\d+)$', 2), '') AS BIGINT) AS frame, sha256(coalesce(label_signature, '')) AS label_sha256 FROM inv)"""


def _name_sql(c: str, split: str) -> tuple[str, str]:
    """(usable split of column ``split``, plain source name of column ``c``) in SQL form."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    thin = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
    nothing = "('', '_', '__', 'n/a', 'na', '#n/a', 'none', 'null', 'nil', 'nan', 'unknown', 'undefined', '?', '??', 'unassigned', 'tbd', '(none)', 'missing')"
    trim = lambda c: f"regexp_replace({c}, '^[\\s' || chr(160) || ']+|[\\s' || chr(160) || ']+$', '', 'g')"
    word = f"regexp_replace(lower({trim(split)}), '[/\\\\]+$', '')"
    split = f"CASE WHEN {word} IN ('train', 'training') THEN 'train' WHEN {word} IN ('valid', 'val', 'validation') THEN 'valid' WHEN {word} IN ('test', 'testing') THEN 'test' END"
    narrow = f"translate({c}, '{wide}', '{thin}')"
    name = f"regexp_replace(lower({trim(narrow)}), '[-\\s' || chr(160) || ']', '_', 'g')"
    bare = f"regexp_replace({name}, '(\\.rf\\.[0-9a-f]+|[._](jpe?g|png))+$', '')"
    source = f"CASE WHEN {name} NOT IN {nothing} AND {bare} NOT IN {nothing} THEN {bare} END"
    return split, source


_SPLIT, _SOURCE = _name_sql("r.src", "r.s")
_I = _INV.replace("{split}", _SPLIT).replace("{source}", _SOURCE)


def inv(spark, d) -> DataFrame:
    return A.inventory(read_table(spark, d, "image_records"))


@query(f"WITH {_BL} SELECT file_id, line_no, fields, cls, x, y, w, h, strict, tight, loose FROM bv")
def label_lines(spark, d):
    """Every line of every label file with its numbers and the three validity rules."""
    return A.validity(A.box_lines(read_table(spark, d, "label_files"), "file_id", "body"))


@query(f"""WITH {_BL}, per AS (SELECT file_id, count(*) AS n, count_if(NOT loose) AS bad, count(DISTINCT struct_pack(cls, x, y, w, h)) FILTER (cls IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL) AS kinds FROM bv GROUP BY file_id)
SELECT count_if(body IS NOT NULL) AS found, count_if(body IS NULL) AS missing, count_if(body IS NOT NULL AND coalesce(n, 0) = 0) AS empty, count_if(coalesce(bad, 0) > 0) AS corrupt, CAST(sum(coalesce(n, 0)) AS BIGINT) AS boxes, CAST(sum(coalesce(n - bad - least(kinds, n - bad), 0)) AS BIGINT) AS repeated FROM label_files LEFT JOIN per USING (file_id)""")
def scan_counters(spark, d):
    """Found, missing, empty and corrupt label files."""
    return A.scan_counters(read_table(spark, d, "label_files"), "file_id", "body")


@query(f"WITH {_I} SELECT record_id, split, source, dataset, instances, video, frame, label_sha256 FROM iv")
def inventory(spark, d):
    """One row per record with plain names, video, frame and label digest."""
    return inv(spark, d).select("record_id", "split", "source", "dataset", "instances", "video", "frame", "label_sha256")


@query(f"WITH {_I} SELECT record_id, CASE WHEN NOT {S.usable('label_signature')} THEN 'label' WHEN split IS NULL THEN 'split' WHEN NOT coalesce(width BETWEEN 1 AND 12000 AND height BETWEEN 1 AND 12000, false) THEN 'size' END AS error FROM iv")
def scan_rejects(spark, d):
    """Every record with the reason why a scan would reject it."""
    return A.unusable(inv(spark, d)).select("record_id", "error")


@query("""SELECT record_id, CASE WHEN regexp_matches(image, '/images/') THEN regexp_replace(regexp_replace(image, '^(.*/|)images/', '\\1labels/'), '\\.[^./]*$', '') || '.txt' END AS derived FROM (SELECT DISTINCT record_id, image FROM image_records WHERE record_id IS NOT NULL)""")
def derived_label_paths(spark, d):
    """The label path that follows from each image path."""
    rows = read_table(spark, d, "image_records").filter("record_id is not null").select("record_id", "image").distinct()
    return rows.select("record_id", F.when(F.instr("image", "/images/") > 0, label_path_of(F.col("image"))).alias("derived"))


@query(r"SELECT image, regexp_extract(image, '\.([^./]*)$', 1) AS suffix FROM (SELECT DISTINCT image FROM image_records WHERE regexp_matches(lower(image), '\.(jpe?g|png)$')) ORDER BY image LIMIT (SELECT CAST(round_even(count(DISTINCT image) * 0.3, 0) AS BIGINT) FROM image_records WHERE regexp_matches(lower(image), '\.(jpe?g|png)$'))")
def image_listing(spark, d):
    """The first 30 % of the sorted image list: a prefix, not a sample."""
    from boxloom.sources.readers import list_prefix

    images = read_table(spark, d, "image_records").select("image").filter(F.lower("image").rlike(r"\.(jpe?g|png)\z")).distinct()
    return list_prefix(images, "image", 0.3).select("image", F.regexp_extract("image", r"\.([^./]*)\z", 1).alias("suffix"))


@query("SELECT list_extract(string_split(image, '/'), -3) AS folder, count(*) AS images, count(DISTINCT image) AS distinct_images FROM image_records GROUP BY 1")
def class_folders(spark, d):
    """Images per folder of the path, as a folder-per-class source has them."""
    return read_table(spark, d, "image_records").groupBy(F.try_element_at(F.split("image", "/"), F.lit(-3)).alias("folder")).agg(F.count(F.lit(1)).alias("images"), F.count_distinct("image").alias("distinct_images"))


@query("""WITH a AS (SELECT DISTINCT label FROM image_records), b AS (SELECT DISTINCT label FROM label_files WHERE label IS NOT NULL)
SELECT count_if(b.label IS NOT NULL AND a.label IS NOT NULL) AS paired, count_if(b.label IS NULL) AS without_file, count_if(a.label IS NULL) AS without_record FROM a FULL JOIN b ON a.label = b.label""")
def pairing_audit(spark, d):
    """Label paths of records and of delivered files: paired, missing on either side (a full outer join)."""
    a = read_table(spark, d, "image_records").select("label").distinct().withColumn("a", F.lit(1))
    b = read_table(spark, d, "label_files").filter("label is not null").select("label").distinct().withColumn("b", F.lit(1))
    return a.join(b, "label", "full").agg(F.count_if(F.expr("a = 1 and b = 1")).alias("paired"), F.count_if(F.expr("b is null")).alias("without_file"), F.count_if(F.expr("a is null")).alias("without_record"))


@query(f"WITH {_I} SELECT split, count(*) AS images, CAST(sum(instances) AS BIGINT) AS boxes, count_if(instances = 0) AS empty_images, count_if(instances > 1) AS crowded, max(instances) AS most, round(count_if(instances = 0) / count(*), 6) AS empty_share FROM iv GROUP BY ROLLUP (split)")
def split_statistics(spark, d):
    """Images and boxes per split and in all, in one pass."""
    return inv(spark, d).rollup("split").agg(F.count(F.lit(1)).alias("images"), F.sum("instances").alias("boxes"), F.count_if(F.expr("instances = 0")).alias("empty_images"), F.count_if(F.expr("instances > 1")).alias("crowded"), F.max("instances").alias("most"), F.round(F.try_divide(F.count_if(F.expr("instances = 0")), F.count(F.lit(1))), 6).alias("empty_share"))


@query(f"WITH {_I} SELECT split, dataset, count(*) AS images FROM iv GROUP BY CUBE (split, dataset)")
def split_cube(spark, d):
    """Images per split, dataset, both and neither."""
    return inv(spark, d).cube("split", "dataset").agg(F.count(F.lit(1)).alias("images"))


@query(f"WITH {_I} SELECT split, round(quantile_cont(width, 0.0), 6) AS p0, round(quantile_cont(width, 0.05), 6) AS p05, round(quantile_cont(width, 0.25), 6) AS p25, round(quantile_cont(width, 0.5), 6) AS p50, round(quantile_cont(width, 0.75), 6) AS p75, round(quantile_cont(width, 0.95), 6) AS p95, round(quantile_cont(width, 1.0), 6) AS p100 FROM iv GROUP BY split")
def width_percentiles(spark, d):
    """Seven linear percentiles of the width per split."""
    names = ["p0", "p05", "p25", "p50", "p75", "p95", "p100"]
    p = inv(spark, d).groupBy("split").agg(F.percentile("width", F.array(*[F.lit(x) for x in (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)])).alias("p"))
    return p.select("split", *[F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(names)])


@query(f"WITH {_I}, s AS (SELECT dataset, height, row_number() OVER (PARTITION BY dataset ORDER BY height) AS k, count(*) OVER (PARTITION BY dataset) AS n FROM iv WHERE height IS NOT NULL) SELECT dataset, height AS p95 FROM s WHERE k = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT) + 1")
def nearest_rank_heights(spark, d):
    """The 95th percentile of the height per dataset by nearest rank, rounded half to even."""
    rows = inv(spark, d).filter("height is not null").select("dataset", "height")
    ranked = ordered_rank(rows, ["dataset"], [F.col("height")], "k", "n")
    return ranked.filter(F.col("k") == F.bround((F.col("n") - 1) * 0.95).cast("bigint")).select("dataset", F.col("height").alias("p95"))


@query(f"WITH {_I} SELECT source, count(*) AS rows, count(DISTINCT split) AS splits FROM iv WHERE source IS NOT NULL AND split IS NOT NULL GROUP BY source HAVING count(DISTINCT split) > 1")
def source_leakage(spark, d):
    """Sources that lie in more than one split."""
    return A.spanning_groups(inv(spark, d), "source")


@query(f"WITH {_I} SELECT source, count(*) AS rows, count(DISTINCT split) AS splits FROM iv WHERE source IS NOT NULL AND split IS NOT NULL GROUP BY source HAVING count(DISTINCT split) > 1 ORDER BY source LIMIT 25")
def leakage_examples(spark, d):
    """The first 25 of these sources, the report that the audit prints."""
    return A.spanning_groups(inv(spark, d), "source").orderBy("source").limit(25)


@query(f"""WITH {_I}, k AS (SELECT source, split, min(label_sha256) AS lo, max(label_sha256) AS hi FROM iv WHERE source IS NOT NULL AND split IS NOT NULL GROUP BY ALL),
p AS (SELECT a.split || '-' || b.split AS pair, a.lo = b.lo AND a.hi = b.hi AND a.lo = a.hi AS equal FROM k a JOIN k b ON a.source = b.source AND (a.split, b.split) IN (('train', 'valid'), ('train', 'test'), ('valid', 'test')))
SELECT pair, count(*) AS shared, count_if(equal) AS labels_equal, count_if(NOT equal) AS labels_differ FROM p GROUP BY pair""")
def pairwise_leakage(spark, d):
    """Sources shared by each pair of splits, and whether their labels agree within the pair."""
    return A.pairwise_sharing(inv(spark, d), "source", "label_sha256")


@query(f"WITH {_I} SELECT split, count(*) AS rows, count(image_sha256) - count(DISTINCT image_sha256) AS duplicates FROM iv GROUP BY split")
def within_split_duplicates(spark, d):
    """Rows that repeat a digest inside their split."""
    return inv(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), (F.count("image_sha256") - F.count_distinct("image_sha256")).alias("duplicates"))


@query(f"WITH {_I}, g AS (SELECT image_sha256, count(*) AS n FROM iv WHERE image_sha256 IS NOT NULL GROUP BY 1) SELECT n > 1 AS repeated, count(*) AS digests, CAST(sum(n) AS BIGINT) AS images FROM g GROUP BY 1")
def repeated_cohorts(spark, d):
    """Digests that occur once and several times."""
    return inv(spark, d).filter("image_sha256 is not null").groupBy("image_sha256").agg(F.count(F.lit(1)).alias("n")).groupBy((F.col("n") > 1).alias("repeated")).agg(F.count(F.lit(1)).alias("digests"), F.sum("n").alias("images"))


@query(f"WITH {_I} SELECT image_sha256, count(*) AS rows, count(DISTINCT label_sha256) AS labels FROM iv WHERE image_sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label_sha256) > 1")
def label_conflicts(spark, d):
    """Digests whose copies carry different labels."""
    return A.conflicts(inv(spark, d), "image_sha256", "label_sha256")


@query(f"WITH {_I} SELECT record_id FROM iv WHERE image_sha256 IS NULL OR image_sha256 NOT IN (SELECT image_sha256 FROM iv WHERE image_sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label_sha256) > 1)")
def conflict_free(spark, d):
    """Records left once all copies of conflicting digests are gone."""
    return A.without_conflicts(inv(spark, d), "image_sha256", "label_sha256").select("record_id")


@query(f"WITH {_I}, r AS (SELECT *, row_number() OVER (PARTITION BY image_sha256 ORDER BY split NULLS FIRST, image, record_id) AS k FROM iv WHERE image_sha256 IS NOT NULL) SELECT image_sha256, split, image, record_id FROM r WHERE k = 1")
def representatives(spark, d):
    """One record per digest: least split name, then path."""
    return A.deduplicated(inv(spark, d).select("image_sha256", "split", "image", "record_id"), "image_sha256", ["split", "image", "record_id"])


_CC = f"""WITH RECURSIVE {_I}, v AS (SELECT record_id, source, video FROM iv),
e AS (SELECT DISTINCT v.record_id AS a, f.b FROM v JOIN (SELECT source AS k, min(record_id) AS b FROM v WHERE source IS NOT NULL GROUP BY 1) f ON f.k = v.source WHERE v.record_id <> f.b UNION SELECT DISTINCT v.record_id, f.b FROM v JOIN (SELECT video AS k, min(record_id) AS b FROM v WHERE video IS NOT NULL GROUP BY 1) f ON f.k = v.video WHERE v.record_id <> f.b),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT record_id, record_id FROM v WHERE record_id IN (SELECT a FROM u) UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a)"""


@query(f"{_CC} SELECT a AS record_id, min(b) AS component FROM reach GROUP BY a")
def record_components(spark, d):
    """Components of records that share a source or a video, named by their least record."""
    rows = inv(spark, d).select("record_id", "source", "video")
    edges = A.component_edges(rows, "record_id", ["source", "video"])
    return A.components(edges).select(F.col("node").alias("record_id"), "component")


@query(f"WITH {_I}, h AS (SELECT record_id, CAST(('0x' || substr(sha256(CAST(record_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS p FROM iv) SELECT record_id, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'valid' ELSE 'test' END AS split FROM h")
def hash_split(spark, d):
    """A split by hash."""
    return A.hash_split(inv(spark, d).select("record_id"), "record_id", {"train": 0.7, "valid": 0.15, "test": 0.15})


@query(f"WITH {_I}, f AS (SELECT record_id, video, frame, split FROM iv WHERE video IS NOT NULL AND frame IS NOT NULL AND split IS NOT NULL) SELECT a.record_id, a.video, a.frame, a.split, min(abs(a.frame - b.frame)) AS gap FROM f a LEFT JOIN f b ON a.video = b.video AND a.split <> b.split GROUP BY ALL")
def frame_gaps(spark, d):
    """Distance to the nearest frame of the same video in another split."""
    return A.frame_gaps(inv(spark, d))


@query(f"WITH {_I}, f AS (SELECT record_id, video, frame, split FROM iv WHERE video IS NOT NULL AND frame IS NOT NULL AND split IS NOT NULL), g AS (SELECT a.record_id, a.split, min(abs(a.frame - b.frame)) AS gap FROM f a LEFT JOIN f b ON a.video = b.video AND a.split <> b.split GROUP BY ALL) SELECT split, count(*) AS frames, count_if(gap <= 1) AS within1, count_if(gap <= 5) AS within5, count_if(gap <= 10) AS within10, median(gap) AS median_gap, min(gap) AS least_gap FROM g GROUP BY split")
def frame_gap_summary(spark, d):
    """How near frames of other splits lie, per split."""
    near = lambda k: F.count_if(F.col("gap") <= k).alias(f"within{k}")
    return A.frame_gaps(inv(spark, d)).groupBy("split").agg(F.count(F.lit(1)).alias("frames"), near(1), near(5), near(10), F.percentile("gap", 0.5).alias("median_gap"), F.min("gap").alias("least_gap"))


@query(f"WITH {_I} SELECT DISTINCT a.record_id AS left_id, b.record_id AS right_id FROM iv a JOIN iv b ON a.video = b.video AND abs(a.frame - b.frame) = 1 AND a.split = 'train' AND b.split = 'test' WHERE a.label_sha256 <> b.label_sha256")
def adjacent_frames(spark, d):
    """Neighbouring frames of one video on both sides of the train/test border with different labels (a band join)."""
    f = inv(spark, d).filter("video is not null").select("record_id", "video", "frame", "split", "label_sha256")
    # both neighbours of a frame are exact keys, so the band is an equi-join
    a = f.filter("split = 'train'").select(F.col("record_id").alias("left_id"), "video", F.explode(F.array(F.col("frame") - 1, F.col("frame") + 1)).alias("frame"), F.col("label_sha256").alias("l"))
    b = f.filter("split = 'test'").select(F.col("record_id").alias("right_id"), "video", "frame", F.col("label_sha256").alias("r"))
    return a.join(b, ["video", "frame"]).filter("l <> r").select("left_id", "right_id").distinct()


@query(f"WITH {_I} SELECT coalesce(a.source, b.source) AS source, a.source IS NOT NULL AS in_train, b.source IS NOT NULL AS in_test, a.l = b.l AS labels_equal FROM (SELECT source, min(label_sha256) AS l FROM iv WHERE split = 'train' AND source IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT source, min(label_sha256) AS l FROM iv WHERE split = 'test' AND source IS NOT NULL GROUP BY 1) b ON a.source = b.source")
def split_comparison(spark, d):
    """Sources shared by, missing from and extra in the test split (a full outer join)."""
    rows = inv(spark, d).filter("source is not null")
    side = lambda s, n: rows.filter(F.col("split") == s).groupBy("source").agg(F.min("label_sha256").alias(n))
    return side("train", "a").join(side("test", "b"), "source", "full").select("source", F.col("a").isNotNull().alias("in_train"), F.col("b").isNotNull().alias("in_test"), (F.col("a") == F.col("b")).alias("labels_equal"))


@query(f"WITH {_I}, t AS (SELECT source FROM iv WHERE split = 'train' AND source IS NOT NULL), e AS (SELECT source FROM iv WHERE split = 'test' AND source IS NOT NULL) SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM t INTERSECT SELECT * FROM e) UNION ALL SELECT 'train only', count(*) FROM (SELECT * FROM t EXCEPT SELECT * FROM e) UNION ALL SELECT 'test only', count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM t) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM t UNION SELECT * FROM e)")
def set_operations(spark, d):
    """Intersection, both differences and union of two sets of sources."""
    rows = inv(spark, d).filter("source is not null")
    t, e = rows.filter("split = 'train'").select("source"), rows.filter("split = 'test'").select("source")
    count = lambda df, n: df.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(t.intersect(e), "both").unionByName(count(t.subtract(e), "train only")).unionByName(count(e.subtract(t), "test only")).unionByName(count(t.union(e).distinct(), "either"))


@query(f"WITH {_I} SELECT video, count_if(split = 'train') AS train, count_if(split = 'valid') AS valid, count_if(split = 'test') AS test FROM iv WHERE video IS NOT NULL GROUP BY video")
def video_split_counts(spark, d):
    """Frames per video and split."""
    return inv(spark, d).filter("video is not null").groupBy("video").agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "valid", "test")])


@query(f"""WITH {_I} SELECT record_id, CASE WHEN regexp_full_match(source, 'video\\d+_\\d+') THEN 'explicit_video:' || regexp_extract(source, '^video\\d+') WHEN regexp_full_match(source, 'frame[_-]?\\d+') THEN 'implicit_sequence:frame' WHEN regexp_full_match(source, 'video\\d+') THEN 'implicit_sequence:video' END AS family,
 left(regexp_replace(trim(regexp_replace(image, '[^0-9A-Za-z._-]+', '_', 'g'), '._-'), '^$', 'image'), 100) AS safe_name, CAST(('0x' || substr(sha256(image), 1, 8)) AS BIGINT) % 4 AS bucket, regexp_replace(list_extract(string_split(image, '/'), -1), '\\.rf\\..*$', '') AS base_name FROM iv""")
def record_names(spark, d):
    """Capture family, safe file name, hash bucket and base name of each record."""
    return inv(spark, d).select("record_id", A.capture_family(F.col("source")).alias("family"), X.safe_name(F.col("image")).alias("safe_name"), X.hash_bucket(F.col("image"), 4).alias("bucket"), X.base_name(F.col("image")).alias("base_name"))


@query(f"WITH {_I} SELECT record_id, sig AS signature FROM (SELECT record_id, array_to_string(list_sort(list_transform({S.lines('label_signature')}, lambda l: regexp_replace(trim(regexp_replace(l, '\\s+', ' ', 'g')), ' +', ' ', 'g'))), chr(10)) AS sig FROM iv WHERE {S.usable('label_signature')})")
def canonical_labels(spark, d):
    """Label lines with single blanks, sorted, per usable record."""
    return inv(spark, d).select("record_id", X.sorted_lines(F.col("label_signature")).alias("signature")).filter("signature is not null")


@query(f"WITH {_I}, w AS (SELECT DISTINCT unnest(string_split(source, '_')) AS word, record_id FROM iv WHERE source IS NOT NULL), f AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word) SELECT word, n FROM f WHERE n >= least((SELECT max(n) FROM f), 100)")
def frequent_words(spark, d):
    """Name parts that occur in at least 100 records, or in as many as the most frequent one."""
    return X.frequent_parts(inv(spark, d).select("record_id", "source"), "record_id", "source", "_", 100)


@query(f"WITH {_I}, c AS (SELECT dataset, width, height, least(49, greatest(0, CAST(floor(width / 12000.0 * 50) AS INT))) AS bx, least(49, greatest(0, CAST(floor(height / 12000.0 * 50) AS INT))) AS by_ FROM iv WHERE width BETWEEN 1 AND 12000 AND height BETWEEN 1 AND 12000) SELECT bx, by_ AS by, count(*) AS n FROM c GROUP BY ALL")
def size_histogram(spark, d):
    """A 50 x 50 histogram of image sizes."""
    bin_ = lambda c: F.least(F.lit(49), F.greatest(F.lit(0), F.floor(F.col(c) / 12000.0 * 50).cast("int")))
    return inv(spark, d).filter("width between 1 and 12000 and height between 1 and 12000").groupBy(bin_("width").alias("bx"), bin_("height").alias("by")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_I}, a AS (SELECT dataset, record_id, width / height AS ratio FROM iv WHERE width BETWEEN 1 AND 12000 AND height BETWEEN 1 AND 12000), r AS (SELECT *, (row_number() OVER (PARTITION BY dataset ORDER BY ratio, record_id) - 1) // 16 AS batch FROM a) SELECT dataset, batch, count(*) AS images, round(min(ratio), 6) AS least, round(max(ratio), 6) AS most FROM r GROUP BY ALL")
def aspect_batches(spark, d):
    """Batches of 16 images of like aspect within each dataset."""
    rows = inv(spark, d).filter("width between 1 and 12000 and height between 1 and 12000").select("dataset", "record_id", (F.col("width") / F.col("height")).alias("ratio"))
    batched = ordered_rank(rows, ["dataset"], [F.col("ratio"), F.col("record_id")], "k").withColumn("batch", F.floor(F.col("k") / 16))
    return batched.groupBy("dataset", "batch").agg(F.count(F.lit(1)).alias("images"), F.round(F.min("ratio"), 6).alias("least"), F.round(F.max("ratio"), 6).alias("most"))


@query(f"WITH {_I}, n AS (SELECT record_id, dataset, ntile(3) OVER (PARTITION BY dataset ORDER BY width * height, image, record_id) AS bin, width * height AS area FROM iv WHERE width BETWEEN 1 AND 12000 AND height BETWEEN 1 AND 12000) SELECT dataset, bin, count(*) AS images, min(area) AS least, median(area) AS middle, max(area) AS most FROM n GROUP BY ALL")
def area_tertiles(spark, d):
    """Three equal bins by area within each dataset."""
    rows = inv(spark, d).filter("width between 1 and 12000 and height between 1 and 12000").select("dataset", "image", "record_id", (F.col("width") * F.col("height")).alias("area"))
    ranked = ordered_rank(rows, ["dataset"], [F.col("area"), F.col("image"), F.col("record_id")], "k", "n")
    # the first n mod 3 bins have one row more
    base, more = F.floor(F.col("n") / 3), F.col("n") % 3
    long_ = F.floor(F.col("k") / (base + 1))
    bin_ = F.when(F.col("k") < more * (base + 1), long_).otherwise(more + F.floor((F.col("k") - more * (base + 1)) / base))
    return ranked.withColumn("bin", (bin_ + 1).cast("int")).groupBy("dataset", "bin").agg(F.count(F.lit(1)).alias("images"), F.min("area").alias("least"), F.percentile("area", 0.5).alias("middle"), F.max("area").alias("most"))


@query(f"""WITH {_I}, s AS (SELECT record_id, width, height, unnest(range(0, CASE WHEN width <= 1024 THEN 1 ELSE CAST(ceil((width - 1024) / 824.0 + 1) AS BIGINT) END)) AS i FROM iv WHERE width BETWEEN 1 AND 12000 AND height BETWEEN 1 AND 12000),
t AS (SELECT record_id, width, height, CASE WHEN width > 1024 AND i * 824 + 1024 > width THEN width - 1024 ELSE i * 824 END AS x, unnest(range(0, CASE WHEN height <= 1024 THEN 1 ELSE CAST(ceil((height - 1024) / 824.0 + 1) AS BIGINT) END)) AS j FROM s)
SELECT record_id, CAST(x AS INT) AS x, CAST(CASE WHEN height > 1024 AND j * 824 + 1024 > height THEN height - 1024 ELSE j * 824 END AS INT) AS y FROM t""")
def tiles(spark, d):
    """Overlapping tiles of 1024 px with a gap of 200, the last one moved back."""
    rows = inv(spark, d).filter("width between 1 and 12000 and height between 1 and 12000")
    cut = rows.select("record_id", "height", F.explode(G.tile_starts(F.col("width"), 1024, 824)).alias("x"))
    both = cut.select("record_id", "x", F.explode(G.tile_starts(F.col("height"), 1024, 824)).alias("y"))
    return both.select("record_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


_D = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


_NEAREST = f"""WITH u AS (SELECT vec_id, list_transform({_D}, lambda x: x / sqrt(list_inner_product({_D}, {_D}))) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v) AS score FROM u q, u e WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS k FROM s) SELECT query_id, vec_id, round(score, 6) AS score FROM r WHERE k <= 30 AND score >= 0.1"""


@query(_NEAREST)
def nearest_vectors(spark, d):
    """The 30 nearest vectors of every vector whose id is divisible by 20, and of these those at 0.1 or more."""
    e = read_table(spark, d, "embeddings")
    return V.nearest(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 30, 0.1).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(_NEAREST)
def kept_index_search(spark, d):
    """The same from an index that is built once, kept, and opened again for the search."""
    e, path = read_table(spark, d, "embeddings"), scratch_path(spark, "index")
    for _ in range(2):
        index = V.kept_index(spark, path, lambda: V.packed(e, "vec_id", "embedding"))
    return V.nearest(e.filter("vec_id % 20 = 0"), index, "vec_id", "embedding", 30, 0.1).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("WITH s AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS cls, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT vec_id, cls, round(v, 6) AS score FROM s WHERE v > 0.2")
def multi_label(spark, d):
    """All classes of a score vector above a limit."""
    e = read_table(spark, d, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("cls", "v")).filter(F.col("v").cast("double") > 0.2).select("vec_id", "cls", F.round(F.col("v").cast("double"), 6).alias("score"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS top1, label, list_transform(list_slice(list_sort(list_transform(range(1, len(embedding) + 1), lambda i: {'v': -embedding[i], 'i': i - 1})), 1, 5), lambda s: CAST(s.i AS INT)) AS top5 FROM embeddings")
def top_classes(spark, d):
    """The best and the five best classes of each score vector."""
    e = read_table(spark, d, "embeddings")
    pairs = F.transform("embedding", lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
    return e.select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("top1"), "label", F.transform(F.slice(F.array_sort(pairs), 1, 5), lambda s: s["i"]).alias("top5"))


@query("SELECT label, count(*) AS n, round(avg(CASE WHEN list_position(embedding, list_max(embedding)) - 1 = label THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN len(list_filter(embedding, lambda v: v > embedding[label + 1])) < 5 THEN 1.0 ELSE 0.0 END), 6) AS top5 FROM embeddings GROUP BY label")
def classification_accuracy(spark, d):
    """Top-1 and top-5 accuracy per class."""
    e = read_table(spark, d, "embeddings")
    own = F.element_at("embedding", F.col("label") + 1)
    better = F.size(F.filter("embedding", lambda v: v > own))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.array_position("embedding", F.array_max("embedding")) - 1 == F.col("label")).cast("double")), 6).alias("top1"), F.round(F.avg((better < 5).cast("double")), 6).alias("top5"))


@query("SELECT list_position(embedding, list_max(embedding)) - 1 AS predicted, label AS actual, count(*) AS n FROM embeddings GROUP BY ALL")
def class_confusion(spark, d):
    """Confusion counts of the best class."""
    e = read_table(spark, d, "embeddings")
    return e.groupBy((F.array_position("embedding", F.array_max("embedding")) - 1).alias("predicted"), F.col("label").alias("actual")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))), 6) AS square, round(list_max(embedding) - list_min(embedding), 6) AS span, len(list_filter(embedding, lambda v: v > 0.1)) / nullif(len(list_filter(embedding, lambda v: v > -0.1)), 0) AS stability FROM embeddings")
def vector_statistics(spark, d):
    """Squared norm, span and stability (counts above two limits) of each vector."""
    e = read_table(spark, d, "embeddings")
    above = lambda t: F.size(F.filter("embedding", lambda v: v > F.lit(t).cast("double")))
    return e.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")), 6).alias("square"), F.round(F.array_max("embedding") - F.array_min("embedding"), 6).alias("span"), F.try_divide(above(0.1), above(-0.1)).alias("stability"))
