"""Registered queries of the core operators for data maintenance, with SQL where it can tell the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.operators import compaction
from boxloom.plans.shared_sql import good_lines
from boxloom.runtime import read_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of deliveries of the same label file."""
    return compaction.same_file_pairs(compaction.manifest(read_table(spark, sf_dir, "label_files")))


def p3_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label files as rewritten into bins of the production size, one row per file."""
    rows, _ = compaction.compact(read_table(spark, sf_dir, "label_files"))
    return rows.select("file_id", "path", "body", "n_bytes", "n_boxes", "deliveries")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per bin of 64 KiB: what went in, how full it is, and that the copy is whole."""
    _, report = compaction.compact(read_table(spark, sf_dir, "label_files"), bin_bytes=64 << 10)
    return report.select("bin_id", "n_files", "n_bytes", "n_boxes", F.round("fill", 6).alias("fill"), "n_files_ok", "n_bytes_ok", "n_boxes_ok", "checksum_ok")


def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for many bins (4 KiB each): all files, bytes and boxes are there, no file twice, no bin too full, all but the last well filled."""
    rows, report = compaction.compact(read_table(spark, sf_dir, "label_files"), bin_bytes=4 << 10)
    last = report.agg(F.max("bin_id").alias("last"))
    bins = report.join(F.broadcast(last)).agg(F.count_if(F.expr("fill > 1")).alias("too_full"), F.count_if(F.expr("fill < 0.9 and bin_id < last")).alias("too_empty"), F.count_if(~F.expr("n_files_ok and n_bytes_ok and n_boxes_ok and checksum_ok")).alias("wrong"))
    files = rows.agg(F.count(F.lit(1)).alias("files"), (F.count(F.lit(1)) - F.count_distinct("file_id")).alias("repeated"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n_boxes"), F.lit(0)).alias("boxes"))
    return files.join(F.broadcast(bins))


QUERIES = {"p3_found": p3_found, "p3_compacted": p3_compacted, "p3_report": p3_report, "p3_checks": p3_checks}

_BLANKS = r"[\s' || chr(160) || '\t]"


def _place(c: str) -> str:
    """A path without escapes, back and double slashes and ``.`` and ``..`` steps, as SQL."""
    out = f"replace(nfc_normalize(url_decode(replace(regexp_replace({c}, '^{_BLANKS}+|{_BLANKS}+$', '', 'g'), '+', '%2B'))), chr(92), '/')"
    out = f"regexp_replace('/' || {out}, '/(\\./|/)+', '/', 'g')"
    for _ in range(3):
        out = f"regexp_replace({out}, '/[^/]+/\\.\\./', '/')"
    return f"ltrim({out}, '/')"


_P3 = f"""
WITH p AS (
  SELECT file_id, CASE WHEN label IS NOT NULL AND trim(label) <> '' THEN {_place('label')}
    WHEN image IS NOT NULL AND trim(image) <> '' THEN regexp_replace(regexp_replace({_place('image')}, '^(.*/|)images/', '\\1labels/'), '\\.[^./]*$', '') || '.txt' END AS path
  FROM label_files
)
SELECT a.file_id AS file_id_a, b.file_id AS file_id_b FROM p a JOIN p b ON a.path = b.path AND a.file_id < b.file_id
"""
_CHOSEN = f"""
WITH p AS (
  SELECT file_id, modified_at, coalesce(body, '') AS body, strlen(coalesce(body, '')) AS n_bytes, {good_lines("coalesce(body, '')")} AS n_boxes,
    CASE WHEN label IS NOT NULL AND trim(label) <> '' THEN {_place('label')}
    WHEN image IS NOT NULL AND trim(image) <> '' THEN regexp_replace(regexp_replace({_place('image')}, '^(.*/|)images/', '\\1labels/'), '\\.[^./]*$', '') || '.txt' END AS path
  FROM label_files
), r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY coalesce(path, '*' || file_id)) AS deliveries FROM p WINDOW w AS (PARTITION BY coalesce(path, '*' || file_id) ORDER BY n_boxes DESC, n_bytes DESC, modified_at DESC NULLS LAST, file_id))
SELECT file_id, path, body, n_bytes, n_boxes, deliveries FROM r WHERE k = 1
"""
_CHECKS = f"SELECT count(*) AS files, 0 AS repeated, CAST(sum(n_bytes) AS BIGINT) AS bytes, CAST(sum(n_boxes) AS BIGINT) AS boxes, 0 AS too_full, 0 AS too_empty, 0 AS wrong FROM ({_CHOSEN})"
SQL = {"p3_found": _P3, "p3_compacted": _CHOSEN, "p3_checks": _CHECKS}
