"""Compaction: many tiny files become few well-sized ones, each delivery resolved and each box kept once.

The steps are those of a table maintenance job: freeze a manifest of what is there, resolve which deliveries
are the same file, pack the files into bins by first-fit decreasing, rewrite bin by bin, verify counts and
checksums of what was written against the manifest, and publish the result by one rename. All planning works on the
manifest, which has sizes and hashes; bodies are read for it and moved once, at the rewrite.

Defined results: a row whose ``label`` and ``image`` are both null or blank has no place (``path`` null); it is
kept as a file of its own (equal rows without place are one file). A row without ``file_id`` takes part as any other
but is in no pair. A null body counts as empty (0 bytes). Files of 0 bytes take one byte of a bin, so that
no bin collects empty files without limit. A file larger than a bin gets a bin of its own. An empty table gives
an empty manifest and no bins. Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions.labels import good_line_count
from boxloom.functions.names import label_path_of, strip_blanks, tidy_path
from boxloom.operators.packing import first_fit_decreasing
from boxloom.operators.ranking import lookup, meet, ordered_rank
from boxloom.runtime import scratch_path, settle

#: A plan has at most so many size classes: small sizes are exact, larger ones are rounded up to a few leading bits.
SIZE_CLASSES = 65_536


def _hash_of_body() -> Column:
    return F.xxhash64(F.coalesce("body", F.lit("")))


def manifest(files: DataFrame) -> DataFrame:
    """One row per delivered file, without its body: ``file_id, path, n_bytes, n_boxes, body_hash, modified_at``; no path for nameless rows."""
    label, image = strip_blanks(F.col("label")), strip_blanks(F.col("image"))
    path = F.when(label != "", tidy_path(F.col("label"))).when(image != "", label_path_of(F.col("image")))
    return files.select(
        "file_id",
        path.alias("path"),
        F.octet_length(F.coalesce("body", F.lit(""))).cast("long").alias("n_bytes"),
        good_line_count(F.col("body")).alias("n_boxes"),
        _hash_of_body().alias("body_hash"),
        "modified_at",
    )


def same_file_pairs(listed: DataFrame) -> DataFrame:
    """Pairs of manifest rows that lead to one place: ``file_id_a < file_id_b``.

    Places are worked out once; only those with several rows are joined, portion by portion where one has many.
    """
    named = settle(listed.select("file_id", "path").filter("path is not null and file_id is not null"))
    several = named.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("path")
    rows = lookup(named, several, "path", "inner")
    a, b = rows.select("path", F.col("file_id").alias("file_id_a")), rows.select("path", F.col("file_id").alias("file_id_b"))
    return meet(a, b, "path").filter("file_id_a < file_id_b").select("file_id_a", "file_id_b")


def resolve_deliveries(listed: DataFrame) -> DataFrame:
    """One delivery per place: the one with most boxes, then most bytes, then the latest, then the smallest id.

    The choice is one map-side combined maximum, so a file delivered millions of times needs no sort.
    """
    own = F.concat_ws("\0", F.lit(""), F.col("file_id").cast("string"), F.col("body_hash").cast("string"))
    best = F.max_by(F.struct("file_id", "path", "n_bytes", "n_boxes", "body_hash"), F.struct("n_boxes", "n_bytes", "modified_at", -F.col("file_id")))
    return listed.groupBy(F.coalesce("path", own).alias("_key")).agg(best.alias("f"), F.count(F.lit(1)).alias("deliveries")).select("f.*", "deliveries")


def exact_bits(bin_bytes: int) -> int:
    """How many leading bits of sizes up to ``bin_bytes`` can be kept in ``SIZE_CLASSES`` classes (13 for 128 MiB)."""
    length = max(1, (bin_bytes - 1).bit_length())
    # sizes of up to b bits are exact, each further doubling has 2 ** (b - 1) classes
    return max(b for b in range(1, length + 1) if b == 1 or (bin_bytes if b == length else (1 << b) + (length - b) * (1 << (b - 1))) <= SIZE_CLASSES)


def assign_bins(chosen: DataFrame, bin_bytes: int) -> DataFrame:
    """Adds ``bin_id`` by first-fit decreasing over the histogram of sizes.

    The driver sees the histogram only: at most ``SIZE_CLASSES`` rows. Its plan, a list of runs per size, goes back
    as a table of at most as many rows. Sizes of a few leading bits are exact (below 8 KiB for bins of 128 MiB), others
    are rounded up by less than one in 2 ** 12 there, so tiny files fill a bin as well as large ones.
    """
    spark = chosen.sparkSession
    room = max(1, bin_bytes)
    plain = F.least(F.greatest(F.col("n_bytes"), F.lit(1)), F.lit(room)).cast("long")
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(plain)) - exact_bits(room), F.lit(0))).cast("long")
    sized = chosen.withColumn("_size", F.least(F.ceil(plain / step) * step, F.lit(room)).cast("long"))
    histogram = {r["_size"]: r["n"] for r in sized.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = first_fit_decreasing(histogram, room)
    by_size: dict[int, list[tuple[int, int, int, int]]] = {}
    for r in runs:
        by_size.setdefault(r.size, []).append((r.lo, r.hi, r.first_bin, r.per_bin))
    plan = spark.createDataFrame(sorted(by_size.items()), "_size bigint, _runs array<struct<lo:bigint,hi:bigint,first_bin:bigint,per_bin:bigint>>")
    ranked = ordered_rank(sized, ["_size"], [F.col("file_id")], "_rank")
    run = F.element_at(F.filter("_runs", lambda x: (x["lo"] <= F.col("_rank")) & (F.col("_rank") < x["hi"])), 1)
    placed = ranked.join(F.broadcast(plan), "_size").withColumn("_run", run)
    return placed.select(*chosen.columns, F.expr("_run.first_bin + (_rank - _run.lo) div _run.per_bin").alias("bin_id"))


def _sums(df: DataFrame) -> DataFrame:
    """Per bin: rows, bytes, boxes and two order-free checksums of ids, places and bodies (equal rows cancel in the first only)."""
    row = F.xxhash64("file_id", "path", "body_hash")
    return df.groupBy("bin_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sum("n_boxes").alias("n_boxes"),
        F.struct(F.bit_xor(row).alias("all"), F.sum(row.bitwiseAND(0xFFFFFFFF)).alias("low")).alias("checksum"),
    )


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def compact(files: DataFrame, target: str | None = None, bin_bytes: int = 128 << 20) -> tuple[DataFrame, DataFrame]:
    """Rewrite ``files`` into bins of about ``bin_bytes`` below ``target``; gives (rows as read back, report per bin).

    The new table is written beside its final name, verified, and renamed: readers see all of it or nothing. If a
    check fails the staged table is removed and ``ValueError`` names the bins; the source is never touched.
    """
    spark = files.sparkSession
    target = target or scratch_path(spark, "compacted")
    staged = f"{target}._staging"
    plan = settle(assign_bins(resolve_deliveries(settle(manifest(files))), bin_bytes))
    expected = _sums(plan)
    totals = plan.agg(F.count(F.lit(1)).alias("rows"), F.max("bin_id").alias("last")).first()
    # bodies come in here only: to the row of the plan that chose them, and on to their bin
    id_of = F.coalesce("file_id", F.lit(-(1 << 63))).alias("_id")
    bodies = files.select(id_of, _hash_of_body().alias("body_hash"), F.coalesce("body", F.lit("")).alias("body")).groupBy("_id", "body_hash").agg(F.min("body").alias("body"))
    moved = plan.select("*", id_of).join(bodies, ["_id", "body_hash"]).select("file_id", "path", "body", "n_bytes", "n_boxes", "deliveries", "bin_id")
    # one partition, and so one file, per bin
    moved.repartitionById((totals["last"] or 0) + 1, F.col("bin_id").cast("int")).sortWithinPartitions("path").write.mode("errorifexists").parquet(staged)
    written = spark.read.parquet(staged).withColumn("body_hash", _hash_of_body())
    a, b = expected.alias("a"), _sums(written).alias("b")
    report = a.join(b, F.col("a.bin_id") == F.col("b.bin_id"), "full").select(
        F.coalesce("a.bin_id", "b.bin_id").alias("bin_id"), "a.n_files", "a.n_bytes", "a.n_boxes",
        (F.col("a.n_bytes") / bin_bytes).alias("fill"),
        *[F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")).alias(f"{c}_ok") for c in ("n_files", "n_bytes", "n_boxes", "checksum")],
    )
    report = settle(report)
    wrong = [r[0] for r in report.filter("not (n_files_ok and n_bytes_ok and n_boxes_ok and checksum_ok)").select("bin_id").limit(20).collect()]
    fs, path = _file_system(spark, staged)
    if wrong:
        fs.delete(path(staged), True)
        raise ValueError(f"the rewritten bins {wrong} differ from the manifest")
    note = fs.create(path(f"{staged}/_MANIFEST.json"), True)
    note.write(bytearray(json.dumps({"rows": totals["rows"], "bin_bytes": bin_bytes}).encode()))
    note.close()
    if not fs.rename(path(staged), path(target)):
        raise OSError(f"{target} could not be published")
    return spark.read.parquet(target), report
