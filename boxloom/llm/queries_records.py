"""Queries of problems 1, 2, 4 and 5 over image records and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm import links, percentiles, survivors
from boxloom.runtime import read_table, scratch_path, settle


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose ties reach into more than one usable split."""
    return links.torn(links.tied(read_table(spark, sf_dir, "image_records"))[0])


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new split of every record."""
    ties, _ = links.tied(read_table(spark, sf_dir, "image_records"))
    return links.deal(ties, read_table(spark, sf_dir, "split_targets"))


def p1_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spanning forest over capture groups that sources tie to each other."""
    return links.tied(read_table(spark, sf_dir, "image_records"))[1].select("a", "b", "weight")


def p1_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the new splits: records assigned, sources and capture groups in several of them, splits more than 1 % of all records off target."""
    records = read_table(spark, sf_dir, "image_records")
    made = settle(p1_splits(spark, sf_dir).select("record_id", "new_split"))
    named = links.named_records(records).select("record_id", "s", "g").distinct().join(made, "record_id")
    torn = lambda c: named.filter(F.col(c).isNotNull()).groupBy(c).agg((F.min("new_split") != F.max("new_split")).alias("torn")).agg(F.count_if("torn").alias(f"torn_{c}"))
    shares = p1_shares(spark, sf_dir).agg(F.count_if(F.abs(F.col("reached") - F.col("share")) > 0.01).alias("far_splits"))
    whole = made.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("record_id").alias("distinct_records"))
    return whole.join(F.broadcast(torn("s"))).join(F.broadcast(torn("g"))).join(F.broadcast(shares))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and share per new split, with the target."""
    targets = read_table(spark, sf_dir, "split_targets")
    made = p1_splits(spark, sf_dir).groupBy("new_split").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("component").alias("components"))
    total = made.agg(F.sum("records").alias("total"))
    return targets.join(made, targets["split_name"] == made["new_split"], "left").join(F.broadcast(total)).select("split_name", "share", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("components", F.lit(0)).alias("components"), (F.coalesce("records", F.lit(0)) / F.col("total")).alias("reached"))


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.copies(read_table(spark, sf_dir, "audit"), read_table(spark, sf_dir, "reviewers"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that stands out for a field among the copies of an image."""
    return survivors.outstanding(_copies(spark, sf_dir))


def p2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record per image with copies, field by field with its origin."""
    return survivors.survivors(_copies(spark, sf_dir))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "percentile_targets").select(F.col("measure_name").alias("measure"), "pct", F.col("max_rank_error").alias("error"))


def _error(targets: DataFrame) -> float:
    """The error of the daily summaries: that of the strictest target."""
    return targets.agg(F.min("error")).first()[0] or 0.0


def _names() -> list:
    return [F.col("grp").alias("old_split"), F.col("measure").alias("measure_name"), "pct", F.col("total").alias("n")]


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of width and height per split by radix selection over daily partials."""
    out = percentiles.radix_percentiles(percentiles.sizes_by_day(read_table(spark, sf_dir, "image_records")), _targets(spark, sf_dir))
    return out.select(*_names(), percentiles.value_of(F.col("key")).cast("bigint").alias("value"))


def p4_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from daily summaries: bounds of the value and the rank error at most made."""
    targets = _targets(spark, sf_dir)
    digits = percentiles.daily_digits(percentiles.sizes_by_day(read_table(spark, sf_dir, "image_records")), _error(targets))
    out = percentiles.percentiles_of(digits, targets)
    return out.select(*_names(), *[percentiles.value_of(F.col(c)).alias(c) for c in ("lo", "hi")], "rank_error")


def p4_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles after a new day came in: its summary joins those kept of all days before, whose values are not read again.

    While no day has so many values per group that the strictest error is one of them, summaries are whole and the result is exact.
    """
    targets, values = _targets(spark, sf_dir), percentiles.sizes_by_day(read_table(spark, sf_dir, "image_records"))
    values = settle(values)
    last = values.agg(F.max("part")).first()[0]
    kept, error = scratch_path(spark, "digits"), _error(targets)
    for day in (F.coalesce(F.col("part") < F.lit(last), F.lit(True)), F.col("part") == F.lit(last)):
        percentiles.daily_digits(values.filter(day), error).write.mode("append").parquet(kept)
    out = percentiles.percentiles_of(spark.read.parquet(kept), targets)
    return out.select(*_names(), percentiles.value_of(F.col("lo")).cast("bigint").alias("value"))


def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rank of both bounds of ``p4_bounded``, counted over all values, is within the error stated and the error asked for."""
    targets, values = _targets(spark, sf_dir), settle(percentiles.sizes_by_day(read_table(spark, sf_dir, "image_records")))
    out = percentiles.percentiles_of(percentiles.daily_digits(values, _error(targets)), targets).join(targets.withColumnRenamed("error", "asked"), ["measure", "pct"])
    counts = values.groupBy("grp", "measure", "key").agg(F.count(F.lit(1)).alias("m"))
    seen = out.join(counts, ["grp", "measure"]).groupBy("grp", "measure", "pct", "total", "lo", "hi", "rank_error", "asked").agg(*[F.sum(F.when(c, F.col("m")).otherwise(0)).alias(n) for n, c in {"under_lo": F.col("key") < F.col("lo"), "upto_lo": F.col("key") <= F.col("lo"), "under_hi": F.col("key") < F.col("hi"), "upto_hi": F.col("key") <= F.col("hi")}.items()])
    rank = F.greatest(F.lit(1), F.ceil(F.col("pct") * F.col("total") - 1e-9))
    # the percentile lies between the bounds, and each bound's own ranks come as near to the one asked for as stated
    off = lambda below, upto: F.greatest(below + 1 - rank, rank - upto, F.lit(0)) / F.col("total")
    held = (F.col("under_lo") < rank) & (rank <= F.col("upto_hi")) & (F.greatest(off(F.col("under_lo"), F.col("upto_lo")), off(F.col("under_hi"), F.col("upto_hi"))) <= F.col("rank_error") + 1e-12) & (F.col("rank_error") <= F.col("asked"))
    return seen.select(*_names(), held.alias("within"))


QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits, "p1_forest": p1_forest, "p1_shares": p1_shares, "p1_checks": p1_checks, "p2_found": p2_found, "p2_survivors": p2_survivors, "p4_percentiles": p4_percentiles, "p4_bounded": p4_bounded, "p4_merged": p4_merged, "p4_checks": p4_checks}
