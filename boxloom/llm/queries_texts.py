"""Queries of problems 6, 7 and 8 over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions.names import plain_name
from boxloom.llm import containers, mixing, reading
from boxloom.runtime import read_table, settle


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every text with its container, per kind of container."""
    return containers.pack(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "containers"))[0]


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers per kind, how many dominance fixed, the least possible number, and the fill."""
    return containers.pack(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "containers"))[1]


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind what must hold: all texts with tokens are there whole, none is cut without need, no container is too full, and few are used."""
    documents = read_table(spark, sf_dir, "documents")
    packed, report = containers.pack(documents, read_table(spark, sf_dir, "containers"))
    packed = settle(packed)
    texts = packed.groupBy("container_kind", "capacity", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.sum("first_token").alias("starts"))
    # pieces begin at the multiples of the capacity, and only the last one is short
    n = F.col("pieces")
    broken = (F.col("starts") != F.col("capacity") * n * (n - 1) / 2) | (F.ceil(F.col("tokens") / F.col("capacity")) != n)
    kinds = texts.groupBy("container_kind").agg(F.count(F.lit(1)).alias("texts"), F.count_if(broken).alias("broken"))
    full = packed.groupBy("container_kind", "capacity", "container_id").agg(F.sum("n_tokens").alias("held")).groupBy("container_kind").agg(F.count_if(F.col("held") > F.col("capacity")).alias("too_full"))
    few = report.select("container_kind", (F.col("containers") <= F.ceil(F.col("least") * 1.01 + 1)).alias("few"))
    return kinds.join(full, "container_kind").join(few, "container_kind").select("container_kind", "texts", "broken", "too_full", "few")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the mix with their copies."""
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached per source."""
    return mixing.shares_reached(*mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets")))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: whether no text is used too often, and whether the expected share of a source with texts is within 1 % of the mix, and one text, of its target."""
    mixed, goals = mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))
    mixed = settle(mixed)
    shares = mixing.shares_reached(mixed, goals)
    over = mixed.select(F.explode(F.array(*[F.struct(F.lit(goals[i][0]).alias("source"), (F.get("shares", F.lit(i)) > 0).alias("member"), (F.col("copies") > goals[i][2]).alias("over")) for i in range(len(goals))])).alias("x")).select("x.*")
    often = over.filter("member").groupBy("source").agg(F.count_if("over").alias("over"))
    total = mixed.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("all"))
    least = mixed.groupBy("source").agg(F.min("n_tokens").alias("text")).join(F.broadcast(total)).select("source", (F.col("text") / F.col("all")).alias("text"))
    # the share of sources without any text falls to the others
    within = shares.withColumn("alive", F.col("expected") > 0)
    scale = within.agg(F.sum(F.when(F.col("alive"), F.col("target_share")).otherwise(0.0)).alias("scale"))
    told = within.join(F.broadcast(scale)).join(often, "source", "left").join(least, "source", "left")
    near = ~F.col("alive") | (F.abs(F.col("expected") - F.col("target_share") / F.col("scale")) <= 0.01 + F.coalesce("text", F.lit(0.0)))
    return told.select("source", "target_share", (F.coalesce("over", F.lit(0)) == 0).alias("repeats_ok"), near.alias("share_ok"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.levels(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "reading_grades"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents most of whose prose is at grade 1 or 5."""
    return reading.extremes(_levels(spark, sf_dir))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, reading level and amount of prose of every document."""
    return _levels(spark, sf_dir)


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and words of prose per source, language and level."""
    documents = read_table(spark, sf_dir, "documents")
    named = documents.select("doc_id", plain_name(F.col("source")).alias("source"))
    levels = settle(_levels(spark, sf_dir))
    return named.join(levels, "doc_id").groupBy("source", "language", "level").agg(F.count(F.lit(1)).alias("documents"), F.sum("prose_words").alias("prose_words"))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold: every document is read once, blank ones have no level, and nine in ten graded ones, less the chance error of so many, have a level at most one from what a grader gave."""
    documents, grades = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "reading_grades")
    read = settle(_levels(spark, sf_dir))
    blank = documents.filter(F.coalesce(F.trim("text"), F.lit("")) == "").select("doc_id").join(read.filter("level is not null"), "doc_id").agg(F.count(F.lit(1)).alias("levelled_blanks"))
    given = grades.groupBy("doc_id").agg(F.collect_set("grade").alias("given")).join(read.filter("level is not null"), "doc_id")
    near = F.exists("given", lambda g: F.abs(g - F.col("level")) <= 1)
    right = given.agg((F.avg(near.cast("double")) >= 0.9 - 1 / F.sqrt(F.count(F.lit(1)))).alias("agrees"))
    return read.agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("doc_id").alias("distinct_documents")).join(F.broadcast(blank)).join(F.broadcast(right))


QUERIES = {"p6_packed": p6_packed, "p6_report": p6_report, "p6_checks": p6_checks, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_checks": p7_checks, "p8_found": p8_found, "p8_levels": p8_levels, "p8_profile": p8_profile, "p8_checks": p8_checks}

_NAME = "regexp_replace(lower(trim(source)), '[-\\s]', '_', 'g')"
SQL = {
    "p6_checks": "SELECT container_kind, (SELECT count(*) FROM documents WHERE text <> '') AS texts, 0 AS broken, 0 AS too_full, true AS few FROM (SELECT DISTINCT container_kind FROM containers)",
    "p8_checks": "SELECT count(*) AS documents, count(DISTINCT doc_id) AS distinct_documents, 0 AS levelled_blanks, true AS agrees FROM documents",
    "p7_checks": f"SELECT {_NAME} AS source, sum(target_share) AS target_share, true AS repeats_ok, true AS share_ok FROM mix_targets GROUP BY 1",
}
