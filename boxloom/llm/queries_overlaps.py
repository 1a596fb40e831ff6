"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxloom.llm import overlaps
from boxloom.runtime import read_table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train and an evaluation record that show the same or almost the same image."""
    return overlaps.overlap_pairs(read_table(spark, sf_dir, "audit"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap with train per evaluation split and source."""
    return overlaps.overlap_report(read_table(spark, sf_dir, "audit"))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
