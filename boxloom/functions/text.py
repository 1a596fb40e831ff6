"""Names, numbers and configuration values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.labels import label_lines, usable_signature


def safe_name(path: Column, most: int = 100) -> Column:
    """A file name of plain signs only: others become ``_``, edges are trimmed, at most ``most`` signs."""
    plain = F.regexp_replace(F.regexp_replace(path, "[^0-9A-Za-z._-]+", "_"), r"^[._-]+|[._-]+\z", "")
    return F.substring(F.when(plain == "", "image").otherwise(plain), 1, most)


def base_name(path: Column) -> Column:
    """The file name without the export tool's suffix (case matters)."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.rf\..*\z", "")


def hash_bucket(text: Column, buckets: int) -> Column:
    """A bucket from the first eight hex digits of the SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") % buckets


def sorted_lines(text: Column) -> Column:
    """The lines of a usable label text with single blanks, sorted."""
    plain = F.transform(label_lines(text), lambda line: F.trim(F.regexp_replace(line, r"\s+", " ")))
    return F.when(usable_signature(text), F.array_join(F.array_sort(plain), "\n"))


def six_digits(x: Column) -> Column:
    """A number with six significant digits as ``%.6g`` writes it; a digit 5 at the end of the number rounds up."""
    sci = F.format_string("%.5e", x.cast("double"))
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(sci, r"^(-?[0-9.]+)e", 1), r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")
    power = F.regexp_extract(sci, r"e([+-][0-9]+)\z", 1).cast("int")
    plain = F.regexp_replace(F.regexp_replace(sci.cast("double").cast("decimal(38,12)").cast("string"), r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")
    wide = F.concat(digits, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(x == 0, "0").when(power.between(-4, 5), plain).otherwise(wide)


def typed(text: Column) -> Column:
    """The kind of a configuration text: null, boolean, int, float, list or string."""
    low = F.lower(F.trim(text))
    return (
        F.when(low.isin("none", "null", ""), "null")
        .when(low.isin("true", "false"), "boolean")
        .when(low.try_cast("bigint").isNotNull() & low.rlike(r"^[+-]?[0-9]+\z"), "int")
        .when(low.try_cast("double").isNotNull(), "float")
        .when(low.rlike(r"^[\[(].*[\])]\z"), "list")
        .otherwise("string")
    )


def version_parts(text: Column) -> Column:
    """The numbers of a version text, as many as there are (at most three)."""
    return F.transform(F.slice(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), 1, 3), lambda v: v.cast("int"))


def clean_text(text: Column) -> Column:
    """Special signs replaced by underscores."""
    return F.regexp_replace(text, r"[|@#!¡·$€%&()=?¿^*;:,¨´><+]", "_")


def frequent_parts(rows: DataFrame, row_id: str, text: str, separator: str, floor: int) -> DataFrame:
    """``word, n``: parts of a text that occur in at least ``floor`` rows, or as often as the most frequent one."""
    each = rows.filter(F.col(text).isNotNull()).select(row_id, F.explode(F.array_distinct(F.split(text, separator))).alias("word")).filter("word <> ''")
    counted = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    limit = counted.agg(F.least(F.max("n"), F.lit(floor)).alias("_limit"))
    return counted.join(F.broadcast(limit), F.col("n") >= F.col("_limit")).select("word", "n")
