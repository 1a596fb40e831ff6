"""The records inside audited digests, each once, under one spelling of the digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions.names import digest_hex
from boxloom.operators.ranking import lookup
from boxloom.runtime import settle


def whole_digests(digests: DataFrame) -> DataFrame:
    """``digest, whole``: for each digest cut short (column ``digest``), the longer one that it begins.

    A cut digest that begins two different complete ones is ambiguous and stands for itself, as does one that begins
    none; where there is no complete one, the longest cut one is taken. Digests meet on their first 16 digits, and
    one exchange on these serves the distinct rows and both sides of the join.
    """
    head = F.conv(F.substring("digest", 1, 16), 16, -10).cast("bigint").alias("head")
    each = digests.filter("digest is not null").select("digest", head).repartition("head").distinct()
    cut = each.filter(F.length("digest") < 64).select("head", F.col("digest").alias("cut"))
    longer = cut.join(each, "head").filter((F.length("digest") > F.length("cut")) & F.expr("startswith(digest, cut)"))
    full = F.when(F.length("digest") == 64, F.col("digest"))
    best = longer.groupBy("cut").agg(F.min(full).alias("lo"), F.max(full).alias("hi"), F.max(F.struct(F.length("digest"), "digest")).alias("far"))
    return best.filter("lo is null or lo = hi").select(F.col("cut").alias("digest"), F.coalesce("lo", "far.digest").alias("whole"))


def audit_records(audit: DataFrame, needs: list[str], fields: dict) -> DataFrame:
    """``record_id, digest`` and ``fields`` (name -> column over ``r``, the record), one row per record.

    ``needs`` names the parts of the record that ``fields`` use: only these are zipped and exploded, so the scan reads
    no other part of the nested column.

    Null lists and null entries hold no records; a null ``record_id`` names none. An unreadable digest is null. If a
    record is delivered again with other content, the greatest (digest, fields) is kept, so the result is defined.
    """
    zipped = F.arrays_zip(*[F.col(f"records.{n}").alias(n) for n in ("record_id", *needs)])
    rows = audit.select(digest_hex(F.col("image_sha256")).alias("digest"), F.explode(zipped).alias("r")).filter("r.record_id is not null")
    flat = rows.select(F.col("r.record_id").alias("record_id"), "digest", *[c.alias(n) for n, c in fields.items()])
    return flat.groupBy("record_id").agg(F.max(F.struct("digest", *fields)).alias("m")).select("record_id", "m.digest", *[f"m.{n}" for n in fields])


def with_whole_digest(records: DataFrame, audit: DataFrame) -> DataFrame:
    """``records`` with cut digests replaced by those that they begin; only rows with a cut digest are looked up."""
    # every notation is read once; both sides of the join take the plain digests
    known = whole_digests(settle(audit.select(digest_hex(F.col("image_sha256")).alias("digest")).filter("digest is not null")))
    is_cut = F.coalesce(F.length("digest") < 64, F.lit(False))
    mended = lookup(records.filter(is_cut), known, "digest").withColumn("digest", F.coalesce("whole", "digest"))
    return records.filter(~is_cut).unionByName(mended.select(*records.columns))
