"""One surviving record per group of copies: skyline selection over completeness, recency and trust.

A record dominates another if it is no less complete, no less trusted and reviewed no earlier, and better in at
least one. Layer 1 is what nothing dominates; layer 2 is what nothing dominates once layer 1 is gone, and so on.
Every field of the survivor comes from the first layer that has a usable value of it, within the layer from the
most trusted, then most complete, then latest, then smallest record.

Defined results: a null review time is the earliest; a reviewer that is null or not listed has trust 0, one listed
twice has the higher trust. Records without a readable digest belong to no group. Equal records do not dominate
each other. A field that no record of the group can fill is null. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.labels import usable_signature
from boxloom.functions.names import usable_split
from boxloom.llm.audits import audit_records, with_whole_digest
from boxloom.operators.ranking import lookup, ordered_rank
from boxloom.runtime import settle

#: Deepest layer of a class that nothing leads to.
_NONE = -(1 << 30)
#: The fields of the survivor, in the order of their bits in ``mask``.
FIELDS = ("label_signature", "old_split")


def skyline(points: DataFrame, keys: list[str]) -> DataFrame:
    """The undominated points of each group: ``keys, mask, trust, at, n, record_id``.

    ``points`` has ``keys, record_id, mask, trust, at``; completeness is the number of bits in ``mask``. Rows are
    pre-aggregated to the latest ones per (mask, trust) on the map side, so what meets in one place per group is at
    most (masks x trust levels) points, whatever the size of the group. ``n`` counts equal records, of which
    ``record_id`` is the smallest.
    """
    same = points.groupBy(*keys, "mask", "trust", "at").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("record_id"))
    latest = same.groupBy(*keys, "mask", "trust").agg(F.max(F.struct("at", "n", (-F.col("record_id")).alias("minus_id"))).alias("m"))
    listed = latest.groupBy(*keys).agg(F.collect_list(F.struct("mask", "trust", "m.at", "m.n", (-F.col("m.minus_id")).alias("record_id"))).alias("ps"))

    def beaten(p: Column) -> Column:
        def beats(q: Column) -> Column:
            more, less = F.bit_count(q["mask"]), F.bit_count(p["mask"])
            no_worse = (more >= less) & (q["trust"] >= p["trust"]) & (q["at"] >= p["at"])
            return no_worse & ((more > less) | (q["trust"] > p["trust"]) | (q["at"] > p["at"]))

        return F.exists("ps", beats)

    return listed.select(*keys, F.explode(F.filter("ps", lambda p: ~beaten(p))).alias("p")).select(*keys, "p.*")


def copies(audit: DataFrame, reviewers: DataFrame) -> DataFrame:
    """Records of images that several records show: ``digest, first_record_id, record_id, mask, trust, at``."""
    bits = F.when(usable_signature(F.col("r.label_signature")), 1).otherwise(0) + F.when(usable_split(F.col("r.old_split")).isNotNull(), 2).otherwise(0)
    seen = F.coalesce(F.col("r.reviewed_at"), F.lit("0001-01-01").cast("timestamp_ntz")).cast("timestamp_ntz")
    rows = with_whole_digest(audit_records(audit, ["label_signature", "old_split", "reviewer", "reviewed_at"], {"mask": bits, "reviewer": F.col("r.reviewer"), "at": seen}), audit)
    grades = reviewers.filter("reviewer is not null").groupBy("reviewer").agg(F.max("trust").alias("trust"))
    rows = settle(rows.filter("digest is not null").join(grades, "reviewer", "left").withColumn("trust", F.coalesce("trust", F.lit(0))).drop("reviewer"))
    several = rows.groupBy("digest").agg(F.min("record_id").alias("first_record_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return lookup(rows, several, "digest", "inner")


def outstanding(group: DataFrame) -> DataFrame:
    """``first_record_id, field_name, record_id``: the record that beats all others of its group that have the field.

    It is the skyline over trust and recency among the records with a usable value, where that is a single record.
    """
    field = F.explode(F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.lit(name)) for i, name in enumerate(FIELDS)])).alias("field_name")
    usable = group.select("first_record_id", "record_id", "trust", "at", F.lit(1).alias("mask"), field).filter("field_name is not null")
    front = skyline(usable, ["first_record_id", "field_name"])
    lone = front.groupBy("first_record_id", "field_name").agg(F.sum("n").alias("n"), F.min("record_id").alias("record_id")).filter("n = 1")
    return lone.select("first_record_id", "field_name", "record_id")


def _fold(points: Column, start: Column, levels: int) -> Column:
    """The layers that ``points`` (from late to early, equal times from better to worse) reach, given those before them.

    The state holds the deepest layer per class so far and per field the best record yet. Whatever dominates a point
    comes before it and is of a class no worse in both respects, so its layer is one more than the deepest of these.
    """
    pick = "struct<minus_layer:int,trust:int,complete:int,at:timestamp_ntz,minus_id:bigint>"

    def take(state: Column, p: Column) -> Column:
        above = F.transform(state["deep"], lambda d, i: F.when((F.floor(i / levels) >= F.floor(p["k"] / levels)) & (i % levels >= p["k"] % levels), d).otherwise(_NONE))
        layer = F.get(F.transform(F.array(F.array_max(above)), lambda m: F.when(m < 0, _NONE).otherwise(m + 1)), F.lit(0))

        def put(at: Column) -> Column:
            deep = F.transform(state["deep"], lambda d, i: F.when(i == p["k"], F.greatest(d, at)).otherwise(d))
            offer = lambda old, i: F.greatest(old, F.when(F.get(p["ids"], i).isNotNull(), F.struct((-at).alias("minus_layer"), p["trust"].alias("trust"), F.floor(p["k"] / levels).cast("int").alias("complete"), p["at"].alias("at"), (-F.get(p["ids"], i)).alias("minus_id"))))
            return F.struct(deep.alias("deep"), F.transform(state["picks"], offer).alias("picks"))

        return F.get(F.transform(F.array(layer), put), F.lit(0))

    none = F.array(*[F.lit(None).cast(pick) for _ in FIELDS])
    return F.aggregate(points, F.struct(start.alias("deep"), none.alias("picks")), take)


def survivors(group: DataFrame, most_points: int = 20_000) -> DataFrame:
    """One row per group: ``first_record_id, n_records`` and for each field ``<field>_from`` (a record) and ``<field>_layer``.

    The layer of a record is the length of the longest chain of records that dominate one another down to it. Chains
    run from late to early, so one pass along time finds all layers, keeping only the deepest layer per class of equal
    completeness and trust. A group with more than ``most_points`` distinct points is cut into stretches of time; each
    stretch is told as a table of how much deeper it makes a chain on the way from one class to another, such tables add
    up along the group, and then every stretch is passed with what the later ones leave. The number of jobs is fixed.
    """
    key = "first_record_id"
    ids = F.array(*[F.min(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col("record_id"))) for i in range(len(FIELDS))])
    points = settle(group.groupBy(key, F.bit_count("mask").alias("c"), "trust", "at").agg(ids.alias("ids"), F.count(F.lit(1)).alias("n")))
    # trust levels come from the small table of reviewers
    trusts = sorted(r["trust"] for r in points.select("trust").distinct().collect()) or [0]
    classes = (len(FIELDS) + 1) * len(trusts)
    level = F.array_position(F.array(*[F.lit(t) for t in trusts]), F.col("trust")) - 1
    points = points.withColumn("k", (F.col("c") * len(trusts) + level).cast("int")).drop("c")
    facts = points.groupBy(key).agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("points"))
    hot = settle(facts.filter(F.col("points") > most_points).select(key))
    point = F.struct("at", "k", "trust", "ids")
    line = F.sort_array(F.collect_list(point), asc=False).alias("line")
    zeros = F.array_repeat(F.lit(0), classes)
    cold = points.join(hot, key, "left_anti").groupBy(key).agg(line).select(key, _fold(F.col("line"), zeros, len(trusts))["picks"].alias("picks"))
    ranked = ordered_rank(lookup(points, hot, key, "inner"), [key], [F.desc("at"), F.desc("k"), F.desc("trust")], "_rank")
    pieces = settle(ranked.groupBy(key, F.floor(F.col("_rank") / most_points).alias("piece")).agg(line))
    only = lambda j: F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == j, 0).otherwise(_NONE))
    deeper = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda j: _fold(F.col("line"), only(j), len(trusts))["deep"])
    along = pieces.select(key, F.struct("piece", deeper.alias("deeper")).alias("m")).groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("ms"))

    def on(state: Column, m: Column) -> Column:
        reach = lambda c: F.array_max(F.zip_with(state["deep"], m["deeper"], lambda d, row: d + F.get(row, c)))
        after = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.greatest(reach(c), F.get(state["deep"], c)))
        return F.struct(after.alias("deep"), F.concat(state["starts"], F.array(F.struct(m["piece"].alias("piece"), state["deep"].alias("start")))).alias("starts"))

    begin = F.struct(zeros.alias("deep"), F.array().cast("array<struct<piece:bigint,start:array<int>>>").alias("starts"))
    starts = along.select(key, F.explode(F.aggregate("ms", begin, on)["starts"]).alias("s")).select(key, "s.*")
    warm = pieces.join(starts, [key, "piece"]).select(key, _fold(F.col("line"), F.col("start"), len(trusts))["picks"].alias("picks"))
    best = cold.unionByName(warm).groupBy(key).agg(*[F.max(F.get("picks", F.lit(i))).alias(f"p{i}") for i in range(len(FIELDS))])
    cells = [c for i, n in enumerate(FIELDS) for c in ((-F.col(f"p{i}.minus_id")).alias(f"{n}_from"), (-F.col(f"p{i}.minus_layer")).alias(f"{n}_layer"))]
    return facts.select(key, "n_records").join(best, key).select(key, "n_records", *cells)
