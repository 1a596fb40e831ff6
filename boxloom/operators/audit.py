"""Dataset audits: inventories, validity, duplicates, leakage between splits, label conflicts, components, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.functions.labels import label_lines, usable_signature
from boxloom.functions.names import source_name, usable_split
from boxloom.operators.ranking import lookup
from boxloom.runtime import settle


def box_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """One row per non-blank label line: ``key, line_no, fields`` (as text) and the numbers ``cls, x, y, w, h`` where they parse."""
    lines = files.select(key, F.posexplode(label_lines(F.coalesce(F.col(text), F.lit("")))).alias("line_no", "line"))
    part = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    number = lambda i: F.when(F.size(part) >= i, F.element_at(part, i)).try_cast("double")
    return lines.select(key, (F.col("line_no") + 1).alias("line_no"), F.size(part).alias("fields"), *[number(i + 1).alias(n) for i, n in enumerate(("cls", "x", "y", "w", "h"))])


def validity(boxes: DataFrame, classes: int = 1) -> DataFrame:
    """The three validity rules of a five-number line: ``strict`` (no tolerance), ``tight`` (1e-6), ``loose`` (one percent)."""
    five = (F.col("fields") == 5) & F.col("cls").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    whole = (F.col("cls") == F.floor("cls")) & F.col("cls").between(0, classes - 1)
    sized = (F.col("w") > 0) & (F.col("h") > 0)

    def within(eps: float) -> Column:
        out = [F.col(c).between(0, 1) for c in ("x", "y")] if eps < 0.01 else []
        for c, s in (("x", "w"), ("y", "h")):
            out += [F.col(c) - F.col(s) / 2 >= -eps, F.col(c) + F.col(s) / 2 <= 1 + eps]
        return reduce(lambda a, b: a & b, out)

    loose = reduce(lambda a, b: a & b, [F.col(c) <= 1.01 for c in ("x", "y", "w", "h")] + [F.col(c) >= -0.01 for c in ("cls", "x", "y", "w", "h")]) & (F.col("cls") < classes)
    no = lambda c: F.coalesce(c, F.lit(False))
    return boxes.select("*", no(five & whole & sized & within(0.0)).alias("strict"), no(five & whole & sized & within(1e-6)).alias("tight"), no(five & loose).alias("loose"))


def scan_counters(files: DataFrame, key: str, text: str) -> DataFrame:
    """One row: files found, empty, with a broken line, boxes, repeated boxes. A null text is a missing file."""
    lines = validity(box_lines(files, key, text))
    per = lines.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("loose")).alias("bad"), F.count_distinct("cls", "x", "y", "w", "h").alias("kinds"))
    return files.select(key, text).join(per, key, "left").agg(
        F.count_if(F.col(text).isNotNull()).alias("found"),
        F.count_if(F.col(text).isNull()).alias("missing"),
        F.count_if(F.col(text).isNotNull() & (F.coalesce("n", F.lit(0)) == 0)).alias("empty"),
        F.count_if(F.coalesce("bad", F.lit(0)) > 0).alias("corrupt"),
        F.sum(F.coalesce("n", F.lit(0))).alias("boxes"),
        F.sum(F.coalesce(F.col("n") - F.col("bad") - F.least(F.col("kinds"), F.col("n") - F.col("bad")), F.lit(0))).alias("repeated"),
    )


def inventory(records: DataFrame) -> DataFrame:
    """One row per record with plain fields: split, source, digest of the label text, video and frame from the source."""
    once = records.filter("record_id is not null").groupBy("record_id").agg(F.max(F.struct("image", "old_split", "image_sha256", "label_signature", "source_id", "dataset", "instances", "width", "height")).alias("r")).select("record_id", "r.*")
    source = source_name(F.col("source_id"))
    named = once.withColumn("split", usable_split(F.col("old_split"))).withColumn("source", source)
    frame = F.regexp_extract("source", r"^(video\d+)_(\d+)$", 2)
    return named.select("record_id", "image", "split", "source", "dataset", "image_sha256", "label_signature", "instances", "width", "height", F.nullif(F.regexp_extract("source", r"^(video\d+)_\d+$", 1), F.lit("")).alias("video"), F.nullif(frame, F.lit("")).cast("bigint").alias("frame"), F.sha2(F.coalesce("label_signature", F.lit("")), 256).alias("label_sha256"))


def capture_family(source: Column) -> Column:
    """The capture that a plain source name belongs to: a video, a family of frames or of videos, or null."""
    return (
        F.when(source.rlike(r"^video\d+_\d+\z"), F.concat(F.lit("explicit_video:"), F.regexp_extract(source, r"^(video\d+)", 1)))
        .when(source.rlike(r"^frame[_-]?\d+\z"), "implicit_sequence:frame")
        .when(source.rlike(r"^video\d+\z"), "implicit_sequence:video")
    )


def spanning_groups(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Groups of a key that lie in more than one split: ``key, rows, splits``."""
    return rows.filter(F.col(key).isNotNull() & F.col(split).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(split).alias("splits")).filter("splits > 1")


def pairwise_sharing(rows: DataFrame, key: str, label: str, splits: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """Per pair of splits the keys found in both, and of these how many agree on one label within the two.

    First per key (rows and least and greatest label per split, combined on the map side), then per pair.
    """
    per = [f(F.when(F.col("split") == s, F.col(label))).alias(f"{s}_{n}") for s in splits for n, f in (("lo", F.min), ("hi", F.max))]
    have = [F.count_if(F.col("split") == s).alias(f"{s}_n") for s in splits]
    keyed = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*have, *per)
    pairs = []
    for i, a in enumerate(splits):
        for b in splits[i + 1 :]:
            lo, hi = F.least(F.col(f"{a}_lo"), F.col(f"{b}_lo")), F.greatest(F.col(f"{a}_hi"), F.col(f"{b}_hi"))
            pairs.append(F.struct(F.lit(f"{a}-{b}").alias("pair"), ((F.col(f"{a}_n") > 0) & (F.col(f"{b}_n") > 0)).alias("both"), F.coalesce(lo == hi, F.lit(False)).alias("equal")))
    flat = keyed.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter("both")
    return flat.groupBy("pair").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("equal")).alias("labels_equal"), F.count_if(~F.col("equal")).alias("labels_differ"))


def conflicts(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Keys whose copies disagree on the label: ``key, rows, labels``."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(label).alias("labels")).filter("labels > 1")


def without_conflicts(rows: DataFrame, key: str, label: str) -> DataFrame:
    """All copies of a key go if their labels disagree; rows without key stay."""
    return rows.join(conflicts(rows, key, label).select(key), key, "left_anti")


def deduplicated(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The least row of each key by ``order`` (so test before train before valid), by a map-side combined minimum."""
    rest = [c for c in rows.columns if c not in order and c != key]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("r")).select(key, "r.*")


def _mark(edges: DataFrame) -> tuple:
    """Count and two order-free sums of hashes: equal for equal sets of edges."""
    row = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(row.bitwiseAND(0xFFFFFFFF))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its least node) of undirected edges ``a, b``, by alternating large and small stars.

    Each round links every vertex to the least of its neighbours, first among larger, then among smaller ones; the
    number of rounds is logarithmic for usual graphs. Rounds are grouped minima and equi-joins; whether a round changed
    anything is told by a sum of hashes over its result.
    """
    now = settle(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a <> b").distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    mark = _mark(now)
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # every vertex meets the least of its neighbours once, also one that half of all edges end in
        large = settle(lookup(both.filter("b > a"), low, "a", "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        down = large.filter("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = lookup(down, least, "a", "inner")
        now = settle(small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_edges(rows: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """Star edges from each row to the first row that names the same key: never all pairs of a key."""
    each = []
    for k in keys:
        named = rows.filter(F.col(k).isNotNull()).select(F.col(row_id).alias("a"), F.col(k).alias("_key"))
        each.append(lookup(named, named.groupBy("_key").agg(F.min("a").alias("b")), "_key", "inner").select("a", "b"))
    return reduce(DataFrame.unionByName, each).filter("a <> b").distinct()


def hash_split(rows: DataFrame, key: str, shares: dict[str, float]) -> DataFrame:
    """A split by the hash of the key: rows of one key stay together, and shares hold in expectation, not exactly."""
    at = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    names = list(shares)
    out, upper = F.lit(names[-1]), sum(shares.values())
    for name, after in zip(reversed(names[:-1]), reversed(names[1:])):
        upper -= shares[after]
        out = F.when(at < upper, F.lit(name)).otherwise(out)
    return rows.withColumn("split", out)


def frame_gaps(rows: DataFrame) -> DataFrame:
    """Per record with video and frame, the distance to the nearest frame of the same video in another split.

    Two windows carry the last and the next frame of each split along the video: as-of joins in both directions
    without comparing pairs.
    """
    splits = ("train", "valid", "test")
    named = rows.filter("video is not null and frame is not null and split is not null").select("record_id", "video", "frame", "split")
    back = Window.partitionBy("video").orderBy("frame").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("video").orderBy("frame").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    out = named
    for s in splits:
        at = F.when(F.col("split") == s, F.col("frame"))
        out = out.withColumn(f"{s}_gap", F.least(F.col("frame") - F.max(at).over(back), F.min(at).over(ahead) - F.col("frame")))
    other = F.array_min(F.array(*[F.when(F.col("split") != s, F.col(f"{s}_gap")) for s in splits]))
    return out.select("record_id", "video", "frame", "split", other.alias("gap"))


def unusable(rows: DataFrame) -> DataFrame:
    """Reject table: records with the reason why a scan leaves them out."""
    reason = (
        F.when(~usable_signature(F.col("label_signature")), "label")
        .when(F.col("split").isNull(), "split")
        .when(~F.coalesce(F.col("width").between(1, 12000) & F.col("height").between(1, 12000), F.lit(False)), "size")
    )
    return rows.withColumn("error", reason)
