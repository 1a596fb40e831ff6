"""Counting, regions, queues, speeds and states along tracks: one row per track and frame, ordered by ``frame_no``.

``positions`` tables have ``stream, track_id, frame_no, x, y, cls``. Windows run along single tracks; what is
counted per frame or region is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.functions import geometry as G

TRACK = ["stream", "track_id"]


def _along() -> Window:
    return Window.partitionBy(*TRACK).orderBy("frame_no")


def with_previous(positions: DataFrame) -> DataFrame:
    """``px, py``: where the track was one frame before."""
    return positions.withColumn("px", F.lag("x").over(_along())).withColumn("py", F.lag("y").over(_along()))


def count_crossings(positions: DataFrame, line: tuple[G.Point, G.Point]) -> DataFrame:
    """Each track that crosses the line, once ever, at its first crossing: ``stream, track_id, frame_no, cls, direction``.

    A line higher than wide counts left to right as in, one wider than high counts downwards as in.
    """
    (ax, ay), (bx, by) = line
    moved = with_previous(positions).filter("px is not null")
    hit = moved.filter(G.crosses(F.col("px"), F.col("py"), F.col("x"), F.col("y"), *line))
    tall = abs(ax - bx) < abs(ay - by)
    inward = F.col("x") > F.col("px") if tall else F.col("y") > F.col("py")
    return _first(hit, F.when(inward, "in").otherwise("out"))


def count_entries(positions: DataFrame, polygon: list[G.Point]) -> DataFrame:
    """Each track with an earlier position that is inside the polygon, once ever, also if it began inside.

    A region higher than wide counts movement to the right as in, another one movement downwards.
    """
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    hit = with_previous(positions).filter("px is not null").filter(G.inside(F.col("x"), F.col("y"), polygon))
    inward = F.col("x") > F.col("px") if max(xs) - min(xs) < max(ys) - min(ys) else F.col("y") > F.col("py")
    return _first(hit, F.when(inward, "in").otherwise("out"))


def _first(hits: DataFrame, direction: Column) -> DataFrame:
    return hits.withColumn("direction", direction).groupBy(*TRACK).agg(F.min(F.struct("frame_no", "cls", "direction")).alias("m")).select(*TRACK, "m.*")


def region_counts(positions: DataFrame, regions: dict[str, list[G.Point]]) -> DataFrame:
    """``stream, frame_no, region, n``: tracks inside per frame, where a region that empties keeps its last count.

    Regions are a stated list, so each row tests them in one expression; nothing is joined.
    """
    inside = F.filter(F.array(*[F.when(G.inside(F.col("x"), F.col("y"), pts), F.lit(name)) for name, pts in regions.items()]), lambda r: r.isNotNull())
    counted = positions.select("stream", "frame_no", F.explode(inside).alias("region")).groupBy("stream", "frame_no", "region").agg(F.count(F.lit(1)).alias("n"))
    frames = positions.select("stream", "frame_no").distinct().withColumn("region", F.explode(F.array(*[F.lit(r) for r in regions])))
    w = Window.partitionBy("stream", "region").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = frames.join(counted, ["stream", "frame_no", "region"], "left")
    return both.withColumn("n", F.coalesce(F.last("n", ignorenulls=True).over(w), F.lit(0)))


def queue_lengths(positions: DataFrame, polygon: list[G.Point]) -> DataFrame:
    """Tracks inside per frame that have an earlier position; frames without any count 0."""
    here = F.col("px").isNotNull() & G.inside(F.col("x"), F.col("y"), polygon)
    return with_previous(positions).groupBy("stream", "frame_no").agg(F.count_if(here).alias("n"))


def occupancy(positions: DataFrame, slots: dict[str, list[G.Point]]) -> DataFrame:
    """Per frame how many slots hold a centre inside or on their border, and how many are free."""
    held = F.array_distinct(F.flatten(F.collect_set(F.filter(F.array(*[F.when(G.covers(F.col("x"), F.col("y"), pts), F.lit(name)) for name, pts in slots.items()]), lambda r: r.isNotNull()))))
    return positions.groupBy("stream", "frame_no").agg(F.size(held).alias("occupied")).withColumn("free", F.lit(len(slots)) - F.col("occupied"))


def heat(positions: DataFrame, radius: int, cell: int = 1) -> DataFrame:
    """``stream, cx, cy, heat``: two per object and cell within ``radius`` cells of its centre, over all frames."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    at = positions.select("stream", F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    # objects on one cell are added up before they spread
    packed = at.groupBy("stream", "gx", "gy").agg(F.count(F.lit(1)).alias("k"))
    spread = packed.withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span)).filter(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= radius * radius)
    return spread.groupBy("stream", (F.col("gx") + F.col("dx")).alias("cx"), (F.col("gy") + F.col("dy")).alias("cy")).agg(F.sum(2 * F.col("k")).alias("heat"))


def class_counts(positions: DataFrame, every: int = 30, most: int = 45) -> DataFrame:
    """Counts per class of every ``every``-th frame, the last ``most`` such frames of each stream."""
    counted = positions.filter(F.col("frame_no") % every == 0).groupBy("stream", "frame_no", "cls").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("stream").orderBy(F.desc("frame_no"))
    return counted.withColumn("back", F.dense_rank().over(w)).filter(F.col("back") <= most).drop("back")


def alarms(positions: DataFrame, least: int = 5) -> DataFrame:
    """The first frame of each stream with at least ``least`` objects."""
    per = positions.groupBy("stream", "frame_no").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return per.groupBy("stream").agg(F.min("frame_no").alias("frame_no"))


def history(positions: DataFrame, most: int = 30) -> DataFrame:
    """``points`` and ``length``: the last ``most`` centres of a track up to each frame."""
    w = _along().rowsBetween(-(most - 1), Window.currentRow)
    return positions.withColumn("points", F.collect_list(F.struct("x", "y")).over(w)).withColumn("length", F.size("points"))


def speeds(positions: DataFrame, fps: float = 30.0, metres_per_pixel: float = 0.05, hold: int = 5, top: int = 120) -> DataFrame:
    """Speed in km/h from a track's first and ``hold``-th position, gaps included, whole numbers up to ``top``; fixed from then on."""
    w = _along()
    numbered = positions.withColumn("k", F.row_number().over(w))
    ends = numbered.filter(F.col("k").isin(1, hold)).groupBy(*TRACK).agg(F.min(F.struct("k", "frame_no", "x", "y")).alias("a"), F.max(F.struct("k", "frame_no", "x", "y")).alias("b"))
    both = ends.filter(F.col("b.k") == hold)
    way = F.sqrt(F.pow(F.col("b.x") - F.col("a.x"), 2) + F.pow(F.col("b.y") - F.col("a.y"), 2)) * metres_per_pixel
    time = (F.col("b.frame_no") - F.col("a.frame_no")) / fps
    return both.select(*TRACK, F.col("b.frame_no").alias("fixed_at"), F.least(F.floor(F.try_divide(way, time) * 3.6), F.lit(top)).cast("int").alias("kmh"))


def repetitions(values: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Hysteresis: ``up`` above ``high``, ``down`` below ``low``, else as before; ``count`` are the changes from up to down so far."""
    w = _along()
    seen = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    signal = F.when(F.col(value) > high, 1).when(F.col(value) < low, -1)
    held = values.withColumn("state", F.last(signal, ignorenulls=True).over(seen))
    turned = held.withColumn("turn", F.when((F.col("state") == -1) & (F.lag("state").over(w) == 1), 1).otherwise(0))
    return turned.withColumn("count", F.sum("turn").over(seen)).withColumn("state", F.when(F.col("state") == 1, "up").when(F.col("state") == -1, "down")).drop("turn")


def changed_lines(lines: DataFrame, keys: list[str], text: str, time: str, seconds: float = 0.1) -> DataFrame:
    """Without lines that repeat the one before within ``seconds``."""
    w = Window.partitionBy(*keys).orderBy(time, text)
    same = (F.lag(text).over(w) == F.col(text)) & (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp")) <= int(seconds * 1e6))
    return lines.withColumn("_same", F.coalesce(same, F.lit(False))).filter("not _same").drop("_same")


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values along an order: ``keys, run, value, length`` (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("length"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, by a map-side combined maximum."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("m")).select(*keys, "m.*")


def union_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; of a key in both the first table's row."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))
