"""Tiles of images and the objects in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.functions import boxes as B
from boxloom.functions import geometry as G


def tiles(images: DataFrame, size: int = 1024, gap: int = 200, least: float = 0.6, eps: float = 0.01) -> DataFrame:
    """``image_id, tx1, ty1, tx2, ty2`` of tiles whose part inside the image is above ``least``.

    Where no tile of an image reaches that, those within ``eps`` of its best one stay.
    """
    cut = images.select("image_id", "width", "height", F.explode(G.tile_starts(F.col("width"), size, size - gap)).alias("tx1"))
    cut = cut.select("*", F.explode(G.tile_starts(F.col("height"), size, size - gap)).alias("ty1"))
    inside = (F.least(F.col("tx1") + size, F.col("width")) - F.col("tx1")) * (F.least(F.col("ty1") + size, F.col("height")) - F.col("ty1"))
    rated = cut.withColumn("rate", inside / (size * size)).withColumn("best", F.max("rate").over(Window.partitionBy("image_id")))
    kept = rated.filter((F.col("rate") > least) | ((F.col("best") <= least) & (F.col("best") - F.col("rate") < eps)))
    whole = lambda c: F.col(c).cast("int").alias(c)
    return kept.select("image_id", whole("tx1"), whole("ty1"), (F.col("tx1") + size).cast("int").alias("tx2"), (F.col("ty1") + size).cast("int").alias("ty2"))


def tile_objects(boxes: DataFrame, tiled: DataFrame, least: float = 0.7) -> DataFrame:
    """Boxes with every tile of their image that holds at least ``least`` of them, in the tile's own coordinates."""
    both = boxes.join(tiled, "image_id")
    tile = tuple(F.col(f"t{c}").cast("double") for c in ("x1", "y1", "x2", "y2"))
    held = B.intersection(tile, B.columns()) / F.greatest(B.area(B.columns()), F.lit(1e-7))
    moved = [(F.col(c) - F.col(f"t{c[0]}1")).alias(c) for c in ("x1", "y1", "x2", "y2")]
    return both.filter(held >= least).select("image_id", "box_no", "tx1", "ty1", *moved)


def untiled(boxes: DataFrame) -> DataFrame:
    """Boxes of tiles back in the coordinates of their image."""
    return boxes.select("image_id", "box_no", *[(F.col(c) + F.col(f"t{c[0]}1")).alias(c) for c in ("x1", "y1", "x2", "y2")])


def snapped(boxes: DataFrame, reach: float = 20.0) -> DataFrame:
    """Corners nearer than ``reach`` to the image's border are moved onto it."""
    low = lambda c: F.when(F.col(c) < reach, 0.0).otherwise(F.col(c)).alias(c)
    high = lambda c, top: F.when(F.col(c) > F.col(top) - reach, F.col(top).cast("double")).otherwise(F.col(c)).alias(c)
    return boxes.select("image_id", "box_no", low("x1"), low("y1"), high("x2", "width"), high("y2", "height"))
