"""Truth and prediction boxes as tables: one row per box, corners in pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions import boxes as B
from boxloom.functions.labels import label_lines, usable_signature


def truth_boxes(records: DataFrame) -> DataFrame:
    """``image_id, box_no, cls, x1, y1, x2, y2, width, height`` from records with a usable signature and a real size.

    A record delivered again counts once; the largest (signature, width, height) stands for it. ``box_no`` counts
    the lines from 1.
    """
    once = records.filter("record_id is not null").groupBy("record_id").agg(F.max(F.struct("label_signature", "width", "height")).alias("r")).select("record_id", "r.*")
    good = once.filter(usable_signature(F.col("label_signature")) & F.col("width").between(1, 12000) & F.col("height").between(1, 12000))
    lines = good.select(F.col("record_id").cast("string").alias("image_id"), "width", "height", F.posexplode(label_lines(F.col("label_signature"))).alias("i", "line"))
    part = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    number = lambda k: F.element_at(part, k).cast("double")
    flat = lines.select("image_id", (F.col("i") + 1).alias("box_no"), number(1).cast("int").alias("cls"), "width", "height", *[number(k + 2).alias(n) for k, n in enumerate("xywh")])
    corners = B.unit_to_pixels(B.columns("", "x y w h"), F.col("width").cast("double"), F.col("height").cast("double"))
    return flat.select("image_id", "box_no", "cls", *[c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"))], "width", "height")


def predicted_boxes(detections: DataFrame) -> DataFrame:
    """``run_id, image_id, cls, score, x1, y1, x2, y2``: repeated rows once, rows without score or four numbers left out."""
    whole = detections.filter("score is not null and image_id is not null and size(bbox) = 4 and not exists(bbox, v -> v is null)").distinct()
    box = [F.element_at("bbox", i) for i in range(1, 5)]
    return whole.select("run_id", "image_id", F.col("category_id").alias("cls"), "score", *[c.alias(n) for c, n in zip(B.ltwh_to_corners(tuple(box)), ("x1", "y1", "x2", "y2"))])


def coco_records(predictions: DataFrame, class_map: dict[int, int] | None = None) -> DataFrame:
    """Prediction rows in the interchange form ``image_id, category_id, bbox, score``: left-top form, 3 and 5 digits."""
    x, y, w, h = B.corners_to_ltwh(B.columns())
    cls = F.col("cls") if not class_map else F.element_at(F.create_map(*[F.lit(v) for kv in class_map.items() for v in kv]), F.col("cls"))
    return predictions.select("image_id", cls.alias("category_id"), F.array(*[F.round(v, 3) for v in (x, y, w, h)]).alias("bbox"), F.round("score", 5).alias("score"))
