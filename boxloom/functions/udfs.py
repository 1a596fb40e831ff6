"""Functions and a table function for SQL text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from boxloom.functions import polygons as P


def _polygon_area(points: pd.Series) -> pd.Series:
    import numpy as np

    return points.map(lambda p: P.area(np.array([[q["x"], q["y"]] for q in p])) if p is not None else None)


class Tiles:
    """Tiles of an image: one call, many rows."""

    def eval(self, width: int, height: int, size: int, gap: int):
        def starts(length: int) -> list[int]:
            if length <= size:
                return [0]
            step = size - gap
            at = [i * step for i in range(-(-(length - size) // step) + 1)]
            return [min(a, length - size) for a in at]

        for x in starts(width):
            for y in starts(height):
                yield x, y


def register(spark: SparkSession) -> None:
    """Makes ``polygon_area(points)``, ``box_iou(a, b)`` and the table function ``image_tiles(width, height, size, gap)`` known to SQL."""
    spark.udf.register("polygon_area", F.pandas_udf(_polygon_area, DoubleType()))
    spark.udtf.register("image_tiles", F.udtf(Tiles, returnType="x int, y int"))
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION box_iou(ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE) RETURNS DOUBLE
        RETURN (greatest(least(ax2, bx2) - greatest(ax1, bx1), 0D) * greatest(least(ay2, by2) - greatest(ay1, by1), 0D))
          / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - greatest(least(ax2, bx2) - greatest(ax1, bx1), 0D) * greatest(least(ay2, by2) - greatest(ay1, by1), 0D) + 1e-7D)"""
    )


def chain(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Several table functions as one, in order."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run
