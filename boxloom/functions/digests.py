"""Digests and measures of decoded pictures, given as bytes or as rows of grey values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel_hash(width: Column, height: Column, pixels: Column) -> Column:
    """SHA-256 of ``<width>x<height>:`` and the pixel bytes, in hex; null if any of them is."""
    head = F.encode(F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit(":")), "UTF-8")
    return F.sha2(F.concat(head, pixels), 256)


def _inner(width: int, height: int) -> Column:
    """Places of the cells that have neighbours on all sides, counted from 0 row by row."""
    return F.array(*[F.lit(y * width + x) for y in range(1, height - 1) for x in range(1, width - 1)])


def sharpness(cells: Column, width: int, height: int) -> tuple[Column, Column]:
    """(population variance of the Laplacian, mean squared Sobel gradient) over the inner cells of a grey picture; null without inner cells."""
    at = lambda i, dx, dy: F.get(cells, i + (dy * width + dx))
    weights = ((-1, 1), (0, 2), (1, 1))
    laplace = lambda i: at(i, 0, -1) + at(i, 0, 1) + at(i, -1, 0) + at(i, 1, 0) - 4 * at(i, 0, 0)
    across = lambda i: sum((w * (at(i, 1, k) - at(i, -1, k)) for k, w in weights), F.lit(0))
    down = lambda i: sum((w * (at(i, k, 1) - at(i, k, -1)) for k, w in weights), F.lit(0))
    places = _inner(width, height)
    mean = lambda v: F.try_divide(F.aggregate(v, F.lit(0.0), lambda n, x: n + x), F.size(v))
    values = F.transform(places, lambda i: laplace(i).cast("double"))
    squares = F.transform(places, lambda i: (laplace(i) * laplace(i)).cast("double"))
    variance = mean(squares) - mean(values) * mean(values)
    return variance, mean(F.transform(places, lambda i: (across(i) * across(i) + down(i) * down(i)).cast("double")))
