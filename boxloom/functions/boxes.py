"""Box arithmetic as column expressions. A box is four columns; results are tuples of columns in the order told."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def columns(prefix: str = "", names: str = "x1 y1 x2 y2") -> Box:
    """The columns ``<prefix>x1`` and so on."""
    return tuple(F.col(f"{prefix}{n}") for n in names.split())


def corners_to_center(b: Box) -> Box:
    x1, y1, x2, y2 = b
    return (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1


def center_to_corners(b: Box) -> Box:
    x, y, w, h = b
    return x - w / 2, y - h / 2, x + w / 2, y + h / 2


def corners_to_ltwh(b: Box) -> Box:
    x1, y1, x2, y2 = b
    return x1, y1, x2 - x1, y2 - y1


def ltwh_to_corners(b: Box) -> Box:
    x, y, w, h = b
    return x, y, x + w, y + h


def center_to_ltwh(b: Box) -> Box:
    x, y, w, h = b
    return x - w / 2, y - h / 2, w, h


def ltwh_to_center(b: Box) -> Box:
    x, y, w, h = b
    return x + w / 2, y + h / 2, w, h


def unit_to_pixels(b: Box, width: Column, height: Column, pad_x: Column | float = 0.0, pad_y: Column | float = 0.0) -> Box:
    """Centre form in shares of the image -> corners in pixels, shifted by the padding."""
    x, y, w, h = b
    px, py = F.lit(pad_x) if not isinstance(pad_x, Column) else pad_x, F.lit(pad_y) if not isinstance(pad_y, Column) else pad_y
    return width * (x - w / 2) + px, height * (y - h / 2) + py, width * (x + w / 2) + px, height * (y + h / 2) + py


def pixels_to_unit(b: Box, width: Column, height: Column, clip_eps: float | None = None) -> Box:
    """Corners in pixels -> centre form in shares; with ``clip_eps`` clipped to the image less that margin."""
    if clip_eps is not None:
        b = clip(b, width - clip_eps, height - clip_eps)
    x1, y1, x2, y2 = b
    return ((x1 + x2) / 2) / width, ((y1 + y2) / 2) / height, (x2 - x1) / width, (y2 - y1) / height


def clamp(value: Column, top: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(value, top))


def clip(b: Box, width: Column, height: Column) -> Box:
    """Corners clamped to the image."""
    x1, y1, x2, y2 = b
    return clamp(x1, width), clamp(y1, height), clamp(x2, width), clamp(y2, height)


def from_letterbox(b: Box, size: float, width: Column, height: Column) -> Box:
    """Corners on a padded square of side ``size`` -> corners on the image, clipped.

    The scale is the one that fits the longer side; paddings are rounded half to even after taking off 0.1.
    """
    gain = F.least(F.lit(size) / height, F.lit(size) / width)
    pad_x = F.bround((F.lit(size) - F.bround(width * gain)) / 2 - 0.1)
    pad_y = F.bround((F.lit(size) - F.bround(height * gain)) / 2 - 0.1)
    x1, y1, x2, y2 = b
    return clip(((x1 - pad_x) / gain, (y1 - pad_y) / gain, (x2 - pad_x) / gain, (y2 - pad_y) / gain), width, height)


def rotated_corners(x: Column, y: Column, w: Column, h: Column, angle: Column) -> list[tuple[Column, Column]]:
    """The four corners of a box turned by ``angle`` radians."""
    cos, sin = F.cos(angle), F.sin(angle)
    ax, ay, bx, by = w / 2 * cos, w / 2 * sin, -h / 2 * sin, h / 2 * cos
    return [(x + ax + bx, y + ay + by), (x + ax - bx, y + ay - by), (x - ax - bx, y - ay - by), (x - ax + bx, y - ay + by)]


def regular_rotation(w: Column, h: Column, angle: Column) -> tuple[Column, Column, Column]:
    """Width, height and angle of the same box with the angle in [0, pi/2); sides change places for the upper half."""
    turned = F.pmod(angle, F.lit(math.pi))
    upper = turned >= math.pi / 2
    return F.when(upper, h).otherwise(w), F.when(upper, w).otherwise(h), F.pmod(turned, F.lit(math.pi / 2))


def area(b: Box) -> Column:
    x1, y1, x2, y2 = b
    return (x2 - x1) * (y2 - y1)


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box, eps: float = 1e-7) -> Column:
    """Intersection over union of corner boxes."""
    inter = intersection(a, b)
    return inter / (area(a) + area(b) - inter + eps)


def ioa(a: Box, b: Box, eps: float = 1e-7) -> Column:
    """Intersection over the area of ``b``."""
    return intersection(a, b) / (area(b) + eps)


def iou_family(a: Box, b: Box, eps: float = 1e-7) -> dict[str, Column]:
    """``iou``, ``giou``, ``diou`` and ``ciou`` of corner boxes, heights padded against division by zero."""
    w1, h1, w2, h2 = a[2] - a[0], a[3] - a[1] + eps, b[2] - b[0], b[3] - b[1] + eps
    inter = intersection(a, b)
    union = w1 * h1 + w2 * h2 - inter + eps
    plain = inter / union
    hull_w = F.greatest(a[2], b[2]) - F.least(a[0], b[0])
    hull_h = F.greatest(a[3], b[3]) - F.least(a[1], b[1])
    hull = hull_w * hull_h + eps
    diagonal = hull_w * hull_w + hull_h * hull_h + eps
    dx, dy = b[0] + b[2] - a[0] - a[2], b[1] + b[3] - a[1] - a[3]
    apart = (dx * dx + dy * dy) / 4 / diagonal
    slant = F.atan(w2 / h2) - F.atan(w1 / h1)
    v = F.lit(4 / math.pi**2) * slant * slant
    alpha = v / (v - plain + (1 + eps))
    return {"iou": plain, "giou": plain - (hull - union) / hull, "diou": plain - apart, "ciou": plain - (apart + v * alpha)}


def rotated_overlap(a: tuple[Column, ...], b: tuple[Column, ...], eps: float = 1e-7) -> Column:
    """Overlap of two turned boxes (x, y, w, h, angle) as Gaussians: 1 minus their Hellinger distance."""

    def spread(box: tuple[Column, ...]) -> tuple[Column, Column, Column]:
        _, _, w, h, r = box
        p, q, cos, sin = w * w / 12, h * h / 12, F.cos(r), F.sin(r)
        return p * cos * cos + q * sin * sin, p * sin * sin + q * cos * cos, (p - q) * cos * sin

    a1, b1, c1 = spread(a)
    a2, b2, c2 = spread(b)
    dx, dy = a[0] - b[0], a[1] - b[1]
    det = (a1 + a2) * (b1 + b2) - (c1 + c2) * (c1 + c2)
    t1 = ((a1 + a2) * dy * dy + (b1 + b2) * dx * dx) / (det + eps) * 0.25
    t2 = ((c1 + c2) * -dx * dy) / (det + eps) * 0.5
    dets = F.sqrt(F.greatest(a1 * b1 - c1 * c1, F.lit(0.0)) * F.greatest(a2 * b2 - c2 * c2, F.lit(0.0)))
    t3 = F.log(det / (4 * dets + eps) + eps) * 0.5
    distance = F.least(F.greatest(t1 + t2 + t3, F.lit(eps)), F.lit(100.0))
    return 1 - F.sqrt(1 - F.exp(-distance) + eps)


def keypoint_similarity(distance2: Column, sigma: Column, area_: Column, eps: float = 1e-7) -> Column:
    """Similarity of one keypoint: falls with the squared distance, by its sigma and the object's area."""
    return F.exp(-distance2 / ((2 * sigma) * (2 * sigma) * (area_ + eps) * 2))


def smoothed_pair(eps: float = 0.1) -> tuple[Column, Column]:
    """Targets of the own class and of the others when labels are smoothed by ``eps``."""
    return F.lit(1 - eps / 2), F.lit(eps / 2)


def size_name(side: Column) -> Column:
    """``tiny`` below 16 px, ``small`` below 32, ``medium`` below 96, else ``large``."""
    return F.when(side < 16, "tiny").when(side < 32, "small").when(side < 96, "medium").otherwise("large")


def odd_kernel(kernel: Column, width: Column, height: Column) -> Column:
    """A blur kernel for side 640 scaled to the image's longer side: rounded half to even, 3 at least, odd."""
    k = F.greatest(F.lit(3), F.bround(kernel * F.greatest(width, height) / 640).cast("int"))
    return k + F.when(k % 2 == 0, 1).otherwise(0)
