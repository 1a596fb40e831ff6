"""Polygons and masks as arrays, for Arrow functions over single objects."""

from __future__ import annotations

import numpy as np


def area(points: np.ndarray) -> float:
    """Area of a polygon from its corners in order."""
    if len(points) < 3:
        return 0.0
    x, y = points[:, 0], points[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def clipped(points: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part of a polygon inside a box, cut by one side of the box after the other."""
    out = np.asarray(points, float)
    for axis, bound, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        if not len(out):
            break
        depth = sign * (out[:, axis] - bound)
        kept = []
        for i in range(len(out)):
            a, b, da, db = out[i - 1], out[i], depth[i - 1], depth[i]
            if (da < 0) != (db < 0):
                kept.append(a + (b - a) * (da / (da - db)))
            if db >= 0:
                kept.append(b)
        out = np.array(kept).reshape(-1, 2)
    return out


def share_inside(points: np.ndarray, box: tuple[float, float, float, float], eps: float = 1e-7) -> float:
    """Area of a polygon inside a box over its whole area."""
    return area(clipped(points, box)) / max(area(np.asarray(points, float)), eps)


def resampled(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` points along a closed polygon at even steps of its corner numbers, linear between corners."""
    ring = np.concatenate([points, points[:1]])
    at = np.linspace(0, len(ring) - 1, n - len(points) if len(points) < n else n)
    at = np.sort(np.concatenate([at, np.arange(len(points))])) if len(points) < n else at
    return np.stack([np.interp(at, np.arange(len(ring)), ring[:, k]) for k in (0, 1)], 1)


def joined(segments: list[np.ndarray]) -> np.ndarray:
    """Several polygons as one, from each to the next and back over the shortest bridge between their corners."""
    out = np.asarray(segments[0], float)
    for other in segments[1:]:
        other = np.asarray(other, float)
        d = ((out[:, None] - other[None]) ** 2).sum(2)
        i, j = np.unravel_index(int(d.argmin()), d.shape)
        loop = np.roll(other, -j, axis=0)
        out = np.concatenate([out[: i + 1], loop, loop[:1], out[i:]])
    return out


def _hull(points: np.ndarray) -> np.ndarray:
    pts = sorted(map(tuple, points))
    if len(set(pts)) < 3:
        return np.array(sorted(set(pts)))

    def half(seq: list) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def least_rectangle(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """Centre, sides and angle of the smallest turned rectangle around points: one side lies on the hull."""
    hull = _hull(np.asarray(points, float))
    if len(hull) == 1:
        return float(hull[0][0]), float(hull[0][1]), 0.0, 0.0, 0.0
    edges = np.diff(np.concatenate([hull, hull[:1]]), axis=0)
    best = None
    for angle in np.arctan2(edges[:, 1], edges[:, 0]):
        c, s = np.cos(angle), np.sin(angle)
        turned = hull @ np.array([[c, -s], [s, c]])
        lo, hi = turned.min(0), turned.max(0)
        w, h = hi - lo
        if best is None or w * h < best[0] - 1e-12:
            mid = (lo + hi) / 2 @ np.array([[c, s], [-s, c]])
            best = (w * h, (float(mid[0]), float(mid[1]), float(w), float(h), float(angle)))
    return best[1]


def mask_box(mask: np.ndarray) -> tuple[int, int, int, int]:
    """First and last column and row of a mask (x1, y1, x2, y2); zeros for an empty one."""
    ys, xs = np.nonzero(mask)
    return (int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max())) if len(xs) else (0, 0, 0, 0)


def mask_overlaps(a: np.ndarray, b: np.ndarray, eps: float = 1e-7) -> np.ndarray:
    """Overlap of every mask of ``a`` with every one of ``b`` (rows are masks) by one product of matrices."""
    a, b = a.reshape(len(a), -1).astype(float), b.reshape(len(b), -1).astype(float)
    inter = a @ b.T
    return inter / (a.sum(1)[:, None] + b.sum(1)[None] - inter + eps)


def regions(mask: np.ndarray) -> np.ndarray:
    """Labels 1, 2, ... of the 8-connected regions of a mask, in reading order of their first cell."""
    out = np.zeros(mask.shape, int)
    n = 0
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x]:
            continue
        n += 1
        stack = [(int(y), int(x))]
        out[y, x] = n
        while stack:
            a, b = stack.pop()
            for i in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                for j in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                    if mask[i, j] and not out[i, j]:
                        out[i, j] = n
                        stack.append((i, j))
    return out


def without_small(mask: np.ndarray, least: int, holes: bool) -> tuple[np.ndarray, bool]:
    """A mask without islands (or, filled, without holes) of fewer than ``least`` cells, and whether it changed.

    If all islands are small the largest one stays.
    """
    work = regions(~mask if holes else mask)
    sizes = np.bincount(work.ravel())[1:]
    small = [i + 1 for i, n in enumerate(sizes) if n < least]
    if not small:
        return mask, False
    if holes:
        return mask | np.isin(work, small), True
    if len(small) == len(sizes):
        small.remove(int(sizes.argmax()) + 1)
    return mask & ~np.isin(work, small), True
