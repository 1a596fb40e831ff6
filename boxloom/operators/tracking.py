"""Multi-object tracking: a constant-velocity Kalman filter and two-stage association by overlap.

A tracker is a small state per stream that is fed one frame at a time, in order. Frames without boxes between the
first and the last one of a stream are steps too: motion goes on, and tracks get lost and end. In batch a stream's frames
run through the tracker batch by batch in their order, so a task holds a batch of rows and the state of one stream; in a
stream the state lives in the state store (see ``boxloom.streaming.trackers``). Track numbers count per stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from boxloom.operators.matching import _iou_matrix, assign

TRACKED = "stream string, frame_no bigint, track_id bigint, x1 double, y1 double, x2 double, y2 double, score double, cls int"

# Relative noise of position and of velocity.
POSITION, VELOCITY = 1 / 20, 1 / 160


@dataclass
class Limits:
    """Fixed values of the association: score limits, cost limits, and frames after which a lost track ends."""

    high: float = 0.25
    low: float = 0.1
    new: float = 0.25
    first: float = 0.8
    second: float = 0.5
    unconfirmed: float = 0.7
    duplicate: float = 0.15
    buffer: int = 30


class Motion:
    """Filter over centre, aspect and height with their velocities."""

    move = np.eye(8) + np.eye(8, k=4)
    see = np.eye(4, 8)

    @staticmethod
    def _noise(h: float, rates: tuple[float, float, float, float]) -> np.ndarray:
        return np.array([rates[0] * h, rates[1] * h, rates[2], rates[3] * h])

    @classmethod
    def start(cls, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, v = cls._noise(z[3], (2 * POSITION, 2 * POSITION, 1e-2, 2 * POSITION)), cls._noise(z[3], (10 * VELOCITY, 10 * VELOCITY, 1e-5, 10 * VELOCITY))
        return np.concatenate([z, np.zeros(4)]), np.diag(np.concatenate([p, v]) ** 2)

    @classmethod
    def predict(cls, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, v = cls._noise(mean[3], (POSITION, POSITION, 1e-2, POSITION)), cls._noise(mean[3], (VELOCITY, VELOCITY, 1e-5, VELOCITY))
        return cls.move @ mean, cls.move @ cov @ cls.move.T + np.diag(np.concatenate([p, v]) ** 2)

    @classmethod
    def project(cls, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = cls._noise(mean[3], (POSITION, POSITION, 1e-1, POSITION))
        return cls.see @ mean, cls.see @ cov @ cls.see.T + np.diag(r**2)

    @classmethod
    def update(cls, mean: np.ndarray, cov: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        zm, s = cls.project(mean, cov)
        gain = np.linalg.solve(s, cls.see @ cov).T
        return mean + gain @ (z - zm), cov - gain @ s @ gain.T

    @classmethod
    def distance(cls, mean: np.ndarray, cov: np.ndarray, z: np.ndarray) -> float:
        """Squared Mahalanobis distance of a measurement."""
        zm, s = cls.project(mean, cov)
        d = z - zm
        return float(d @ np.linalg.solve(s, d))


def to_measure(b: np.ndarray) -> np.ndarray:
    """Corners as centre, aspect and height."""
    w, h = b[2] - b[0], b[3] - b[1]
    return np.array([b[0] + w / 2, b[1] + h / 2, w / max(h, 1e-9), h])


def to_corners(m: np.ndarray) -> np.ndarray:
    w = m[2] * m[3]
    return np.array([m[0] - w / 2, m[1] - m[3] / 2, m[0] + w / 2, m[1] + m[3] / 2])


@dataclass
class Track:
    """State of one track. ``kind`` is ``new`` (seen once), ``tracked`` or ``lost``."""

    track_id: int
    mean: list[float]
    cov: list[float]
    score: float
    cls: int
    began: int
    seen: int
    kind: str = "tracked"
    appearance: list[float] = field(default_factory=list)

    def box(self) -> np.ndarray:
        return to_corners(np.array(self.mean[:4]))

    def predict(self) -> None:
        mean = np.array(self.mean)
        if self.kind != "tracked":
            mean[7] = 0.0
        mean, cov = Motion.predict(mean, np.array(self.cov).reshape(8, 8))
        self.mean, self.cov = mean.tolist(), cov.ravel().tolist()

    def take(self, row: dict, frame: int, appearance: np.ndarray | None = None) -> None:
        mean, cov = Motion.update(np.array(self.mean), np.array(self.cov).reshape(8, 8), to_measure(row["box"]))
        self.mean, self.cov, self.score, self.cls, self.seen, self.kind = mean.tolist(), cov.ravel().tolist(), row["score"], row["cls"], frame, "tracked"
        if appearance is not None:
            self.appearance = blend(np.array(self.appearance), appearance).tolist()


def blend(old: np.ndarray, new: np.ndarray, keep: float = 0.9) -> np.ndarray:
    """Running mean of unit appearance vectors, of unit length again."""
    new = new / max(np.linalg.norm(new), 1e-12)
    mixed = keep * old + (1 - keep) * new if len(old) else new
    return mixed / max(np.linalg.norm(mixed), 1e-12)


def appearance_cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine distances, never below 0."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return np.maximum(0.0, 1 - unit(a) @ unit(b).T)


def gated_cost(overlap: np.ndarray, appearance: np.ndarray, near: float = 0.5, alike: float = 0.25) -> np.ndarray:
    """The lesser of overlap cost and half the appearance cost, where appearance counts only if near and alike."""
    half = appearance / 2
    return np.minimum(overlap, np.where((half > alike) | (overlap > near), 1.0, half))


class Tracker:
    """All tracks of a stream; ``step`` takes the boxes of one frame and gives those that belong to a track."""

    def __init__(self, limits: Limits | None = None) -> None:
        self.limits, self.tracks, self.last, self.frame = limits or Limits(), [], 0, None

    def dump(self) -> dict:
        return {"last": self.last, "frame": self.frame, "tracks": [vars(t) for t in self.tracks]}

    @classmethod
    def load(cls, state: dict, limits: Limits | None = None) -> Tracker:
        out = cls(limits)
        out.last, out.frame, out.tracks = state["last"], state["frame"], [Track(**t) for t in state["tracks"]]
        return out

    def advance(self, frame: int, rows: list[dict]) -> list[tuple[Track, dict]]:
        """Steps over the empty frames since the last one, as long as there are tracks that they could change, and then ``frame``."""
        empty = frame if self.frame is None else self.frame + 1
        while empty < frame and self.tracks:
            self.step(empty, [])
            empty += 1
        return self.step(frame, rows)

    def _cost(self, tracks: list[Track], rows: list[dict], fuse: bool) -> np.ndarray:
        if not tracks or not rows:
            return np.zeros((len(tracks), len(rows)))
        cost = 1 - _iou_matrix(np.array([t.box() for t in tracks]), np.array([r["box"] for r in rows]))
        return 1 - (1 - cost) * np.array([r["score"] for r in rows]) if fuse else cost

    def step(self, frame: int, rows: list[dict]) -> list[tuple[Track, dict]]:
        at, first = self.limits, self.frame is None
        self.frame = frame
        strong = [r for r in rows if r["score"] >= at.high]
        weak = [r for r in rows if at.low < r["score"] < at.high]
        confirmed = [t for t in self.tracks if t.kind != "new"]
        fresh = [t for t in self.tracks if t.kind == "new"]
        for t in confirmed:
            t.predict()
        out: list[tuple[Track, dict]] = []

        def match(tracks: list[Track], rows: list[dict], limit: float, fuse: bool) -> tuple[list[Track], list[dict]]:
            pairs = assign(self._cost(tracks, rows, fuse), limit) if tracks and rows else []
            for i, j in pairs:
                tracks[i].take(rows[j], frame)
                out.append((tracks[i], rows[j]))
            used_t, used_r = {i for i, _ in pairs}, {j for _, j in pairs}
            return [t for i, t in enumerate(tracks) if i not in used_t], [r for j, r in enumerate(rows) if j not in used_r]

        left, strong = match(confirmed, strong, at.first, True)
        # weak boxes only continue tracks that were not lost before
        missed, _ = match([t for t in left if t.kind == "tracked"], weak, at.second, False)
        for t in missed:
            t.kind = "lost"
        ended, strong = match(fresh, strong, at.unconfirmed, True)
        gone = {id(t) for t in ended}
        for r in strong:
            if r["score"] >= at.new:
                self.last += 1
                mean, cov = Motion.start(to_measure(r["box"]))
                # at a stream's first step a track counts at once
                t = Track(self.last, mean.tolist(), cov.ravel().tolist(), r["score"], r["cls"], frame, frame, "tracked" if first else "new")
                self.tracks.append(t)
                if first:
                    out.append((t, r))
        self.tracks = [t for t in self.tracks if id(t) not in gone and not (t.kind == "lost" and frame - t.seen > at.buffer)]
        self._drop_doubles()
        alive = {id(t) for t in self.tracks}
        return [(t, r) for t, r in out if id(t) in alive]

    def _drop_doubles(self) -> None:
        """Of a tracked and a lost track at the same place the one that lived longer stays; of equals the lost one."""
        a = [t for t in self.tracks if t.kind == "tracked"]
        b = [t for t in self.tracks if t.kind == "lost"]
        if not a or not b:
            return
        cost = 1 - _iou_matrix(np.array([t.box() for t in a]), np.array([t.box() for t in b]))
        drop = set()
        for i, j in zip(*np.nonzero(cost < self.limits.duplicate)):
            longer = a[i].seen - a[i].began > b[j].seen - b[j].began
            drop.add(id(b[j]) if longer else id(a[i]))
        self.tracks = [t for t in self.tracks if id(t) not in drop]


_COLUMNS = ["stream", "frame_no", "track_id", "x1", "y1", "x2", "y2", "score", "cls"]


def track_frames(tracker: Tracker, pdf: pd.DataFrame) -> pd.DataFrame:
    """Feeds whole frames of one stream, in order, and gives the tracked boxes."""
    out = []
    for frame, rows in pdf.sort_values(["frame_no", "x1", "y1"]).groupby("frame_no", sort=True):
        boxes = [{"box": np.array([r.x1, r.y1, r.x2, r.y2]), "score": float(r.score), "cls": int(r.cls)} for r in rows.itertuples()]
        for t, r in tracker.advance(int(frame), boxes):
            x1, y1, x2, y2 = t.box()
            out.append((pdf["stream"].iloc[0], int(frame), t.track_id, x1, y1, x2, y2, r["score"], r["cls"]))
    return pd.DataFrame(out, columns=_COLUMNS)


def track_sorted(batches: Iterator[pd.DataFrame], limits: Limits | None = None) -> Iterator[pd.DataFrame]:
    """Tracks rows that come in batches sorted by stream and frame; a frame cut by the end of a batch waits for the next one."""
    tracker, stream, held = Tracker(limits), None, None

    def feed(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        nonlocal tracker, stream
        for name, of_stream in rows.groupby("stream", sort=True):
            if name != stream:
                tracker, stream = Tracker(limits), name
            yield track_frames(tracker, of_stream)

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        open_ = (rows["stream"] == rows["stream"].iloc[-1]) & (rows["frame_no"] == rows["frame_no"].iloc[-1])
        held = rows[open_]
        yield from feed(rows[~open_])
    if held is not None:
        yield from feed(held)


def track(boxes: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Tracked boxes of ``stream, frame_no, x1, y1, x2, y2, score, cls``; a stream is one task's work, as its order is inherent. Rows without stream or frame take no part."""
    usable = boxes.filter("stream is not null and frame_no is not null").select("stream", "frame_no", "x1", "y1", "x2", "y2", "score", "cls")
    in_order = usable.repartition("stream").sortWithinPartitions("stream", "frame_no", "x1", "y1")
    return in_order.mapInPandas(lambda batches: track_sorted(batches, limits), TRACKED)
