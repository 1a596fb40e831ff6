"""Streaming twins of the operators along tracks: counts per frame as streaming aggregations, events of tracks with state.

Aggregations run in update or complete mode. Events need the order of a track's frames: the rows of a batch are put in
order, and rows at or before the last frame seen come back as kind ``late``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from boxloom.functions import geometry as G

EVENTS = "stream string, track_id bigint, frame_no bigint, kind string, value double"
_COLUMNS = ["stream", "track_id", "frame_no", "kind", "value"]


def region_stream(positions: DataFrame, regions: dict[str, list[G.Point]]) -> DataFrame:
    """Tracks inside per stream, frame and region, for regions that hold any."""
    inside = F.filter(F.array(*[F.when(G.inside(F.col("x"), F.col("y"), pts), F.lit(name)) for name, pts in regions.items()]), lambda r: r.isNotNull())
    return positions.select("stream", "frame_no", F.explode(inside).alias("region")).groupBy("stream", "frame_no", "region").agg(F.count(F.lit(1)).alias("n"))


def heat_stream(positions: DataFrame, radius: int, cell: int = 1) -> DataFrame:
    """``stream, cx, cy, heat`` over all frames so far: two per object and cell within ``radius`` cells."""
    around = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    place = lambda c: F.floor(F.col(c) / cell)
    cells = F.array(*[F.struct((place("x") + dx).alias("cx"), (place("y") + dy).alias("cy")) for dx, dy in around])
    return positions.select("stream", F.explode(cells).alias("c")).groupBy("stream", "c.cx", "c.cy").agg((2 * F.count(F.lit(1))).alias("heat"))


def _inside(x: np.ndarray, y: np.ndarray, polygon: list[G.Point]) -> np.ndarray:
    odd, border = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        border |= (cross == 0) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
        if ay != by:
            odd ^= ((ay > y) != (by > y)) & (x < (y - ay) * ((bx - ax) / (by - ay)) + ax)
    return odd & ~border


class TrackEvents(StatefulProcessor):
    """Events of a track: ``entry`` (1 in, -1 out, once), ``waiting`` (each frame inside with an earlier position), ``speed`` (km/h, once) and ``turn`` (turns so far)."""

    def __init__(self, polygon: list[G.Point], low: float, high: float, fps: float = 30.0, metres_per_pixel: float = 0.05, hold: int = 5, top: int = 120) -> None:
        self.polygon, self.low, self.high, self.fps, self.scale, self.hold, self.top = polygon, low, high, fps, metres_per_pixel, hold, top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("track", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = json.loads(self.state.get()[0]) if self.state.exists() else {"n": 0, "first": None, "last": None, "entered": False, "level": 0, "turns": 0}
        pdf = pd.concat(list(rows)).sort_values("frame_no")
        late = pdf["frame_no"] <= was["last"][0] if was["last"] else pd.Series(False, index=pdf.index)
        out = [(int(f), "late", None) for f in pdf["frame_no"][late]]
        pdf = pdf[~late]
        if len(pdf):
            frame, x, y = (pdf[c].to_numpy() for c in ("frame_no", "x", "y"))
            before = was["last"] or [0, np.nan, np.nan]
            px, py = np.concatenate([[before[1]], x[:-1]]), np.concatenate([[before[2]], y[:-1]])
            here = _inside(x, y, self.polygon) & ~np.isnan(px)
            out += [(int(f), "waiting", 1.0) for f in frame[here]]
            if here.any() and not was["entered"]:
                xs, ys = zip(*self.polygon)
                i = int(here.argmax())
                inward = x[i] > px[i] if max(xs) - min(xs) < max(ys) - min(ys) else y[i] > py[i]
                out.append((int(frame[i]), "entry", 1.0 if inward else -1.0))
                was["entered"] = True
            first = was["first"] or [int(frame[0]), float(x[0]), float(y[0])]
            at = self.hold - 1 - was["n"]
            if 0 <= at < len(frame) and frame[at] > first[0]:
                way = float(np.hypot(x[at] - first[1], y[at] - first[2])) * self.scale
                out.append((int(frame[at]), "speed", float(min(np.floor(way / ((frame[at] - first[0]) / self.fps) * 3.6), self.top))))
            # the level holds until a signal changes it, and a turn is a change from up to down
            signal = pd.Series(np.where(x > self.high, 1.0, np.where(x < self.low, -1.0, np.nan)))
            level = signal.ffill().fillna(was["level"]).to_numpy()
            turned = (level == -1) & (np.concatenate([[was["level"]], level[:-1]]) == 1)
            out += [(int(f), "turn", float(n)) for f, n in zip(frame[turned], was["turns"] + np.arange(1, turned.sum() + 1))]
            was |= {"n": was["n"] + len(frame), "first": first, "last": [int(frame[-1]), float(x[-1]), float(y[-1])], "level": float(level[-1]), "turns": was["turns"] + int(turned.sum())}
            self.state.update((json.dumps(was),))
        yield pd.DataFrame([(key[0], int(key[1]), *e) for e in out], columns=_COLUMNS).astype({"value": "float64"})

    def close(self) -> None:
        pass


class Alarm(StatefulProcessor):
    """The first frame of a stream with at least ``least`` objects; state is the count of the frame still open and whether it rang."""

    def __init__(self, least: int) -> None:
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alarm", "frame bigint, n bigint, rung boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame, n, rung = self.state.get() if self.state.exists() else (None, 0, False)
        counts = pd.concat(list(rows))["frame_no"].value_counts().sort_index()
        if frame is not None:
            counts = counts.add(pd.Series({frame: n}), fill_value=0).sort_index()
        loud = counts[counts >= self.least]
        self.state.update((int(counts.index[-1]), int(counts.iloc[-1]), bool(rung or len(loud))))
        yield pd.DataFrame([(key[0], int(loud.index[0]))] if len(loud) and not rung else [], columns=["stream", "frame_no"]).astype({"stream": "object", "frame_no": "int64"})

    def close(self) -> None:
        pass


def event_stream(positions: DataFrame, processor: TrackEvents) -> DataFrame:
    """Events of all tracks of a stream of positions."""
    return positions.groupBy("stream", "track_id").transformWithStateInPandas(processor, EVENTS, "Append", "None")


def alarm_stream(positions: DataFrame, least: int = 5) -> DataFrame:
    """First alarms of a stream of positions."""
    return positions.groupBy("stream").transformWithStateInPandas(Alarm(least), "stream string, frame_no bigint", "Append", "None")
