"""Stateful stream operators: trackers and crossing counters with their state in the state store."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from boxloom.operators.tracking import _COLUMNS, TRACKED, Limits, Tracker, track_frames

CROSSED = "stream string, track_id bigint, frame_no bigint, direction string"


class TrackerProcessor(StatefulProcessor):
    """A tracker per stream. Frames of a batch are put in order; boxes of frames at or before the last one seen come too late and are given back without a track."""

    def __init__(self, limits: Limits | None = None) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tracks", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        tracker = Tracker.load(json.loads(self.state.get()[0]), self.limits) if self.state.exists() else Tracker(self.limits)
        late = pdf["frame_no"] <= tracker.frame if tracker.frame is not None else pd.Series(False, index=pdf.index)
        if (~late).any():
            yield track_frames(tracker, pdf[~late])
            self.state.update((json.dumps(tracker.dump()),))
        if late.any():
            yield pdf[late].assign(track_id=pd.array([None] * int(late.sum()), dtype="Int64"))[_COLUMNS]

    def close(self) -> None:
        pass


class CrossingProcessor(StatefulProcessor):
    """Counts each track once as it crosses a vertical line at ``x``; state is the last position and whether it counted."""

    def __init__(self, x: float) -> None:
        self.x = x

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("track", "x double, counted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("frame_no")
        before, counted = self.state.get() if self.state.exists() else (None, False)
        x = pdf["x"].astype(float)
        last = x.shift(1)
        last.iloc[0] = float("nan") if before is None else before
        hit = ((last - self.x) * (x - self.x) <= 0) & (last != x)
        if not counted and hit.any():
            counted, at = True, hit.to_numpy().argmax()
            yield pd.DataFrame([(key[0], int(key[1]), int(pdf["frame_no"].iloc[at]), "in" if x.iloc[at] > last.iloc[at] else "out")], columns=["stream", "track_id", "frame_no", "direction"])
        self.state.update((float(x.iloc[-1]), counted))

    def close(self) -> None:
        pass


def track_stream(boxes: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Tracked boxes of a stream of boxes."""
    return boxes.groupBy("stream").transformWithStateInPandas(TrackerProcessor(limits), TRACKED, "Append", "None")


def crossing_stream(positions: DataFrame, x: float) -> DataFrame:
    """Crossings of a vertical line in a stream of positions."""
    return positions.groupBy("stream", "track_id").transformWithStateInPandas(CrossingProcessor(x), CROSSED, "Append", "None")
