"""The trackers over a stream of frames: one state a camera, the same step as in batch.

Frames without detections come as rows with a null det_ord, so that they age tracks. State is pruned by
the tracker's own max_age, counted in frames. With a lateness, rows wait in the state until the watermark
has passed their frame, and frames are stepped in order however they came; without, a trigger's frames are
stepped at its end. Rows of frames that have been stepped are late: they are left out, not stepped again.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.trackers import RESULT, advance, sort_tracker


#: The event time of frame 0, in milliseconds: a watermark starts at 0, and what is not after it is late.
START = 86_400_000


def track_stream(rows: DataFrame, make=sort_tracker, lateness: int | None = None, fps: float = 25.0, **options: object) -> DataFrame:
    """rows: a stream as operators.trackers.frame_rows gives for batch; lateness in frames, of which fps make a second."""
    milli = 1000.0 / fps

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, done, held = pickle.loads(state.get[0]) if state.exists else (make(**options), -1, None)
        parts = [] if state.hasTimedOut else list(batches)
        parts = [p for p in (held, *parts) if p is not None and len(p)]
        if parts:
            waiting = pd.concat(parts, ignore_index=True)
            waiting = waiting[waiting.frame_index > done]
            ready = waiting.frame_index >= 0 if lateness is None else START + waiting.frame_index * milli <= state.getCurrentWatermarkMs()
            now, held = waiting[ready], waiting[~ready]
            if len(now):
                done = int(now.frame_index.max())
                yield advance(tracker, now.drop(columns="event_time", errors="ignore"))
        state.update((pickle.dumps((tracker, done, held)),))
        if held is not None and len(held):
            state.setTimeoutTimestamp(max(int(START + held.frame_index.min() * milli), state.getCurrentWatermarkMs() + 1))

    if lateness is not None:
        rows = rows.withColumn("event_time", F.timestamp_millis((F.col("frame_index") * milli + START).cast("bigint")))
        rows = rows.withWatermark("event_time", f"{int(lateness * milli)} milliseconds")
    timeout = GroupStateTimeout.NoTimeout if lateness is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("camera_id").applyInPandasWithState(run, RESULT, "tracker binary", "append", timeout)
