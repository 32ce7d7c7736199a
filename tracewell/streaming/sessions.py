"""Streams of frames and segments: motion sessions and channel gaps with state bounded by the number of live streams: a
stream that brings nothing for idle_ms of processing time is closed, its open session emitted, and its state dropped. Rows
that come for it later begin a new one. State is in the query's checkpoint, so a query that is stopped and started again
goes on where it was. Without idle_ms nothing expires: right for a query that ends when all is read, since one with a clock
is never done.

Device times come without a zone; streams are given them as timestamps, for Spark's watermarks take nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.motion import MAX_GAP_FRAMES, MIN_EVENT_FRAMES


def motion_sessions(frames: DataFrame, min_event_frames: int = MIN_EVENT_FRAMES, max_gap_frames: int = MAX_GAP_FRAMES, idle_ms: int | None = None) -> DataFrame:
    """Sessions as operators.motion.motion_segments gives them, emitted when a later frame closes them.

    frames (streaming): recording_id, frame_no, motion; each recording's frames arrive in order over the batches. State is
    the open session of a recording. A recording's last session is closed by a row with frame_no null, or by idleness."""

    columns = ["recording_id", "first_frame", "last_frame", "motion_frames"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last, count, idle = state.get if state.exists else (None, None, 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], first, last, count)] if count >= min_event_frames else [], columns=columns)
            return
        pdf = pd.concat(batches).sort_values("frame_no", na_position="last")
        out = []
        for number, motion in zip(pdf["frame_no"], pdf["motion"]):
            ends = pd.isna(number)
            if not ends and motion and (first is None or idle <= max_gap_frames):
                first, last, count, idle = number if first is None else first, number, count + 1, 0
                continue
            idle += 0 if ends or motion else 1
            if first is not None and (ends or motion or idle > max_gap_frames):
                if count >= min_event_frames:
                    out.append((key[0], int(first), int(last), int(count)))
                first, last, count, idle = (number, number, 1, 0) if motion and not ends else (None, None, 0, 0)
        state.update((None if first is None else int(first), None if last is None else int(last), int(count), int(idle)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=columns)

    kind = frames.schema["recording_id"].dataType.simpleString()
    return frames.groupBy("recording_id").applyInPandasWithState(
        step, f"recording_id {kind}, first_frame long, last_frame long, motion_frames long", "first long, last long, count long, idle long", "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout"
    )


def channel_gaps(segments: DataFrame, min_gap_us: int = 1_000_000, idle_ms: int | None = None) -> DataFrame:
    """Gaps between neighbouring segments of a channel, as they arrive in order: evidence_id, channel, start_us, end_us,
    uncertainty_us. State is the last segment of each channel."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        end, unsure = state.get if state.exists else (None, 0)
        out = []
        for row in pd.concat(batches).sort_values(["start_us", "end_us"]).itertuples():
            if end is not None and (row.start_us - row.uncertainty_us) - (end + unsure) >= min_gap_us:
                out.append((*key, int(end + unsure), int(row.start_us - row.uncertainty_us)))
            end, unsure = row.end_us, row.uncertainty_us
        state.update((int(end), int(unsure)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["evidence_id", "channel", "gap_start_us", "gap_end_us"])

    kinds = {f.name: f.dataType.simpleString() for f in segments.schema}
    return segments.groupBy("evidence_id", "channel").applyInPandasWithState(
        step, f"evidence_id {kinds['evidence_id']}, channel {kinds['channel']}, gap_start_us long, gap_end_us long", "end long, unsure long", "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout"
    )


def frames_per_minute(frames: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Frames and keyframes of each channel and minute of device time, with late frames taken for a while.

    frames (streaming): ts (timestamp), evidence_id, channel, kind."""
    minute = F.window("ts", "1 minute")
    counted = frames.withWatermark("ts", late).groupBy(minute, "evidence_id", "channel").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("kind") == "I").alias("keyframes"))
    return counted.select(F.col("window.start").alias("minute"), "evidence_id", "channel", "frames", "keyframes")
