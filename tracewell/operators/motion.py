"""Motion in grey frames: changed pixels against the frame before, and sessions of frames with motion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sweeps

SENSITIVITY, MIN_AREA, MIN_EVENT_FRAMES, MAX_GAP_FRAMES = 25, 400, 2, 5
FULL_SCORE_SHARE = 0.15


Region = tuple[int, int, int, int]


def inside(region: Region | None, x: Column, y: Column) -> Column:
    """Whether a pixel lies in a region of interest (x, y, width, height), which may reach beyond the frame."""
    if region is None:
        return F.lit(True)
    left, top, width, height = region
    return (x >= left) & (x < left + width) & (y >= top) & (y < top + height)


#: Frame numbers of a block: a recording's frames are compared block by block, by as many tasks.
STRIDE = 1024


def with_before(frames: DataFrame, column: str) -> DataFrame:
    """frames with before: the column of the frame before, in its recording (null for none).

    Frames are dealt by (recording, block of STRIDE numbers), so a long recording is many tasks' work. The last frame of a
    block goes to the next block that has frames too; which ones they are is found from the numbers alone, and no other
    frame's bytes move twice."""
    keys = ["recording_id", "__block"]
    rows = frames.withColumn("__block", F.floor(F.col("frame_no") / STRIDE))
    ends = rows.groupBy(*keys).agg(F.max("frame_no").alias("frame_no"))
    following = F.lead("__block").over(Window.partitionBy("recording_id").orderBy("__block"))  # a row for each block
    ends = ends.withColumn("__to", following).where("__to is not null").select("recording_id", "frame_no", "__to")
    carried = rows.join(ends, ["recording_id", "frame_no"]).withColumn("__block", F.col("__to"))
    own = rows.withColumn("__to", F.lit(None).cast("long"))
    dealt = own.unionByName(carried.select(*own.columns))
    order = Window.partitionBy(*keys).orderBy("frame_no")
    return dealt.withColumn("before", F.lag(column).over(order)).where("__to is null").drop("__block", "__to")


def differences(frames: DataFrame, sensitivity: int = SENSITIVITY, region: Region | None = None) -> DataFrame:
    """recording_id, frame_no, changed, x0, y0, x1, y1: pixels (of the region) that changed by `sensitivity` or more since
    the frame before, and their tight box (null where none did).

    frames: recording_id, frame_no, width, pixels (array of int). For thumbnails; encoded frames go through
    frame_differences."""
    rows = with_before(frames, "pixels")
    moved = F.filter(F.transform(F.arrays_zip("pixels", "before"), lambda p, i: F.when(F.abs(p["pixels"] - p["before"]) >= sensitivity, i)), lambda i: i.isNotNull())
    moved = F.filter(moved, lambda i: inside(region, i % F.col("width"), F.floor(i / F.col("width"))))
    rows = rows.withColumn("moved", F.when(F.col("before").isNotNull(), moved).otherwise(F.array().cast("array<int>")))
    x = F.transform("moved", lambda i: i % F.col("width"))
    y = F.transform("moved", lambda i: F.floor(i / F.col("width")).cast("int"))
    return rows.select(
        "recording_id", "frame_no", F.size("moved").alias("changed"),
        F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), (F.array_max(x) + 1).alias("x1"), (F.array_max(y) + 1).alias("y1"),
    )


def frame_differences(frames: DataFrame, sensitivity: int = SENSITIVITY, region: Region | None = None) -> DataFrame:
    """The same for frames of bytes: recording_id, frame_no, width, height, gray (width * height bytes).

    The frame before comes by blocks (see with_before); the pixels are compared by numpy in batches."""
    rows = with_before(frames.select("recording_id", "frame_no", "width", "height", "gray"), "gray")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for recording, number, width, height, now, before in zip(*(pdf[c] for c in ("recording_id", "frame_no", "width", "height", "gray", "before"))):
                if len(now) != width * height:
                    raise ValueError(f"frame {number} of {recording} has {len(now)} bytes, not {width} x {height}")
                box = (0, None, None, None, None)
                if before is not None and len(before) == len(now):
                    moved = np.abs(np.frombuffer(now, np.uint8).astype(np.int16) - np.frombuffer(before, np.uint8)) >= sensitivity
                    moved = moved.reshape(height, width)
                    if region is not None:
                        left, top, across, down = region
                        seen = np.zeros_like(moved)
                        seen[max(0, top) : max(0, top + down), max(0, left) : max(0, left + across)] = True
                        moved &= seen
                    ys, xs = np.nonzero(moved)
                    if len(xs):
                        box = (len(xs), int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1)
                out.append((recording, number, *box))
            made = pd.DataFrame(out, columns=["recording_id", "frame_no", "changed", "x0", "y0", "x1", "y1"])
            yield made.astype({c: "Int64" for c in ("x0", "y0", "x1", "y1")})

    kind = frames.schema["recording_id"].dataType.simpleString()
    return rows.select("recording_id", "frame_no", "width", "height", "gray", "before").mapInPandas(
        compare, f"recording_id {kind}, frame_no long, changed long, x0 long, y0 long, x1 long, y1 long"
    )


def motion_frames(changes: DataFrame, area: int, min_area: int = MIN_AREA) -> DataFrame:
    """Adds motion (min_area pixels or more changed) and score (the changed share of the area, full at 0.15 of it, to four
    digits); a frame without motion has no box."""
    motion = (F.col("changed") >= min_area) & (F.col("changed") > 0)
    score = F.when(motion, F.round(F.least(F.lit(1.0), F.col("changed") / (FULL_SCORE_SHARE * area)), 4)).otherwise(0.0)
    box = {c: F.when(motion, F.col(c)) for c in ("x0", "y0", "x1", "y1")}
    return changes.withColumns({"motion": motion, "score": score, **box})


def motion_segments(frames: DataFrame, min_event_frames: int = MIN_EVENT_FRAMES, max_gap_frames: int = MAX_GAP_FRAMES) -> DataFrame:
    """recording_id, first_frame, last_frame, motion_frames, peak: sessions of motion, closed by more than
    max_gap_frames idle frames (counted, not timed), kept from min_event_frames of motion on; ends at its last motion."""
    keys, order = ["recording_id"], ["frame_no"]
    slim = frames.select("recording_id", "frame_no", "motion", "score", F.lit(1).alias("one"))
    rows = sweeps.swept(sweeps.dealt(slim, keys, order), keys, order, at=("sum", "one")).where("motion")
    rows = sweeps.swept(rows, keys, order, was=("lag", "at"))
    new = F.when(F.coalesce(F.col("at") - F.col("was") - 1 <= max_gap_frames, F.lit(False)), 0).otherwise(1)
    rows = sweeps.swept(rows.withColumn("new", new), keys, order, session=("sum", "new"))
    made = rows.groupBy("recording_id", "session").agg(
        F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"), F.count(F.lit(1)).alias("motion_frames"), F.max("score").alias("peak")
    )
    return made.where(F.col("motion_frames") >= min_event_frames).drop("session")


def annotations(frames: DataFrame) -> DataFrame:
    """A row for each frame with motion (see motion_frames): its box as [x, y, width, height], score and changed pixels,
    with the words that it proves nothing by itself."""
    box = F.array("x0", "y0", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    note = F.concat(F.lit("changed_pixels="), F.col("changed").cast("string"))
    warning = F.lit("an automatic aid to review; absence of motion here is not evidence of absence")
    shown = frames.where("motion")
    return shown.select("recording_id", "frame_no", F.lit("motion").alias("label"), box.alias("bbox"), "score", note.alias("note"), warning.alias("disclaimer"))


def licensed_models(specs: DataFrame, allowed: list[str], files: DataFrame) -> DataFrame:
    """Model files whose license is allowed and whose SHA-256 is the one stated. files: path, content."""
    digests = files.select("path", F.sha2("content", 256).alias("sha256_found"))
    return specs.where(F.col("license").isin(*allowed)).join(digests, "path").where("sha256 = sha256_found").drop("sha256_found")
