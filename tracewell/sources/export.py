"""Exports: elementary streams with a frame index, and the checks a remux must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_index(frames: DataFrame, keys: list[str], channel: int | None = None) -> DataFrame:
    """Video frames in order with n and es_offset, the place of their payload in the stream that joins the payloads.

    frames: keys, offset, kind, channel, payload_length, pts_ms."""
    rows = frames.where(F.col("kind").isin("I", "P", "B"))
    rows = rows if channel is None else rows.where(F.col("channel") == channel)
    order = Window.partitionBy(*keys).orderBy("offset")
    before = F.sum("payload_length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"n": F.row_number().over(order) - 1, "es_offset": F.coalesce(before, F.lit(0))})


def write_frame_index(index: DataFrame, path: str) -> None:
    """JSON lines, one for each frame; a path that exists is refused."""
    index.write.mode("errorifexists").json(path)


def remux_problems(index: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """keys, problem: presentation times that do not rise, and streams whose payloads do not add up to their size.

    sizes: keys, es_bytes."""
    order = Window.partitionBy(*keys).orderBy("n")
    falls = index.withColumn("last", F.lag("pts_ms").over(order)).where("pts_ms <= last").select(*keys, F.lit("presentation times do not rise").alias("problem")).distinct()
    sums = index.groupBy(*keys).agg(F.sum("payload_length").alias("total"))
    wrong = sizes.join(sums, keys, "left").where(F.coalesce("total", F.lit(0)) != F.col("es_bytes")).select(*keys, F.lit("payloads do not add up to the stream").alias("problem"))
    return falls.unionByName(wrong)


def gray_frames(streams: DataFrame, width: int, height: int, fps: float) -> DataFrame:
    """recording_id, frame_no, pts_ms, gray: a stream of grey pictures cut to frames; a rest that is no frame is left out."""
    size = width * height
    n = F.floor(F.octet_length("content") / size).cast("int")
    numbers = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("frame_no")
    rows = streams.select("recording_id", "content", numbers)
    pts = F.rint(F.col("frame_no") * 1000 / F.lit(float(fps))).cast("long")
    return rows.select("recording_id", F.col("frame_no").cast("long").alias("frame_no"), pts.alias("pts_ms"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.substring("content", F.col("frame_no") * size + 1, F.lit(size)).alias("gray"))
