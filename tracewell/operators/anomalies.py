"""Six detectors of recordings whose own times contradict each other. Times are integer microseconds.

segments: evidence_id, recording_id, channel, start_us, end_us, index_position, extent_key. Each finding has kind,
channel, recording_ids, and numbers that the kind gives: seconds and count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sweeps

SHOWN = 20

#: Explanations that fit each kind.
CAUSES = {
    "duplicate_window": [
        "the device clock was set backwards, manually or by NTP correction",
        "the real-time clock battery failed and the clock reset on power-up",
        "an index was restored or rebuilt from a stale copy",
    ],
    "backwards_sequence": [
        "the device clock was set backwards between the two recordings",
        "the index entries were written out of order after a power event",
    ],
    "before_volume_format": [
        "the device clock was wrong when the footage was written",
        "the clock was wrong when the volume was formatted",
        "the recorded format time is not the most recent format of this volume",
    ],
    "future_dated": [
        "the device clock was ahead of true time",
        "the acquisition time recorded for this evidence is wrong",
    ],
    "zero_length": [
        "the recording was interrupted before any frame was written",
        "the index entry was allocated but never completed",
    ],
    "ends_before_start": [
        "the device clock was set backwards while the recording was in progress",
        "the start or end field is corrupt, or is being read with the wrong layout",
    ],
}

_COLUMNS = ["evidence_id", "kind", "channel", "recording_ids", "seconds", "count"]


def _found(df: DataFrame, kind: str, channel, ids, seconds, count) -> DataFrame:
    return df.select("evidence_id", F.lit(kind).alias("kind"), channel.alias("channel"), ids.alias("recording_ids"), seconds.cast("double").alias("seconds"), count.cast("long").alias("count"))


def _neighbours(segments: DataFrame, *order: str) -> DataFrame:
    timed = segments.where("start_us is not null and end_us is not null")
    keys, along = ["evidence_id", "channel"], list(order)
    timed = timed.select(*(c for c in (*keys, "start_us", "end_us", "recording_id", "extent_key", "index_position") if c in timed.columns))
    return sweeps.swept(sweeps.dealt(timed, keys, along), keys, along, n=("lead", F.struct("start_us", "end_us", "recording_id", "extent_key"))).where("n is not null")


def duplicate_windows(segments: DataFrame) -> DataFrame:
    """Neighbours on one channel that overlap in time with different bytes. Recordings that end before they start have no
    interval and are nobody's neighbours here."""
    segments = segments.where("start_us <= end_us")
    same = (F.col("extent_key") != "") & (F.col("extent_key") == F.col("n.extent_key"))
    rows = _neighbours(segments, "start_us", "end_us", "recording_id").where((F.col("n.start_us") < F.col("end_us")) & ~F.coalesce(same, F.lit(False)))
    seconds = (F.least("end_us", "n.end_us") - F.col("n.start_us")) / 1e6
    return _found(rows, "duplicate_window", F.col("channel"), F.array("recording_id", "n.recording_id"), seconds, F.lit(2))


def backwards_sequence(segments: DataFrame) -> DataFrame:
    """Neighbours in the order on disk of which the later one starts earlier."""
    rows = _neighbours(segments, "index_position", "recording_id").where(F.col("n.start_us") < F.col("start_us"))
    return _found(rows, "backwards_sequence", F.col("channel"), F.array("recording_id", "n.recording_id"), (F.col("start_us") - F.col("n.start_us")) / 1e6, F.lit(2))


def _many(rows: DataFrame, kind: str, seconds, *order: str) -> DataFrame:
    """One finding an evidence: its first SHOWN recordings in the order given (then by id), their number, the largest
    difference. Only SHOWN rows of an evidence leave each task for the list; the rest is partial sums."""
    by = Window.partitionBy("evidence_id").orderBy(*order, "recording_id")
    first = rows.withColumn("__rank", F.row_number().over(by)).where(F.col("__rank") <= SHOWN)
    first = first.groupBy("evidence_id").agg(F.array_sort(F.collect_list(F.struct("__rank", "recording_id"))).alias("s"))
    sums = rows.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("c"), F.max(seconds).alias("m"))
    return _found(sums.join(first, "evidence_id"), kind, F.lit(None).cast("int"), F.col("s.recording_id"), F.col("m"), F.col("c"))


def before_volume_format(segments: DataFrame, volumes: DataFrame) -> DataFrame:
    """Recordings dated before their volume was formatted. volumes: evidence_id, formatted_us, acquired_us."""
    rows = segments.join(volumes, "evidence_id").where(F.col("start_us") < F.col("formatted_us"))
    return _many(rows, "before_volume_format", (F.col("formatted_us") - F.col("start_us")) / 1e6, "start_us")


def future_dated(segments: DataFrame, volumes: DataFrame) -> DataFrame:
    """Recordings dated after the evidence was acquired."""
    rows = segments.join(volumes, "evidence_id").where(F.col("start_us") > F.col("acquired_us"))
    return _many(rows, "future_dated", (F.col("start_us") - F.col("acquired_us")) / 1e6, "start_us")


def zero_length(segments: DataFrame) -> DataFrame:
    return _many(segments.where("start_us = end_us"), "zero_length", F.lit(0.0))


def ends_before_start(segments: DataFrame) -> DataFrame:
    return _many(segments.where("end_us < start_us"), "ends_before_start", (F.col("start_us") - F.col("end_us")) / 1e6)


def _about_one(segments: DataFrame, volumes: DataFrame) -> DataFrame:
    """The four that look at recordings one by one, with volumes met once: as the functions above find them."""
    rows = segments.join(volumes, "evidence_id", "left")
    begins, ends = F.col("start_us"), F.col("end_us")
    told = [
        ("before_volume_format", begins < F.col("formatted_us"), F.col("formatted_us") - begins, begins), ("future_dated", begins > F.col("acquired_us"), begins - F.col("acquired_us"), begins),
        ("zero_length", begins == ends, F.lit(0), F.lit(None)), ("ends_before_start", ends < begins, begins - ends, F.lit(None)),
    ]
    kinds = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(kind).alias("kind"), (by / 1e6).alias("seconds"), order.cast("long").alias("order"))) for kind, holds, by, order in told]))
    rows = rows.select("evidence_id", "recording_id", F.inline(kinds))
    by = Window.partitionBy("evidence_id", "kind").orderBy("order", "recording_id")
    first = rows.withColumn("__rank", F.row_number().over(by)).where(F.col("__rank") <= SHOWN)
    first = first.groupBy("evidence_id", "kind").agg(F.array_sort(F.collect_list(F.struct("__rank", "recording_id"))).alias("s"))
    sums = rows.groupBy("evidence_id", "kind").agg(F.count(F.lit(1)).alias("c"), F.max("seconds").alias("m"))
    both = sums.join(first, ["evidence_id", "kind"])
    return both.select("evidence_id", "kind", F.lit(None).cast("int").alias("channel"), F.col("s.recording_id").alias("recording_ids"), F.col("m").cast("double").alias("seconds"), F.col("c").alias("count"))


def detect(segments: DataFrame, volumes: DataFrame) -> DataFrame:
    """All six. (evidence_id, kind, channel, recording_ids) orders them, where an order is wanted."""
    return reduce(DataFrame.unionByName, [duplicate_windows(segments), backwards_sequence(segments), _about_one(segments, volumes)])


def with_causes(found: DataFrame) -> DataFrame:
    """Adds the explanations that fit each finding's kind, none of them established."""
    pairs = [x for kind, causes in CAUSES.items() for x in (F.lit(kind), F.array(*map(F.lit, causes)))]
    return found.withColumn("possible_causes", F.element_at(F.create_map(*pairs), F.col("kind")))
