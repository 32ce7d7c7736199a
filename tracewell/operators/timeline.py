"""Clock models, normalisation to reference time, lanes and recording gaps. Times are integer microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sweeps
from .intervals import islands

#: The least uncertainty each method of observing a clock allows, in seconds.
METHOD_FLOOR_S = {"A_ntp": 1.0, "B_reference_capture": 1.0, "C_external_event": 2.0, "D_live_rtc": 1.0}
DEFAULT_UNCERTAINTY_S = {"C_external_event": 60.0}
SECOND = 1_000_000


def observe(observations: DataFrame) -> DataFrame:
    """Adds offset_us (device time read as UTC less true time) and a default uncertainty; a stated one below the method's
    floor raises when it is read."""
    floor = F.element_at(F.create_map(*[F.lit(x) for kv in METHOD_FLOOR_S.items() for x in kv]), F.col("method"))
    default = F.coalesce(*[F.when(F.col("method") == m, F.lit(s)) for m, s in DEFAULT_UNCERTAINTY_S.items()], floor)
    stated = F.coalesce("uncertainty_s", default)
    checked = F.when(floor.isNull(), F.raise_error("unknown method").cast("double")).when(stated < floor, F.raise_error("uncertainty below the method's floor").cast("double")).otherwise(stated)
    return observations.withColumn("uncertainty_s", checked).withColumn("offset_us", F.col("device_local_us") - F.col("true_utc_us"))


def clock_segments(observations: DataFrame) -> DataFrame:
    """Observations in order of validity, checked to be disjoint: neighbours must be bounded and not overlap."""
    order = Window.partitionBy("evidence_id").orderBy(F.col("valid_from_us").asc_nulls_first(), "device_local_us")
    rows = observations.withColumns({"__next": F.lead("valid_from_us").over(order), "__last": F.lead(F.lit(1)).over(order).isNull()})
    clash = ~F.col("__last") & (F.col("valid_to_us").isNull() | F.col("__next").isNull() | (F.col("__next") < F.col("valid_to_us")))
    checked = F.when(clash, F.raise_error("offset observations overlap: bound each with valid_from and valid_to").cast("long")).otherwise(F.col("offset_us"))
    return rows.withColumn("offset_us", checked).drop("__next", "__last")


#: Clock segments (about 100 bytes each) that may be sent to every task; more meet the times by a sweep.
CLOCKS = 100_000


def normalise(times: DataFrame, segments: DataFrame, local: str = "local_us") -> DataFrame:
    """Adds utc_us, uncertainty_s, method ('none' where refused) and reason to rows of (evidence_id, local time).

    Segments of one evidence are disjoint, so at most one covers a time: the last opened at or before it, if it is still
    open. Up to CLOCKS segments (counted first) go to every task as a sorted list an evidence, and no time moves; with
    more, boundaries and times are put in one order. Both give the same rows."""
    opened = F.coalesce("valid_from_us", F.lit(-(2**62)))
    seg = segments.select("evidence_id", opened.alias("__at"), F.struct("offset_us", "uncertainty_s", "method", "valid_to_us").alias("__seg"))
    if segments.limit(CLOCKS + 1).count() <= CLOCKS:
        lists = seg.groupBy("evidence_id").agg(F.array_sort(F.collect_list(F.struct("__at", "__seg"))).alias("__list"))
        both = times.join(F.broadcast(lists), "evidence_id", "left")  # counted above
        before = F.filter("__list", lambda s: s["__at"] <= F.coalesce(local, F.lit(-(2**62) - 1)))
        both = both.withColumn("__s", F.try_element_at(before, F.lit(-1))["__seg"])
    else:
        rows = times.withColumns({"__at": F.coalesce(local, F.lit(-(2**62) - 1)), "__kind": F.lit(1), "__seg": F.lit(None).cast(seg.schema["__seg"].dataType)})
        order = Window.partitionBy("evidence_id").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
        both = rows.unionByName(seg.withColumn("__kind", F.lit(0)), allowMissingColumns=True).withColumn("__s", F.last("__seg", True).over(order)).where("__kind = 1")
    covered = F.col(local).isNotNull() & F.col("__s").isNotNull() & (F.col("__s.valid_to_us").isNull() | (F.col(local) < F.col("__s.valid_to_us")))
    reason = F.when(F.col(local).isNull(), "no device time on this item").when(~covered, "no offset evidence covers this device time")
    return both.select(
        *times.columns,
        F.when(covered, F.col(local) - F.col("__s.offset_us")).alias("utc_us"),
        F.when(covered, F.col("__s.uncertainty_s")).alias("uncertainty_s"),
        F.when(covered, F.col("__s.method")).otherwise("none").alias("method"),
        reason.alias("reason"),
    )


def clock_offset(segments: DataFrame, tz_offset_s: int | None) -> DataFrame:
    """Adds clock_offset_s: the total offset less a stated timezone, or all of it."""
    return segments.withColumn("clock_offset_s", F.col("offset_us") / SECOND - F.lit(tz_offset_s or 0))


def format_offset(seconds: Column) -> Column:
    """+HH:MM:SS of a number of seconds, rounded half to even as Python rounds."""
    whole = F.rint(F.abs(seconds)).cast("long")
    sign = F.when(seconds >= 0, "+").otherwise("-")
    return F.format_string("%s%02d:%02d:%02d", sign, F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60)


def ordering(a_us: Column, a_uncertainty_us: Column, b_us: Column, b_uncertainty_us: Column) -> Column:
    """before, after, or not_determinable inside the combined uncertainty or where a time is unknown."""
    delta = a_us - b_us
    unsure = F.coalesce(F.abs(delta) <= a_uncertainty_us + b_uncertainty_us, F.lit(True))
    return F.when(unsure, "not_determinable").when(delta < 0, "before").otherwise("after")


def placements(recordings: DataFrame) -> DataFrame:
    """recordings (evidence_id, recording_id, channel, start_us, end_us, start_u, end_u, reasons) with placed and why not."""
    reason = (
        F.when(F.col("start_us").isNull(), F.coalesce("start_reason", F.lit("start not established")))
        .when(F.col("end_us").isNull(), F.coalesce("end_reason", F.lit("end not established")))
        .when(F.col("end_us") < F.col("start_us"), "normalised end is before start")
    )
    return recordings.withColumns({"unplaced": reason, "uncertainty_us": F.greatest("start_u", "end_u")})


def lanes(placed: DataFrame) -> DataFrame:
    """evidence_id, channel, segments: the placed recordings of each channel in order, as one value a lane. For a few chosen
    lanes; flows.timeline_data gives lanes of any length as rows."""
    segment = F.struct("start_us", "end_us", "recording_id", "uncertainty_us")
    grouped = placed.where("unplaced is null").groupBy("evidence_id", "channel").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    return grouped


def channel_gaps(segments: DataFrame, min_gap_us: int = SECOND, keys: tuple[str, ...] = ("evidence_id",)) -> DataFrame:
    """Gaps between a channel's neighbouring segments in (start, end, id) order, each side shrunk by its uncertainty.

    Only neighbours are compared: a segment nested in an earlier one opens a gap after its own end. For gaps in what all
    segments cover together, use covered_gaps."""
    by, order = [*keys, "channel"], ["start_us", "end_us", "recording_id"]
    slim = segments.select(*by, *order, "uncertainty_us")
    both = sweeps.swept(sweeps.dealt(slim, by, order), by, order, r=("lead", F.struct("start_us", "uncertainty_us", "recording_id"))).where("r is not null")
    gaps = both.select(
        *keys, "channel", (F.col("end_us") + F.col("uncertainty_us")).alias("gap_start_us"), (F.col("r.start_us") - F.col("r.uncertainty_us")).alias("gap_end_us"),
        (F.col("uncertainty_us") + F.col("r.uncertainty_us")).alias("uncertainty_us"), F.col("recording_id").alias("after_id"), F.col("r.recording_id").alias("before_id"),
    )
    return gaps.where(F.col("gap_end_us") - F.col("gap_start_us") >= min_gap_us)


def covered_gaps(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps between the islands of what the segments of a key cover."""
    runs = islands(segments.select(*keys, F.col("start_us").alias("start"), F.col("end_us").alias("end")), keys)
    runs = sweeps.swept(sweeps.dealt(runs, keys, ["start"]), keys, ["start"], gap_start_us=("lag", "end"))
    return runs.select(*keys, "gap_start_us", F.col("start").alias("gap_end_us")).where("gap_start_us < gap_end_us")


def synchronised_gaps(segments: DataFrame, min_gap_us: int = SECOND, key: str = "evidence_id") -> DataFrame:
    """Times in the span all channels share when none records, shrunk by the worst uncertainty on both sides.

    The span runs from the latest first start to the earliest last end of the channels; a missing channel number is a
    channel; fewer than two channels have no such gaps."""
    per_channel = segments.groupBy(key, "channel").agg(F.min("start_us").alias("first"), F.max("end_us").alias("last"), F.max("uncertainty_us").alias("u"))
    spans = per_channel.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("low"), F.min("last").alias("high"), F.max("u").alias("u"))
    spans = spans.where("n >= 2 and high > low")
    covered = islands(segments.select(key, F.col("start_us").alias("start"), F.col("end_us").alias("end")), [key])
    tail = spans.select(key, F.col("high").alias("start"), F.col("high").alias("end"))
    both, order = covered.select(key, "start", "end").unionByName(tail), ["start", "end"]
    seen = sweeps.swept(sweeps.dealt(both, [key], order), [key], order, reach=("max_before", "end")).join(spans, key)
    gaps = seen.select(key, "u", F.greatest(F.coalesce("reach", "low"), "low").alias("a"), F.least("start", "high").alias("b"))
    gaps = gaps.select(key, (F.col("a") + F.col("u")).alias("gap_start_us"), (F.col("b") - F.col("u")).alias("gap_end_us"), (2 * F.col("u")).alias("uncertainty_us"))
    return gaps.where(F.col("gap_end_us") - F.col("gap_start_us") >= min_gap_us).distinct()


def gap_basis(recordings: DataFrame) -> DataFrame:
    """Adds basis ('reference' if any recording of the evidence has a reference start, else 'device'), the times on that
    basis, and placed."""
    timed = recordings.where("ref_start_us is not null").select(F.col("evidence_id").alias("__timed")).distinct()
    rows = recordings.join(timed, F.col("evidence_id").eqNullSafe(F.col("__timed")), "left")  # items are few: no item's rows are gathered
    rows = rows.withColumn("basis", F.when(F.col("__timed").isNotNull(), "reference").otherwise("device")).drop("__timed")
    pick = lambda ref, dev: F.when(F.col("basis") == "reference", F.col(ref)).otherwise(F.col(dev))
    rows = rows.withColumns({"start_us": pick("ref_start_us", "local_start_us"), "end_us": pick("ref_end_us", "local_end_us")})
    return rows.withColumn("placed", F.coalesce(F.col("end_us") >= F.col("start_us"), F.lit(False)))
