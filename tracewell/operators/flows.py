"""What an examiner runs on a case, each as one function from the case's tables to new rows for them.

Nothing here writes: the rows returned are stored with sources.casestore. Times are integer microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from . import findings, intervals, motion, sweeps, timeline


def renormalise(recordings: DataFrame, segments: DataFrame) -> DataFrame:
    """recordings (evidence_id, local_start_us, local_end_us, ...) with ref_start_us, ref_end_us, uncertainty_s and t_method of
    the clock segments given. A side without evidence stays unknown; where either does, the method is 'none' and no
    uncertainty is stated."""
    rows = recordings.drop("ref_start_us", "ref_end_us", "uncertainty_s", "t_method")
    for side in ("start", "end"):
        names = {"utc_us": f"ref_{side}_us", "uncertainty_s": f"__{side}_u", "method": f"__{side}_m", "reason": f"{side}_reason"}
        rows = timeline.normalise(rows, segments, f"local_{side}_us").withColumnsRenamed(names)
    known = F.col("ref_start_us").isNotNull() & F.col("ref_end_us").isNotNull()
    rows = rows.withColumns({"uncertainty_s": F.when(known, F.greatest("__start_u", "__end_u")), "t_method": F.when(known, F.col("__start_m")).otherwise("none")})
    return rows.drop("__start_m", "__end_m", "__start_u", "__end_u")


def set_offset(observations: DataFrame, new: DataFrame, recordings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All observations with the new ones, the recordings renormalised, and evidence_id, normalised, refused.

    Observations that overlap, or claim more certainty than their method allows, raise when any of these is read."""
    every = timeline.observe(observations.unionByName(new))
    made = renormalise(recordings, timeline.clock_segments(every))
    placed = F.count_if(F.col("t_method") != "none")
    return every, made, made.groupBy("evidence_id").agg(placed.alias("normalised"), (F.count(F.lit(1)) - placed).alias("refused"))


def timeline_data(recordings: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lanes as rows (evidence_id, channel, position, recording_id, start_us, end_us, uncertainty_s), and the recordings that
    are on none with the reason."""
    rows = renormalise(recordings, segments).withColumnsRenamed({"ref_start_us": "start_us", "ref_end_us": "end_us"})
    unsure = F.col("uncertainty_s") * timeline.SECOND
    rows = timeline.placements(rows.withColumns({"start_u": unsure, "end_u": unsure}))
    keys, order = ["evidence_id", "channel"], ["start_us", "end_us", "recording_id"]
    placed = rows.where("unplaced is null").withColumn("__one", F.lit(1))
    placed = sweeps.swept(sweeps.dealt(placed, keys, order), keys, order, position=("sum", "__one"))
    lanes = placed.select("evidence_id", "channel", F.col("position").cast("long").alias("position"), "recording_id", "start_us", "end_us", "uncertainty_s")
    return lanes, rows.where("unplaced is not null").select("evidence_id", "channel", "recording_id", F.col("unplaced").alias("reason"))


def gap_report(recordings: DataFrame, min_gap_us: int = timeline.SECOND) -> tuple[DataFrame, DataFrame]:
    """Gaps (evidence_id, basis, kind, channel, gap_start_us, gap_end_us, uncertainty_us, after_id, before_id), and the
    recordings left off the axis with the reason. An item is on reference time if any of its recordings has one; else
    gaps are in device time and the basis says so."""
    unsure = F.coalesce(F.col("uncertainty_s") * timeline.SECOND, F.lit(0)).cast("long")
    rows = timeline.gap_basis(recordings).withColumn("uncertainty_us", unsure)
    on_axis = rows.where("placed")
    kind = lambda df, name: df.withColumn("kind", F.lit(name))
    alone = kind(timeline.channel_gaps(on_axis, min_gap_us, ("evidence_id", "basis")), "channel")
    shared = kind(timeline.synchronised_gaps(on_axis, min_gap_us).join(rows.select("evidence_id", "basis").distinct(), "evidence_id"), "synchronised")
    missing = F.col("start_us").isNull() | F.col("end_us").isNull()
    reason = F.when(missing, F.concat(F.lit("no "), F.col("basis"), F.lit(" time on this recording"))).otherwise("end is before start")
    columns = ["evidence_id", "basis", "kind", "channel", "gap_start_us", "gap_end_us", "uncertainty_us", "after_id", "before_id"]
    return alone.unionByName(shared, allowMissingColumns=True).select(*columns), rows.where("not placed").select("evidence_id", "recording_id", "channel", reason.alias("reason"))


def parsed(layouts: DataFrame, recordings: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The recordings an index states (without freed entries) for evidence that has none yet, and evidence_id, recordings,
    channels of each. An item whose layout is not parsed has no rows: carving is left."""
    fresh = recordings.where("tier = 'T1'").join(layouts.where("parse_supported").select("evidence_id"), "evidence_id", "left_semi")
    fresh = fresh.join(known.select("evidence_id"), "evidence_id", "left_anti")
    summary = fresh.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("recordings"), F.sort_array(F.collect_set("channel")).alias("channels"))
    return fresh, summary


def recovered(images: DataFrame, layouts: DataFrame, existing: DataFrame, found: DataFrame, gaps: DataFrame) -> dict[str, DataFrame]:
    """A recovery from what tiers found to its figures: fresh (survivors of the merge that were not stored), coverage, totals,
    and summary (evidence_id, added, duplicates_merged, items_without_time, t1_minutes, recovered_minutes, gain_pct).

    existing, found: evidence_id, recording_id, tier, extents, note, local_start_us, local_end_us; images: evidence_id, size;
    layouts: evidence_id, index_extents; gaps: evidence_id, offset, length."""
    both = existing.unionByName(found)
    merged = staged(intervals.merge_tiers(both), "merged")  # read by each of the results
    kept = both.join(merged.where("kept_id = recording_id").select("evidence_id", "recording_id"), ["evidence_id", "recording_id"], "left_semi")
    fresh = intervals.fresh_recordings(kept, existing)
    coverage = intervals.coverage_map(images, intervals.claims_of(layouts, kept, gaps))
    # all that is fresh counts as gained; one pass over it
    timed = existing.where("tier = 'T1'").withColumn("fresh", F.lit(False)).unionByName(fresh.withColumns({"tier": F.lit("T2"), "fresh": F.lit(True)}))
    untimed = F.col("local_start_us").isNull() | F.col("local_end_us").isNull()
    gain = findings.recovery_gain(timed, added=F.count_if("fresh"), items_without_time=F.count_if(F.col("fresh") & untimed))
    summary = images.select("evidence_id")
    for part in (gain, intervals.merge_stats(merged).select("evidence_id", F.col("dropped").alias("duplicates_merged"))):
        summary = summary.join(part, "evidence_id", "left")
    summary = summary.select("evidence_id", "added", "items_without_time", "duplicates_merged", "t1_minutes", "recovered_minutes", "gain_pct")
    numbers = ("added", "items_without_time", "duplicates_merged", "t1_minutes", "recovered_minutes")
    return {"fresh": fresh, "coverage": coverage, "totals": intervals.coverage_totals(images, coverage), "summary": summary.na.fill(0, list(numbers))}


def motion_analysis(gray: DataFrame, area: int, sensitivity: int = motion.SENSITIVITY, min_area: int = motion.MIN_AREA, region=None, **sessions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, annotations, and recording_id, frames, motion_frames of decoded grey frames (see motion.frame_differences)."""
    frames = motion.motion_frames(motion.frame_differences(gray, sensitivity, region), area, min_area)
    summary = frames.groupBy("recording_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if("motion").alias("motion_frames"))
    return motion.motion_segments(frames, **sessions), motion.annotations(frames), summary


def looked_up(rows: DataFrame, **wanted: object) -> DataFrame:
    """The rows of a case table with the values given; one that is None asks nothing. (Filters reach the scan.)"""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows
