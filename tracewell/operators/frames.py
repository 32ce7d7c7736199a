"""Sequence operators over frames: runs, trimming, confidence, clocks, channel segments and orphan checks.

frames: evidence_id, span_id, offset, length, kind (I, P, B, audio, unknown), channel, local_us (device time), sequence,
codec. Order is physical: by offset within a span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sweeps

SPAN = ["evidence_id", "span_id"]
VIDEO = ("I", "P", "B")
SECOND = 1_000_000
#: The confidence ladder, the keyframes its top needs, and frames sampled from an orphan's block.
CONFIDENCE = {"chain": 0.9, "time": 0.7, "no_time": 0.4, "fragment": 0.2}
KEYFRAMES_FOR_CHAIN = 2
SAMPLE_FRAMES = 8
TICK = 65536


def with_runs(frames: DataFrame, whole: bool = False) -> DataFrame:
    """Adds run (1 upwards in a span) and breaks: why the chain breaks before this frame, the first reason that holds.

    The channel changes, time or sequence number run backwards, or bytes are missing; unknown values break nothing.
    whole: no span is hot, and the frames are dealt already."""
    rows = frames if whole else sweeps.dealt(frames, SPAN, ["offset"])
    before = {f"__{c}": ("lag", c) for c in ("channel", "local_us", "sequence")}
    rows = sweeps.swept(rows, SPAN, ["offset"], **before, __end=("lag", F.col("offset") + F.col("length")))
    p, end = {c: F.col(f"__{c}") for c in ("channel", "local_us", "sequence")}, F.col("__end")
    why = (
        F.when(F.col("channel") != p["channel"], F.concat(F.lit("channel changed "), p["channel"].cast("string"), F.lit(" -> "), F.col("channel").cast("string")))
        .when(F.col("local_us") < p["local_us"], "timestamp ran backwards")
        .when(F.col("sequence") < p["sequence"], "sequence number ran backwards")
        .when(F.col("offset") > end, F.concat(F.lit("byte gap of "), (F.col("offset") - end).cast("string")))
    )
    rows = rows.withColumn("breaks", why).withColumn("__breaks", F.when(F.col("breaks").isNotNull(), 1).otherwise(0))
    rows = sweeps.swept(rows, SPAN, ["offset"], __runs=("sum", "__breaks")).withColumn("run", 1 + F.col("__runs"))
    return rows.drop(*before, "__end", "__breaks", "__runs")


def runs(frames: DataFrame, whole: bool = False) -> DataFrame:
    """A row for each run with a keyframe: its frames from the first keyframe on, and what was trimmed before it.

    Columns: offset, length, channel and codec (where all frames that state one agree), start_us, end_us, frame_count,
    keyframes, trimmed_bytes, ended."""
    rows = with_runs(frames, whole)
    # a frame is kept if its run has had a keyframe: the latest one is not before the latest break
    rows = sweeps.swept(
        rows, SPAN, ["offset"], ends=("lead", "breaks"), __key=("last", F.when(F.col("kind") == "I", F.col("offset"))), __opened=("last", F.when(F.col("breaks").isNotNull(), F.col("offset")))
    )
    kept = F.col("__key").isNotNull() & (F.col("__opened").isNull() | (F.col("__key") >= F.col("__opened")))
    timed = F.when(kept & F.col("local_us").isNotNull(), F.col("offset"))
    made = rows.groupBy(*SPAN, "run").agg(
        F.min(F.when(kept, F.col("offset"))).alias("offset"),
        F.max_by(F.col("offset") + F.col("length"), F.when(kept, F.col("offset"))).alias("end"),
        F.min(F.when(kept, F.col("channel"))).alias("a_channel"), F.max(F.when(kept, F.col("channel"))).alias("channel"),
        F.min(F.when(kept, F.col("codec"))).alias("a_codec"), F.max(F.when(kept, F.col("codec"))).alias("codec"),
        F.min_by("local_us", timed).alias("start_us"), F.max_by("local_us", timed).alias("end_us"),
        F.count_if(kept).alias("frame_count"), F.count_if(kept & (F.col("kind") == "I")).alias("keyframes"),
        F.sum(F.when(~kept, F.col("length")).otherwise(0)).alias("trimmed_bytes"), F.max("ends").alias("ended"),
    ).where("frame_count > 0")
    return made.select(
        *SPAN, "run", "offset", (F.col("end") - F.col("offset")).alias("length"),
        F.when(F.col("a_channel") == F.col("channel"), F.col("channel")).alias("channel"),
        F.when(F.col("a_codec") == F.col("codec"), F.col("codec")).otherwise("unknown").alias("codec"),
        "start_us", "end_us", "frame_count", "keyframes", "trimmed_bytes", F.coalesce("ended", F.lit("end of span")).alias("ended"),
    )


def confidence(frame_count: Column, channel: Column, start_us: Column, keyframes: Column) -> Column:
    """The ladder applied to what a run recovered."""
    chain = start_us.isNotNull() & channel.isNotNull() & (keyframes >= KEYFRAMES_FOR_CHAIN)
    return F.when(frame_count <= 1, CONFIDENCE["fragment"]).when(chain, CONFIDENCE["chain"]).when(start_us.isNotNull(), CONFIDENCE["time"]).otherwise(CONFIDENCE["no_time"])


def confidence_note(frame_count: Column, channel: Column, start_us: Column, keyframes: Column) -> Column:
    n = keyframes.cast("string")
    return (
        F.when(frame_count <= 1, "a single fragment with no chain to support it")
        .when(start_us.isNull(), "no time could be recovered")
        .when(channel.isNull(), "time recovered; the container carries no channel")
        .when(keyframes >= KEYFRAMES_FOR_CHAIN, F.concat(F.lit("channel and time recovered across "), n, F.lit(" keyframes")))
        .otherwise(F.concat(F.lit("channel and time recovered, but only "), n, F.lit(f" keyframe(s) of the {KEYFRAMES_FOR_CHAIN} a chain needs")))
    )


def carved_recordings(found: DataFrame, unreadable: bool = False) -> DataFrame:
    """Runs as recordings in physical order, and of one place by span: T4 where the image has unreadable ranges, else T3."""
    keys, order = ["evidence_id"], ["offset", "run", *(c for c in found.columns if c == "span_id")]
    rows = sweeps.swept(sweeps.dealt(found.withColumn("__one", F.lit(1)), keys, order), keys, order, position=("sum", "__one"))
    what = [F.col(c) for c in ("frame_count", "channel", "start_us", "keyframes")]
    return rows.select(
        "evidence_id", F.col("position").cast("int").alias("position"), F.lit("T4" if unreadable else "T3").alias("tier"), "offset", "length", "channel", "codec", "start_us", "end_us",
        "frame_count", "keyframes", confidence(*what).alias("confidence"), confidence_note(*what).alias("confidence_note"), "trimmed_bytes", "ended",
    )


def unwrapped_ticks(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Adds pts_ms: a 16-bit millisecond tick unwrapped, with whole-second device time to count the wraps.

    frames: keys, offset, tick, seconds (null where the date does not decode)."""
    order = ["offset"]
    rows = sweeps.swept(sweeps.dealt(frames, keys, order), keys, order, __tick=("lag", "tick"), __known=("last_before", "seconds"))
    step = F.pmod(F.col("tick") - F.col("__tick"), F.lit(TICK))
    wraps = F.coalesce(F.rint(((F.col("seconds") - F.col("__known")) * 1000 - step) / TICK), F.lit(0.0)).cast("long")
    rows = rows.withColumn("__step", F.coalesce(step + wraps * TICK, F.col("tick")).cast("long"))
    return sweeps.swept(rows, keys, order, pts_ms=("sum", "__step")).drop("__step", "__tick", "__known", sweeps.PART)


def channel_segments(frames: DataFrame, keys: list[str], step_us: int = 2 * SECOND) -> DataFrame:
    """A recording for each channel and unbroken stretch of a file walked frame by frame.

    Missing bytes end all channels' segments; a channel's own ends where its video time steps back, or forward by more
    than step_us, from the last time it stated."""
    order = ["offset"]
    rows = sweeps.swept(sweeps.dealt(frames, keys, order), keys, order, __end=("lag", F.col("offset") + F.col("length")))
    rows = rows.withColumn("__broken", F.coalesce(F.col("offset") != F.col("__end"), F.lit(False)).cast("int"))
    rows = sweeps.swept(rows, keys, order, __gap=("sum", "__broken")).drop("__end", "__broken", sweeps.PART)
    video = F.col("kind").isin(*VIDEO)
    stated = F.when(video, F.col("local_us"))
    of_channel = [*keys, "__gap", "channel"]
    rows = sweeps.swept(sweeps.dealt(rows, of_channel, order), of_channel, order, __before=("last_before", stated))
    before = F.col("__before")
    steps = F.coalesce(stated.isNotNull() & ((stated < before) | (stated > before + step_us)), F.lit(False))
    rows = sweeps.swept(rows.withColumn("__step", steps.cast("int")), of_channel, order, __segment=("sum", "__step"))
    timed = F.when(stated.isNotNull(), F.col("offset"))
    made = rows.groupBy(*keys, "__gap", "channel", "__segment").agg(
        F.min("offset").alias("offset"), F.sum("length").alias("size_bytes"), F.count_if(video).alias("frame_count"),
        F.min_by("local_us", timed).alias("start_us"), F.max_by("local_us", timed).alias("end_us"),
        F.min_by("kind", F.when(video, F.col("offset"))).alias("first_kind"),
    )
    return made.where("frame_count > 0").drop("__gap", "__segment")


def orphan_checks(entries: DataFrame, frames: DataFrame) -> DataFrame:
    """Freed index entries held against the first frames of the blocks they point at.

    entries: evidence_id, entry_id, channel, start_us, end_us, confidence; frames: evidence_id, entry_id, offset, channel,
    local_us. structure, channel and time are pass, fail or inapplicable; an entry is trusted if something ran and
    nothing failed. Trusted entries are kept as T2, the others become T3 without what the entry said."""
    order = Window.partitionBy("evidence_id", "entry_id").orderBy("offset")
    head = frames.withColumn("at", F.row_number().over(order)).where(F.col("at") <= SAMPLE_FRAMES)
    seen = head.join(entries.select("evidence_id", "entry_id", F.col("start_us").alias("__low"), F.col("end_us").alias("__high")), ["evidence_id", "entry_id"])
    outside = (F.col("local_us") < F.col("__low")) | (F.col("local_us") > F.col("__high"))
    facts = seen.groupBy("evidence_id", "entry_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("channel")).alias("channels"), F.count("local_us").alias("times"), F.count_if(F.coalesce(outside, F.lit(False))).alias("outside")
    )
    e = entries.join(facts, ["evidence_id", "entry_id"], "left")
    parses = F.col("n").isNotNull()
    structure = F.when(parses, "pass").otherwise("fail")
    channel = F.when(parses, F.when((F.size("channels") == 0) | F.col("channel").isNull(), "inapplicable").when(F.col("channels") == F.array("channel"), "pass").otherwise("fail"))
    no_window = F.col("start_us").isNull() & F.col("end_us").isNull()
    time = F.when(parses, F.when((F.col("times") == 0) | no_window, "inapplicable").when(F.col("outside") == 0, "pass").otherwise("fail"))
    e = e.withColumns({"structure_check": structure, "channel_check": channel, "time_check": time})
    checks = F.array_compact(F.array("structure_check", "channel_check", "time_check"))
    trusted = F.exists(checks, lambda c: c != "inapplicable") & ~F.array_contains(checks, "fail")
    kept = lambda c: F.when(F.col("trusted"), F.col(c))
    e = e.withColumn("trusted", trusted)
    return e.select(
        "evidence_id", "entry_id", "structure_check", "channel_check", "time_check", "trusted", F.when(F.col("trusted"), "T2").otherwise("T3").alias("tier"),
        F.when(F.col("trusted"), F.least(F.lit(0.9), F.col("confidence") + 0.2)).otherwise(0.2).alias("confidence"), kept("channel").alias("channel"), kept("start_us").alias("start_us"), kept("end_us").alias("end_us"),
    )
