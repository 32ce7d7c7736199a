"""From carved frames to recordings: hits are grouped to spans, spans cut at unreadable ranges, each piece walked frame by
frame, the walk split to runs, and runs that have a keyframe become recordings in physical order.

Every step is a sweep or a chain over (evidence, offset), so an image that holds most of the frames is dealt to ranges like
any other (see sweeps and chains). The frames of the images are counted once: if no image is hot, no piece of one is, and
frames pass from the walk to the recordings without a further count or table. What is read more than once is staged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import micros, packed_datetime
from ..sources import formats
from ..staging import staged
from . import carving, frames, intervals, sweeps


def pieces_of(hits: DataFrame, holes: DataFrame, max_gap: int = 0, size: tuple[int, int] | None = None) -> DataFrame:
    """evidence_id, start, end, bounded_by: what unreadable ranges (evidence_id, offset, length) leave of the spans that hits
    (evidence_id, offset, length) make, and the ranges within a sector of a piece's ends. size: the hits of the image that
    has most, and all of them, where they are known."""
    spans = carving.group_hits(hits, max_gap, size).drop("members")
    cut = holes.select("evidence_id", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"))
    cut = intervals.islands(cut, ["evidence_id"]).drop("members")
    return intervals.subtract(staged(spans, "spans"), staged(cut, "cut"), ["evidence_id"])  # which reads each several times


def notes(rows: DataFrame) -> DataFrame:
    """Adds notes: what an examiner is told of a carved recording, in a fixed order."""
    text = lambda c: F.col(c).cast("string")
    where = F.array_join(F.transform("bounded_by", lambda h: F.concat_ws("+", h.start.cast("string"), (h.end - h.start).cast("string"))), ", ")
    told = F.array(
        F.concat(F.col("tier"), F.lit(" carve at physical position "), text("position")),
        F.concat(F.lit("ended by: "), F.col("ended")),
        F.concat(F.lit("confidence "), text("confidence"), F.lit(": "), F.col("confidence_note")),
        F.when(F.size("bounded_by") > 0, F.concat(F.lit("bounded by unreadable ranges at "), where, F.lit("; nothing beyond them is claimed"))),
        F.when(F.col("trimmed_bytes") > 0, F.concat(text("trimmed_bytes"), F.lit(" bytes before the first keyframe were left out, as they cannot be decoded alone"))),
        F.when(F.col("start_us").isNull(), "no time could be recovered: placed in physical order only"),
        F.when(F.col("channel").isNull(), "no channel could be recovered"),
    )
    return rows.withColumn("notes", F.array_compact(told))


def reassembled(chunks: DataFrame, holes: DataFrame, chunk: int = carving.CHUNK, max_gap: int = 0) -> DataFrame:
    """Recordings carved from image windows (evidence_id, offset, bytes), with the columns of frames.carved_recordings,
    bounded_by and notes. Tier T4 where the image has unreadable ranges (holes: evidence_id, offset, length), else T3.

    The windows are read once. A frame's bytes may look like frames too: what lies inside a frame is never one of its
    piece, but where an unreadable range takes the outer frame, those inside it are found."""
    holes = staged(holes.select("evidence_id", "offset", "length"), "holes")
    found = formats.frame_candidates(chunks, chunk)
    found = found.select("evidence_id", "offset", "length", "kind", "channel", "sequence", "date", "codec")  # what travels
    size = sweeps.counted(found, ["evidence_id"])
    whole = size[0] <= sweeps.HOT
    pieces = staged(pieces_of(found, holes, max_gap, size), "pieces")
    walked = formats.walked(found, pieces, size)
    walked = sweeps.shared_out(walked, ["evidence_id"], size[1]) if whole else staged(walked, "walked")
    walked = formats.with_codec(walked, ("evidence_id", "piece"), whole)
    rows = walked.withColumns({"local_us": micros(packed_datetime(F.col("date"))), "codec": F.col("codec_hint"), "span_id": F.col("piece")})
    rows = rows.select("evidence_id", "span_id", "offset", "length", "kind", "channel", "local_us", "sequence", "codec")
    runs = frames.runs(rows, whole) if whole else staged(frames.runs(staged(rows, "hinted")), "runs")
    kept = runs.join(pieces.select("evidence_id", F.col("start").alias("span_id"), "bounded_by"), ["evidence_id", "span_id"])
    cut = holes.select("evidence_id").distinct().withColumn("__cut", F.lit("T4"))
    kept = kept.join(cut, "evidence_id", "left").withColumn("tier", F.coalesce("__cut", F.lit("T3")))
    keys, order = ["evidence_id"], ["offset", "run"]
    kept = kept.withColumn("__one", F.lit(1))
    kept = sweeps.swept(kept if whole else sweeps.dealt(kept, keys, order), keys, order, position=("sum", "__one"))
    what = [F.col(c) for c in ("frame_count", "channel", "start_us", "keyframes")]
    made = kept.withColumns({"confidence": frames.confidence(*what), "confidence_note": frames.confidence_note(*what)})
    return notes(made).select(
        "evidence_id", "position", "tier", "offset", "length", "channel", "codec", "start_us", "end_us", "frame_count", "keyframes",
        "confidence", "confidence_note", "trimmed_bytes", "ended", "bounded_by", "notes",
    )
