"""What a user looks up and prints: rows of case tables in their order, and the same as JSON.

Filters are Spark's own and reach the scan; an order is part of a look-up, so a caller that wants none drops it. JSON is one
canonical line for each row (keys sorted, no spaces), made from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .integrity import canonical_json


def json_lines(rows: DataFrame) -> DataFrame:
    """json: each row as canonical JSON, nulls present and binary values in hex."""
    shown = [F.lower(F.hex(f.name)).alias(f.name) if f.dataType.simpleString() == "binary" else F.col(f.name) for f in rows.schema]
    return rows.select(canonical_json(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})).alias("json"))


def _asked(rows: DataFrame, **wanted: object) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def recording_rows(recording: DataFrame, evidence_id: str | None = None, channel: int | None = None) -> DataFrame:
    return _asked(recording, evidence_id=evidence_id, channel=channel).orderBy("recording_id")


def artefact_rows(artefact: DataFrame, folder: str, recording_id: str | None = None) -> DataFrame:
    """Artefacts, oldest first, each with the place of its file in the case."""
    place = F.concat(F.lit(f"{folder}/"), F.substring("sha256", 1, 2), F.lit("/"), F.col("sha256"))
    return _asked(artefact, recording_id=recording_id).withColumn("path", place).orderBy("created", "sha256")


def annotation_rows(annotation: DataFrame, recording_id: str, source: str | None = None) -> DataFrame:
    return _asked(annotation, recording_id=recording_id, source=source).orderBy("first_frame", "label")


#: What each table's rows of one evidence are ordered by.
ORDERS = {"coverage": ["offset"], "time_observation": ["valid_from_us", "method"], "custody": ["seq"], "attachment": ["kind", "attachment_id"], "disk_layout": [], "identification": [], "evidence": []}


def rows_of(table: DataFrame, name: str, evidence_id: str) -> DataFrame:
    """An evidence's rows of a case table, in that table's order."""
    return _asked(table, evidence_id=evidence_id).orderBy(*ORDERS[name]) if ORDERS[name] else _asked(table, evidence_id=evidence_id)


def evidence_row(evidence: DataFrame, evidence_id: str):
    """The row of one item; an item that is not there raises."""
    found = _asked(evidence, evidence_id=evidence_id).take(2)
    if len(found) != 1:
        raise LookupError(f"no evidence {evidence_id}" if not found else f"{evidence_id} is there more than once")
    return found[0]


def default_evidence_id(evidence: DataFrame, given: str | None = None) -> str:
    """The item given, or the only one of the case; none or several raise."""
    if given:
        return given
    found = evidence.select("evidence_id").distinct().take(2)
    if len(found) != 1:
        raise LookupError("say which evidence is meant" if found else "the case has no evidence")
    return found[0].evidence_id


def gap_view(gaps: DataFrame) -> DataFrame:
    """Gaps with device or reference times as ISO text, duration_s, uncertainty_s and whether they are synchronised."""
    text = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return gaps.select(
        "evidence_id", "channel", text("gap_start_us").alias("start"), text("gap_end_us").alias("end"), ((F.col("gap_end_us") - F.col("gap_start_us")) / 1e6).alias("duration_s"),
        (F.col("uncertainty_us") / 1e6).alias("uncertainty_s"), (F.col("kind") == "synchronised").alias("synchronised"), F.col("after_id").alias("after_recording"), F.col("before_id").alias("before_recording"),
    )


def match_view(observations: DataFrame, magics: DataFrame) -> DataFrame:
    """Signatures that stand in an image's head: evidence_id, offset, hex, description."""
    known = magics.select("offset", "description", F.lower("magic").alias("hex"))
    return observations.join(F.broadcast(known), ["offset", "description"]).select("evidence_id", "offset", "hex", "description")  # a table of eight rows


def plan_view(plan: DataFrame) -> DataFrame:
    """A probe plan (evidence_id, region, offset, length) as one row an image: lba0, head, tail, and the sweep in order."""
    extent = F.struct("offset", "length")
    one = lambda name: F.max(F.when(F.col("region") == name, extent)).alias(name)
    sweep = F.array_sort(F.array_compact(F.collect_list(F.when(F.col("region") == "sweep", extent))))
    return plan.groupBy("evidence_id").agg(one("lba0"), one("head"), one("tail"), sweep.alias("sweep"))


def orphan_view(verdicts: DataFrame) -> DataFrame:
    """Verdicts of frames.orphan_checks with ran, failed (names of checks) and explanation."""
    names = ("structure", "channel", "time")
    checks = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}_check").alias("result")) for n in names])
    named = lambda keep: F.transform(F.filter(checks, keep), lambda c: c["name"])
    said = F.array_join(F.transform(checks, lambda c: F.concat_ws(": ", c["name"], c.result)), "; ")
    return verdicts.withColumns({"ran": named(lambda c: c.result != "inapplicable"), "failed": named(lambda c: c.result == "fail"), "explanation": said})


def offset_text(seconds: Column) -> Column:
    """Seconds as +HH:MM:SS, or with - where below 0."""
    whole = F.abs(F.rint(seconds)).cast("long")
    part = lambda n: F.lpad(n.cast("string"), 2, "0")
    clock = F.concat_ws(":", part(F.floor(whole / 3600)), part(F.floor(whole / 60) % 60), part(whole % 60))
    return F.concat(F.when(seconds < 0, "-").otherwise("+"), clock)


def clock_view(segments: DataFrame) -> DataFrame:
    """Clock segments (evidence_id, method, offset_s, uncertainty_s, ...) with a sentence that says what they mean."""
    ahead = F.when(F.col("offset_s") >= 0, "ahead of").otherwise("behind")
    text = offset_text(F.col("offset_s"))
    said = F.concat(F.col("method"), F.lit(": device clock "), ahead, F.lit(" true time by "), F.substring(text, 2, 99), F.lit(" (offset "), text, F.lit(") ± "), F.format_string("%s s", F.col("uncertainty_s").cast("string")))
    return segments.withColumn("note", said)


def span(extents: Column) -> Column:
    """From the first byte of a recording's extents to behind its last; null without extents."""
    return F.when(F.size(extents) > 0, F.struct(F.array_min(F.transform(extents, lambda e: e.offset)).alias("start"), F.array_max(F.transform(extents, lambda e: e.offset + e.length)).alias("end")))


def distinct_extents(extents: Column) -> Column:
    """Extents without repeats, the first of each where it stands."""
    return F.array_distinct(extents)


def guarded(tables: DataFrame, needed: list[str]) -> DataFrame:
    """Adds missing: what of a list each row's guards (an array) do not have; empty where the list is a subset."""
    return tables.withColumn("missing", F.array_except(F.array(*map(F.lit, needed)), "guards"))


def timeline_view(lanes: DataFrame, gaps: DataFrame, recordings: DataFrame) -> DataFrame:
    """evidence_id, channel, position, kind (recording or gap), start_us, end_us, recording_id, tier, codec: a lane's recordings
    with what is known of them, and its channel's gaps, in order of time."""
    drawn = lanes.join(recordings.select("evidence_id", "recording_id", "tier", "codec"), ["evidence_id", "recording_id"], "left")
    rows = drawn.select("evidence_id", "channel", F.lit("recording").alias("kind"), "start_us", "end_us", "recording_id", "tier", "codec")
    between = gaps.where("kind = 'channel'").select("evidence_id", "channel", F.lit("gap").alias("kind"), F.col("gap_start_us").alias("start_us"), F.col("gap_end_us").alias("end_us"))
    return rows.unionByName(between, allowMissingColumns=True)


class VerificationFailed(Exception):
    """A case does not verify; the message names the problems."""


def require_verified(verified: DataFrame) -> None:
    """Raise unless every case of integrity.case_verified is in order (what a command's exit status says)."""
    bad = verified.where("not ok").select("case_id", "problems").take(20)
    if bad:
        raise VerificationFailed("; ".join(f"{r.case_id}: {', '.join(map(str, r.problems))}" for r in bad))
