"""Certificates and attachments: which artefacts are tendered, which are withheld and why, and what a case still lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of artefact a certificate speaks to, kinds of attachment and their statutory hooks, the date from
#: which proceedings take the newer certificate, and who may state how a record came about.
TENDERED_KINDS = ["evidence_copy", "derivative", "findings", "report"]
ATTACHMENT_KINDS = ["panchnama", "seizure_video", "authorisation", "seizure_form", "custody_form", "acquisition_form", "photograph", "correspondence", "other"]
STATUTES = {
    "panchnama": "BNSS 2023 s. 103 (search and seizure memo)",
    "seizure_video": "BNSS 2023 s. 105 (mandatory audio-video recording of seizure)",
    "authorisation": "BNSS 2023 s. 94 / s. 185 (authorisation to search and seize)",
}
CHANGE_OF_STATUTE = "2024-07-01"
#: Sources and ways of control that the form lists, and the labels of a disk's particulars.
SOURCE_TYPES = ["Computer / Storage Media", "DVR", "Mobile", "Flash Drive", "CD/DVD", "Server", "Cloud", "Other"]
CONTROL_MODES = ["Owned", "Maintained", "Managed", "Operated"]
DISK_LABELS = {"disk_make": "Disk make", "disk_model": "Disk model", "disk_serial": "Disk serial", "capacity_bytes": "Capacity (bytes)", "provenance_class": "Provenance class"}


def statute_for(instituted: Column) -> Column:
    """BSA_63 for proceedings from the change on, or of unknown date; IEA_65B for older ones."""
    return F.when(instituted < F.lit(CHANGE_OF_STATUTE).cast("date"), "IEA_65B").otherwise("BSA_63")


def attached(attachments: DataFrame) -> DataFrame:
    """Attachments (kind, content, ...) with sha256 and statute; a kind that is not known raises."""
    known = F.when(F.col("kind").isin(*ATTACHMENT_KINDS), F.col("kind")).otherwise(F.raise_error("unknown kind of attachment").cast("string"))
    hooks = F.create_map(*[F.lit(x) for kv in STATUTES.items() for x in kv])
    return attachments.withColumn("kind", known).withColumns({"sha256": F.sha2("content", 256), "statute": F.try_element_at(hooks, F.col("kind"))})


def tender_rows(artefacts: DataFrame, files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """artefact, kind, size_bytes, md5, sha1, sha256, note: every artefact of the kinds, hashed anew.

    One whose file is missing or has changed is disclosed as withheld, without digests. artefacts: sha256, path, kind,
    size_bytes as recorded; files: path, content as found."""
    rows = artefacts.where(F.col("kind").isin(*(kinds or TENDERED_KINDS)))
    found = files.select("path", F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("m"), F.sha1("content").alias("s1"), F.sha2("content", 256).alias("s2"))
    both = rows.join(found, "path", "left")
    same = F.coalesce(F.col("s2") == F.col("sha256"), F.lit(False))
    note = F.when(F.col("s2").isNull(), "withheld: the file is not in the store").when(~same, "withheld: the file has changed since it was recorded").otherwise("")
    digest = lambda c: F.when(same, F.col(c)).otherwise("")
    return both.select(
        F.coalesce("path", "sha256").alias("artefact"), F.when(same, F.col("kind")).otherwise(F.concat(F.lit("WITHHELD - "), F.col("kind"))).alias("kind"),
        F.when(same, F.col("size")).otherwise(F.col("size_bytes")).alias("size_bytes"), digest("m").alias("md5"), digest("s1").alias("sha1"), digest("s2").alias("sha256"), note.alias("note"),
    )


def tendered(rows: DataFrame) -> DataFrame:
    return rows.where("sha256 != ''")


def withheld(rows: DataFrame) -> DataFrame:
    return rows.where("sha256 = ''")


def open_steps(progress: DataFrame) -> DataFrame:
    """evidence_id, weight, step: what keeps each item from being complete, worst first; nothing else is asked of an item
    before it is identified. progress: as findings.case_progress gives it."""
    known = F.coalesce(F.col("status") == "identified", F.lit(False))
    step = lambda cond, weight, name: F.when(cond, F.struct(F.lit(weight).alias("weight"), F.lit(name).alias("step")))
    steps = F.array(
        step(~known, "blocking", "identify"),
        step(known & (F.col("support") == "parse") & ~F.col("parsed"), "blocking", "parse"),
        step(known & ~F.col("recovered"), "serious", "recover"),
        step(known & (F.col("time_observations") == 0) & (F.col("recordings") > 0), "serious", "time"),
        step(known & (F.col("custody_entries") == 0), "serious", "custody"),
    )
    return progress.select("evidence_id", F.explode(F.array_compact(steps)).alias("s")).select("evidence_id", "s.weight", "s.step")


def stated_timezones(observations: DataFrame) -> DataFrame:
    """evidence_id, tz_offset_s: the one timezone stated for each item (null if none); two that differ raise."""
    grouped = observations.groupBy("evidence_id").agg(F.min("tz_offset_s").alias("low"), F.max("tz_offset_s").alias("high"))
    one = F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("low").isNotNull(), F.raise_error("conflicting stated timezones").cast("int"))
    return grouped.select("evidence_id", one.alias("tz_offset_s"))


def form_problems(forms: DataFrame) -> DataFrame:
    """forms with problems: values that the form does not list, and a submission's number below 1.

    forms: source_type, control_modes (array), instance."""
    odd = F.array_except(F.coalesce("control_modes", F.array().cast("array<string>")), F.array(*map(F.lit, CONTROL_MODES)))
    found = F.array(
        F.when(~F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), F.lit(False)), "the form has no such source"),
        F.when(F.size(odd) > 0, F.concat(F.lit("the form has no such control: "), F.array_join(odd, ", "))),
        F.when(F.coalesce(F.col("instance") < 1, F.lit(True)), "submissions are numbered from 1"),
    )
    return forms.withColumn("problems", F.array_compact(found))


def ticked(md5: Column, sha1: Column, sha256: Column) -> Column:
    """The algorithms of the form for which a digest is there."""
    return F.array_compact(F.array(*[F.when(c != "", n) for n, c in (("SHA1", sha1), ("SHA256", sha256), ("MD5", md5))]))


def enclosures(evidence: DataFrame, tenders: DataFrame) -> DataFrame:
    """case_id, artefact, kind, size_bytes, md5, sha1, sha256, note: each image by its stored digests (no SHA-1 was taken of
    it), with the case's tender rows (case_id and the columns of tender_rows)."""
    stored = lambda c: F.coalesce(c, F.lit("")).alias(c)
    images = evidence.select(
        "case_id", F.coalesce("source_path", "evidence_id").alias("artefact"), F.lit("evidence_image").alias("kind"), F.col("capacity_bytes").alias("size_bytes"),
        stored("md5"), F.lit("").alias("sha1"), stored("sha256"), F.lit("").alias("note"),
    )
    return images.unionByName(tenders.select(*images.columns))


def certificates(evidence: DataFrame, enclosure: DataFrame, recordings: DataFrame) -> DataFrame:
    """A certificate for each item, with what was measured; who affirms it stays open.

    evidence: case_id, evidence_id, instance, instituted, md5, sha256 and the disk's particulars; enclosure: as above;
    recordings: evidence_id, channel. Gives case_id, evidence_id, statute, ticked, tendered, withheld, recordings, channels,
    disk. Counts of the enclosure are the case's; an image without a digest counts as withheld there."""
    items = enclosure.groupBy("case_id").agg(F.count_if(F.col("sha256") != "").alias("tendered"), F.count_if(F.col("sha256") == "").alias("withheld"))
    counts = recordings.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("recordings"), F.countDistinct("channel").alias("channels"))
    rows = evidence.join(items, "case_id", "left").join(counts, "evidence_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    disk = F.concat_ws("; ", *[F.when(~F.col(c).cast("string").isin("", "0"), F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))) for c, label in DISK_LABELS.items()])
    return rows.select(
        "case_id", "evidence_id", statute_for(F.col("instituted")).alias("statute"), ticked(F.col("md5"), F.lit(""), F.col("sha256")).alias("ticked"),
        zero("tendered"), zero("withheld"), zero("recordings"), zero("channels"), disk.alias("disk"),
    )
