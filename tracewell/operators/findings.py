"""Derived findings: what an examination could not establish, as a union of rules over the case's tables.

Tables: evidence (evidence_id, provenance_class, gaps: array of offset and length, notes), identification (evidence_id,
family, status, parse_supported), recording (evidence_id, recording_id, channel, local_start_us, t_method, tier,
ref_start_us), coverage (evidence_id, bucket, length), custody (evidence_id, seq, from_holder, to_holder, seal_intact),
attachment (evidence_id, null for the whole case, kind), anomaly (see anomalies.detect).

A finding has evidence_id, code, severity, and n: the number behind it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("serious", "attention", "info")
UNACCOUNTED_ATTENTION = 0.25
#: Documents each provenance class is expected to come with, and how much each class limits.
EXPECTED = {"A": ["panchnama", "seizure_video", "authorisation"], "B": ["panchnama", "seizure_video", "authorisation"], "C": ["panchnama", "authorisation"], "D": ["authorisation"]}
PROVENANCE_SEVERITY = {"B": "attention", "C": "attention", "D": "serious"}


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _rules(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """evidence_id, code, severity, n of every rule (condition, code, severity, n) that holds for a row; one pass of df."""
    told = [F.when(holds, F.struct(_column(code).alias("code"), _column(severity).alias("severity"), _column(n).cast("long").alias("n"))) for holds, code, severity, n in rules]
    return df.select("evidence_id", F.inline(F.array_compact(F.array(*told))))


def _coverage_sums(coverage: DataFrame) -> DataFrame:
    of = lambda b: F.sum(F.when(F.col("bucket") == b, F.col("length")).otherwise(0))
    return coverage.groupBy("evidence_id").agg(F.sum("length").alias("covered"), of("unaccounted").alias("lost"), of("unreadable").alias("bad"))


def _coverage_rules() -> list[tuple]:
    level = F.when(F.col("lost") >= UNACCOUNTED_ATTENTION * F.col("covered"), "attention").otherwise("info")
    return [(F.col("lost") > 0, "NF-COVERAGE-UNACCOUNTED", level, F.col("lost")), (F.col("bad") > 0, "NF-COVERAGE-UNREADABLE", "serious", F.col("bad"))]


def coverage_findings(coverage: DataFrame) -> DataFrame:
    return _rules(_coverage_sums(coverage), _coverage_rules())


def acquisition_findings(evidence: DataFrame) -> DataFrame:
    severity = F.try_element_at(F.create_map(*[F.lit(x) for kv in PROVENANCE_SEVERITY.items() for x in kv]), F.col("provenance_class"))
    gaps = F.size(F.coalesce("gaps", F.array().cast(evidence.schema["gaps"].dataType)))
    return _rules(
        evidence,
        [
            (F.col("provenance_class").isin(*PROVENANCE_SEVERITY), F.concat(F.lit("NF-PROVENANCE-"), F.col("provenance_class")), severity, 1),
            (gaps > 0, "NF-BAD-SECTORS", "serious", gaps),
            (F.upper("notes").contains("MISMATCH"), "NF-EMBEDDED-HASH", "serious", 1),
        ],
    )


def identification_findings(evidence: DataFrame, identification: DataFrame) -> DataFrame:
    missing = evidence.select("evidence_id").join(identification.select("evidence_id"), "evidence_id", "left_anti")
    unknown = (F.col("status") == "unknown") | F.col("family").isNull()
    parses = F.coalesce(F.col("parse_supported"), F.lit(False))
    known = [(unknown, "NF-UNKNOWN-FORMAT", "attention", 1), (~unknown & ~parses, "NF-CARVE-ONLY", "attention", 1), (F.col("status") == "ambiguous", "NF-AMBIGUOUS", "attention", 1)]
    return _rules(missing, [(F.lit(True), "NF-NOT-IDENTIFIED", "attention", 1)]).unionByName(_rules(identification, known))


def _recording_sums(recording: DataFrame) -> DataFrame:
    return recording.groupBy("evidence_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("local_start_us").isNull()).alias("no_time"), F.count_if(F.col("channel").isNull()).alias("no_channel"),
        F.count_if(F.coalesce("t_method", F.lit("none")) == "none").alias("no_offset"),
    )


def _recording_rules() -> list[tuple]:
    return [
        (F.col("no_time") > 0, "NF-TIME-UNKNOWN", "attention", F.col("no_time")),
        (F.col("no_channel") > 0, "NF-CHANNEL-UNKNOWN", "info", F.col("no_channel")),
        (F.col("no_offset") == F.col("total"), "NF-NO-CLOCK-OFFSET", "serious", F.col("no_offset")),
    ]


def recording_findings(recording: DataFrame) -> DataFrame:
    return _rules(_recording_sums(recording), _recording_rules())


def _process_rules() -> list[tuple]:
    """Evidence with recordings of which no recovery ever made a coverage map."""
    return [(F.col("total").isNotNull() & F.col("covered").isNull(), "NF-NO-RECOVERY", "attention", 1)]


def process_findings(recording: DataFrame, coverage: DataFrame) -> DataFrame:
    return _rules(_recording_sums(recording).join(_coverage_sums(coverage), "evidence_id", "left"), _process_rules())


def result_findings(recording: DataFrame, coverage: DataFrame) -> DataFrame:
    """The findings on coverage, recordings and process together: each table is added up once."""
    return _rules(_recording_sums(recording).join(_coverage_sums(coverage), "evidence_id", "full"), [*_coverage_rules(), *_recording_rules(), *_process_rules()])


def custody_breaks(custody: DataFrame) -> DataFrame:
    """evidence_id, seq, expected, found: transfers released by another holder than the last one received by.

    Names are compared without case and outer white space of any kind."""
    rows = _handed_on(custody).where(_name("expected") != _name("from_holder"))
    return rows.select("evidence_id", "seq", "expected", F.col("from_holder").alias("found"))


def _name(column: str) -> Column:
    return F.lower(F.regexp_replace(column, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def _handed_on(custody: DataFrame) -> DataFrame:
    return custody.withColumn("expected", F.lag("to_holder").over(Window.partitionBy("evidence_id").orderBy("seq")))


def missing_documents(evidence: DataFrame, attachment: DataFrame) -> DataFrame:
    """evidence_id, missing: expected kinds held neither for the item nor for the whole case."""
    wide = attachment.where("evidence_id is null").agg(F.collect_set("kind").alias("wide"))  # kinds: a short fixed list
    own = attachment.where("evidence_id is not null").groupBy("evidence_id").agg(F.collect_set("kind").alias("own"))
    expected = F.create_map(*[x for k, v in EXPECTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = evidence.join(own, "evidence_id", "left").crossJoin(F.broadcast(wide))  # wide is one row
    held = F.array_union(F.coalesce("own", F.array().cast("array<string>")), "wide")
    want = F.coalesce(F.try_element_at(expected, F.upper(F.trim("provenance_class"))), F.array().cast("array<string>"))
    return rows.select("evidence_id", F.array_sort(F.array_except(want, held)).alias("missing")).where(F.size("missing") > 0)


def custody_findings(evidence: DataFrame, custody: DataFrame, attachment: DataFrame) -> DataFrame:
    breaks = F.coalesce(_name("expected") != _name("from_holder"), F.lit(False))
    sums = _handed_on(custody).groupBy("evidence_id").agg(
        F.count_if(F.col("seal_intact") == 0).alias("broken"), F.count_if(F.col("seal_intact").isNull()).alias("unsealed"), F.count_if(breaks).alias("gaps")
    )
    held = [
        (F.col("broken").isNull(), "NF-NO-CUSTODY", "serious", 1),
        (F.col("broken") > 0, "NF-SEAL-BROKEN", "serious", F.col("broken")),
        (F.col("unsealed") > 0, "NF-NO-SEAL", "attention", F.col("unsealed")),
        (F.col("gaps") > 0, "NF-CUSTODY-GAP", "serious", F.col("gaps")),
    ]
    found = _rules(evidence.select("evidence_id").join(sums, "evidence_id", "left"), held)
    return found.unionByName(_rules(missing_documents(evidence, attachment), [(F.lit(True), "NF-MISSING-DOCUMENTS", "attention", F.size("missing"))]))


def anomaly_findings(anomaly: DataFrame) -> DataFrame:
    code = F.concat(F.lit("NF-TIME-"), F.upper(F.translate("kind", "_", "-")))
    return _rules(anomaly, [(F.lit(True), code, "attention", F.col("count"))])


def negative_findings(evidence, identification, recording, coverage, custody, attachment, anomaly) -> DataFrame:
    """Every rule's findings, ordered by severity, code and evidence."""
    rules = [
        acquisition_findings(evidence), identification_findings(evidence, identification), result_findings(recording, coverage),
        custody_findings(evidence, custody, attachment), anomaly_findings(anomaly),
    ]
    found = reduce(DataFrame.unionByName, rules)
    return found.orderBy(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), "code", "evidence_id", "n")


def severity_summary(findings: DataFrame) -> DataFrame:
    """One row: total and the count of each severity, zeros present."""
    return findings.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def case_progress(evidence, identification, recording, layouts, observations, custody, recoveries) -> DataFrame:
    """evidence_id and how far each item has come: support, parsed, observations, transfers, recovery, recordings by tier."""
    from .identify import support

    per = lambda df, name: df.groupBy("evidence_id").agg(F.count(F.lit(1)).alias(name))
    tiers = recording.groupBy("evidence_id").agg(
        F.count(F.lit(1)).alias("recordings"), *[F.count_if(F.col("tier") == t).alias(t.lower()) for t in ("T1", "T2", "T3", "T4")],
        F.count("local_start_us").alias("with_device_time"), F.count("ref_start_us").alias("with_reference_time"),
    )
    known = identification.select("evidence_id", "status", "family", support(F.col("status"), F.col("family"), F.coalesce(F.col("parse_supported"), F.lit(False))).alias("support"))
    rows = evidence.select("evidence_id").join(known, "evidence_id", "left").join(tiers, "evidence_id", "left")
    for df, name in ((layouts, "layouts"), (observations, "time_observations"), (custody, "custody_entries"), (recoveries, "recoveries")):
        rows = rows.join(per(df, name), "evidence_id", "left")
    counts = ["recordings", "t1", "t2", "t3", "t4", "with_device_time", "with_reference_time", "time_observations", "custody_entries", "layouts", "recoveries"]
    rows = rows.na.fill(0, counts)
    return rows.withColumns({"parsed": F.col("layouts") > 0, "recovered": F.col("recoveries") > 0}).drop("layouts", "recoveries")


def recovery_gain(recordings: DataFrame, **more: Column) -> DataFrame:
    """evidence_id, t1_minutes, recovered_minutes, gain_pct: T2 to T4 against T1; unknown or inverted times count 0. `more`:
    what else is added up on the way."""
    micros = F.greatest(F.coalesce(F.col("local_end_us") - F.col("local_start_us"), F.lit(0)), F.lit(0))
    of = lambda cond: F.sum(F.when(cond, micros).otherwise(0)) / 60e6  # noqa: E731  whole numbers are summed
    sums = recordings.groupBy("evidence_id").agg(of(F.col("tier") == "T1").alias("t1_minutes"), of(F.col("tier") != "T1").alias("recovered_minutes"), *[c.alias(n) for n, c in more.items()])
    return sums.withColumn("gain_pct", F.when(F.col("t1_minutes") > 0, F.round(100 * F.col("recovered_minutes") / F.col("t1_minutes"), 1)))


def findings_document(sections: dict[str, DataFrame]) -> DataFrame:
    """One row for each evidence: document, the canonical JSON of its rows of every section (each in a total order), and
    digest, its SHA-256. Sections have evidence_id."""
    from .integrity import canonical_json

    rows = None
    for name, df in sorted(sections.items()):
        columns = [c for c in df.columns if c != "evidence_id"]
        one = df.groupBy("evidence_id").agg(F.array_sort(F.collect_list(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))).alias(name))
        rows = one if rows is None else rows.join(one, "evidence_id", "full")
    text = lambda c: F.concat(F.lit(f'"{c}":['), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ","), F.lit("]"))
    whole = F.concat(F.lit("{"), F.concat_ws(",", *map(text, sorted(sections))), F.lit("}"))
    made = rows.select("evidence_id", canonical_json(whole).alias("document"))
    return made.withColumn("digest", F.sha2("document", 256))


#: The sections that follow from the evidence and the analysis alone, so that two examinations can be compared by them.
CONCLUSIONS = ("identification", "disk_layout", "coverage", "recordings", "time", "device_events", "negative_findings")


def conclusions_digest(sections: dict[str, DataFrame]) -> DataFrame:
    """evidence_id, conclusions_digest: SHA-256 of the findings document of the concluding sections alone. What tells of the
    examination itself (custody, artefacts, the audit chain, when it ran) changes nothing here."""
    made = findings_document({name: sections[name] for name in CONCLUSIONS if name in sections})
    return made.select("evidence_id", F.sha2(F.concat("document", F.lit("\n")), 256).alias("conclusions_digest"))
