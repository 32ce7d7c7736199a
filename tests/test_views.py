import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions.scalars import crc32_mpeg2
from tracewell.operators import identify, views
from tracewell.sources import formats


def test_lookups_filter_and_order(spark):
    rec = spark.createDataFrame([("E1", "R2", 1), ("E1", "R1", 1), ("E2", "R0", 1), ("E1", "R3", 2)], "evidence_id string, recording_id string, channel int")
    assert [r.recording_id for r in views.recording_rows(rec, "E1", 1).collect()] == ["R1", "R2"]
    assert [r.recording_id for r in views.recording_rows(rec).collect()] == ["R0", "R1", "R2", "R3"]
    art = spark.createDataFrame([("ab1", "R1", "2"), ("cd2", "R1", "1"), ("ef3", "R2", "0")], "sha256 string, recording_id string, created string")
    assert [(r.sha256, r.path) for r in views.artefact_rows(art, "/case/artifacts", "R1").collect()] == [("cd2", "/case/artifacts/cd/cd2"), ("ab1", "/case/artifacts/ab/ab1")]
    notes = spark.createDataFrame([("R1", "motion", 5, "b"), ("R1", "motion", 5, "a"), ("R1", "user", 1, "z")], "recording_id string, source string, first_frame long, label string")
    assert [r.label for r in views.annotation_rows(notes, "R1", "motion").collect()] == ["a", "b"] and views.annotation_rows(notes, "R1").first().label == "z"
    cov = spark.createDataFrame([("E1", 9), ("E1", 2), ("E2", 1)], "evidence_id string, offset long")
    assert [r.offset for r in views.rows_of(cov, "coverage", "E1").collect()] == [2, 9]
    assert views.evidence_row(cov, "E2").offset == 1 and views.default_evidence_id(cov, "E9") == "E9"
    for wrong in (lambda: views.evidence_row(cov, "E7"), lambda: views.default_evidence_id(cov), lambda: views.default_evidence_id(cov.where("false"))):
        with pytest.raises(LookupError):
            wrong()
    assert views.default_evidence_id(cov.where("evidence_id = 'E1'")) == "E1"


def test_rows_as_json(spark):
    df = spark.createDataFrame([(1, None, bytearray(b"\xab\x01"), [1, 2])], "b int, a string, raw binary, c array<int>")
    assert views.json_lines(df).first().json == '{"a":null,"b":1,"c":[1,2],"raw":"ab01"}'
    gaps = spark.createDataFrame([("E1", 2, 0, 1_500_000, 250_000, "synchronised", "R1", "R2")], "evidence_id string, channel int, gap_start_us long, gap_end_us long, uncertainty_us long, kind string, after_id string, before_id string")
    made = json.loads(views.json_lines(views.gap_view(gaps)).first().json)
    assert made == {"after_recording": "R1", "before_recording": "R2", "channel": 2, "duration_s": 1.5, "end": "1970-01-01T00:00:01.500000", "evidence_id": "E1", "start": "1970-01-01T00:00:00.000000", "synchronised": True, "uncertainty_s": 0.25}


def test_identification_views(spark):
    head = bytearray(4096)
    head[510:512] = b"\x55\xaa"
    seen = identify.observations(spark.createDataFrame([("E1", head)], "evidence_id string, head binary"))
    assert [(r.offset, r.hex, r.description) for r in views.match_view(seen, identify.magic_table(spark)).collect()] == [(510, "55aa", "MBR / boot-sector signature")]
    plan = identify.probe_plan(spark.createDataFrame([("E1", 3000)], "evidence_id string, size long"), windows=2, window=1000)
    made = views.plan_view(plan).first()
    assert tuple(made.lba0) == (0, 512) and tuple(made.head) == (0, 1000) and tuple(made.tail) == (2000, 1000) and [tuple(x) for x in made.sweep] == [(1000, 1000)]
    verdicts = spark.createDataFrame([("pass", "inapplicable", "fail")], "structure_check string, channel_check string, time_check string")
    r = views.orphan_view(verdicts).first()
    assert (r.ran, r.failed, r.explanation) == (["structure", "time"], ["time"], "structure: pass; channel: inapplicable; time: fail")


def test_clock_extents_and_guards(spark):
    rows = spark.createDataFrame([("E1", "A_ntp", 1062.0, 1.0), ("E1", "B", -3661.0, 30.0)], "evidence_id string, method string, offset_s double, uncertainty_s double")
    assert [r.note for r in views.clock_view(rows).orderBy("method").collect()] == [
        "A_ntp: device clock ahead of true time by 00:17:42 (offset +00:17:42) ± 1.0 s", "B: device clock behind true time by 01:01:01 (offset -01:01:01) ± 30.0 s",
    ]
    ext = spark.createDataFrame([([(5, 5), (0, 2), (5, 5)],), ([],)], "e array<struct<offset:bigint,length:bigint>>")
    got = ext.select(views.span(F.col("e")).alias("s"), views.distinct_extents(F.col("e")).alias("d")).collect()
    assert tuple(got[0].s) == (0, 10) and [tuple(x) for x in got[0].d] == [(5, 5), (0, 2)] and got[1].s is None
    tables = spark.createDataFrame([("audit", ["no_update", "no_delete", "more"]), ("other", ["no_update"])], "name string, guards array<string>")
    assert {r.name: r.missing for r in views.guarded(tables, ["no_update", "no_delete"]).collect()} == {"audit": [], "other": ["no_delete"]}


def test_timeline_and_verification(spark):
    lanes = spark.createDataFrame([("E1", 1, 1, "R1", 0, 10, 0.0), ("E1", 1, 2, "R2", 20, 30, 0.0)], "evidence_id string, channel int, position long, recording_id string, start_us long, end_us long, uncertainty_s double")
    gaps = spark.createDataFrame([("E1", 1, "channel", 10, 20), ("E1", None, "synchronised", 10, 20)], "evidence_id string, channel int, kind string, gap_start_us long, gap_end_us long")
    rec = spark.createDataFrame([("E1", "R1", "T1", "h264")], "evidence_id string, recording_id string, tier string, codec string")
    rows = views.timeline_view(lanes, gaps, rec).orderBy("start_us").collect()
    assert [(r.kind, r.start_us, r.recording_id, r.tier) for r in rows] == [("recording", 0, "R1", "T1"), ("gap", 10, None, None), ("recording", 20, "R2", None)]
    ok = spark.createDataFrame([("c", True, []), ("d", True, [])], "case_id string, ok boolean, problems array<string>")
    views.require_verified(ok)
    with pytest.raises(views.VerificationFailed, match="d: manifest changed"):
        views.require_verified(ok.where("case_id = 'c'").unionByName(spark.createDataFrame([("d", False, ["manifest changed"])], ok.schema)))


def test_crc_and_export_layouts(spark):
    def plain(data):
        crc = 0xFFFFFFFF
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        return crc

    values = [b"", b"123456789", bytes(range(256)), None]
    got = [r.c for r in spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in enumerate(values)], "k int, v binary").coalesce(1).select("k", crc32_mpeg2(F.col("v")).alias("c")).orderBy("k").collect()]
    assert got == [plain(v) if v is not None else None for v in values] and got[1] == 0x0376E6E7
    r = formats.export_layouts(spark.createDataFrame([("E1", 0.9, 3, 1)], "evidence_id string, confidence double, members long, others long")).first()
    assert r.notes == ["export files: 3 of frames, 1 other"] and r.index_extents == [] and r.parse_supported
