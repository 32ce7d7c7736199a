import random

import pytest

from tracewell.operators import findings, flows, intervals, timeline

S = 1_000_000
OBS = "evidence_id long, method string, device_local_us long, true_utc_us long, uncertainty_s double, valid_from_us long, valid_to_us long"
REC = "evidence_id long, recording_id long, channel int, local_start_us long, local_end_us long"


@pytest.mark.parametrize("clocks", [100_000, 0])
def test_times_are_normalised_alike_with_few_and_many_clocks(spark, monkeypatch, clocks):
    monkeypatch.setattr(timeline, "CLOCKS", clocks)
    rng = random.Random(6)
    obs, want, recs = [], {}, []
    for e in range(6):
        edges = sorted(rng.sample(range(0, 1000, 10), 4)) if e else []
        for k, (low, high) in enumerate(zip(edges, edges[1:])):
            if rng.random() < 0.8:
                obs.append((e, "A_ntp", (e * 7 + k) * S, 0, 1.0 + k, low * S, high * S))
    at = lambda e, v: next(((o[2], o[4]) for o in obs if v is not None and o[0] == e and o[5] <= v < o[6]), None)
    for i in range(300):
        e = rng.randrange(7)
        a, b = (rng.choice([None, rng.randrange(0, 1000) * S]) for _ in range(2))
        recs.append((e, i, rng.choice([None, 1, 2]), a, b))
        x, y = at(e, a), at(e, b)
        want[i] = (None if x is None else a - x[0], None if y is None else b - y[0], max(x[1], y[1]) if x and y else None, "A_ntp" if x and y else "none")
    df = spark.createDataFrame(recs, REC)
    observed = spark.createDataFrame(obs, OBS)
    every, made, summary = flows.set_offset(observed.limit(0), observed, df)
    assert {r.recording_id: (r.ref_start_us, r.ref_end_us, r.uncertainty_s, r.t_method) for r in made.collect()} == want
    assert {r.evidence_id: (r.normalised, r.refused) for r in summary.collect()} == {e: (sum(want[i][3] != "none" for x, i, *_ in recs if x == e), sum(want[i][3] == "none" for x, i, *_ in recs if x == e)) for e in range(7)}
    lanes, unplaced = flows.timeline_data(df, timeline.clock_segments(every))
    placed = {i for i, (a, b, *_) in want.items() if a is not None and b is not None and a <= b}
    assert {r.recording_id for r in lanes.collect()} == placed
    assert {r.recording_id for r in unplaced.collect()} == set(want) - placed
    with pytest.raises(Exception, match="overlap"):
        flows.set_offset(observed, observed, df)[2].collect()


def test_gaps_are_on_reference_time_where_there_is_one(spark):
    rows = [(1, 1, 1, 0, 10 * S, 0, 10 * S, 1.0), (1, 2, 1, 50 * S, 60 * S, 50 * S, 60 * S, 2.0), (1, 3, 1, 5 * S, 6 * S, None, None, None), (2, 4, None, 0, 10 * S, None, None, None), (2, 5, None, 30 * S, 40 * S, None, None, None), (2, 6, 1, 9 * S, 8 * S, None, None, None)]
    df = spark.createDataFrame(rows, REC + ", ref_start_us long, ref_end_us long, uncertainty_s double")
    gaps, off = flows.gap_report(df)
    assert sorted((r.evidence_id, r.basis, r.kind, r.gap_start_us // S, r.gap_end_us // S) for r in gaps.collect()) == [(1, "reference", "channel", 11, 48), (2, "device", "channel", 10, 30)]
    assert {r.recording_id: r.reason for r in off.collect()} == {3: "no reference time on this recording", 6: "end is before start"}


def test_parse_and_recovery_of_a_small_case(spark):
    ext = "extents array<struct<offset:bigint,length:bigint>>"
    layouts = spark.createDataFrame([(1, True, [(0, 50)]), (2, False, []), (3, True, [])], "evidence_id long, parse_supported boolean, index_extents array<struct<offset:bigint,length:bigint>>")
    stated = spark.createDataFrame([(e, t, c) for e in (1, 2, 3) for t, c in (("T1", 2), ("T1", None), ("T2", 1), ("T1", 1))], "evidence_id long, tier string, channel int")
    fresh, summary = flows.parsed(layouts, stated, spark.createDataFrame([(3,)], "evidence_id long"))
    assert fresh.count() == 3 and [(r.evidence_id, r.recordings, r.channels) for r in summary.collect()] == [(1, 3, [1, 2])]
    kind = f"evidence_id long, recording_id long, tier string, {ext}, note string, local_start_us long, local_end_us long"
    existing = spark.createDataFrame([(1, 1, "T1", [(100, 100)], "a", 0, 120 * S)], kind)
    found = spark.createDataFrame([(1, 2, "T3", [(150, 100)], "b", 0, 60 * S), (1, 3, "T2", [(300, 50)], "c", 0, 60 * S), (1, 4, "T3", [(400, 10)], "d", None, None), (1, 5, "odd", [(300, 60)], "e", 0, 600 * S)], kind)
    made = flows.recovered(spark.createDataFrame([(1, 1000), (9, 10)], "evidence_id long, size long"), layouts.select("evidence_id", "index_extents"), existing, found, spark.createDataFrame([(1, 900, 100)], "evidence_id long, offset long, length long"))
    assert {r.recording_id for r in made["fresh"].collect()} == {3, 4}
    totals = {(r.evidence_id, r.bucket): r.bytes for r in made["totals"].collect()}
    assert totals == {(1, "structural"): 50, (1, "parsed"): 150, (1, "carved"): 10, (1, "unreadable"): 100, (1, "unaccounted"): 690, **{(9, b): 10 * (b == "unaccounted") for b in intervals.BUCKETS}}
    rows = {r.evidence_id: (r.added, r.duplicates_merged, r.items_without_time, r.t1_minutes, r.recovered_minutes, r.gain_pct) for r in made["summary"].collect()}
    assert rows == {1: (2, 2, 1, 2.0, 1.0, 50.0), 9: (0, 0, 0, 0.0, 0.0, None)}


def test_conclusions_do_not_depend_on_the_examination(spark):
    coverage = spark.createDataFrame([(1, "parsed", 5), (2, "carved", 6)], "evidence_id long, bucket string, length long")
    custody = spark.createDataFrame([(1, "x")], "evidence_id long, holder string")
    digest = lambda sections: {r.evidence_id: r.conclusions_digest for r in findings.conclusions_digest(sections).collect()}
    one = digest({"coverage": coverage, "custody": custody})
    assert one == digest({"coverage": coverage.orderBy("length", ascending=False)}) and one[1] != one[2]
    assert one != digest({"coverage": coverage.withColumn("length", coverage.length + 1)})


def test_motion_analysis_and_lookups(spark):
    frames = [(1, k, 4, 2, bytearray([200 * (k == 2)] * 8)) for k in range(6)]
    df = spark.createDataFrame(frames, "recording_id int, frame_no long, width int, height int, gray binary")
    sessions, notes, summary = flows.motion_analysis(df, 8, min_area=4, min_event_frames=2)
    assert [(r.first_frame, r.last_frame) for r in sessions.collect()] == [(2, 3)] and notes.count() == 2
    assert [tuple(r) for r in summary.collect()] == [(1, 6, 2)]
    assert flows.looked_up(df, recording_id=1, frame_no=None).count() == 6 and flows.looked_up(df, recording_id=2).count() == 0


def test_a_recovery_merges_once(spark):
    """The merge is read by the survivors and by the counts, and is not made for each."""
    kind = "evidence_id long, recording_id long, tier string, extents array<struct<offset:bigint,length:bigint>>, note string, local_start_us long, local_end_us long"
    stored = spark.createDataFrame([(1, 1, "T1", [(0, 10)], None, 0, 60_000_000), (2, 9, "T1", [(0, 4)], None, 5, None)], kind)
    found = spark.createDataFrame([(1, 2, "T2", [(5, 10)], None, 0, 5), (1, 3, "T3", [(50, 10)], None, 0, 30_000_000), (1, 4, "T3", [(80, 10)], None, None, 9)], kind)
    images = spark.createDataFrame([(1, 100), (2, 100), (3, 100)], "evidence_id long, size long")
    none = lambda schema: spark.createDataFrame([], schema)
    summary = flows.recovered(images, none("evidence_id long, index_extents array<struct<offset:bigint,length:bigint>>"), stored, found, none("evidence_id long, offset long, length long"))["summary"]
    assert {tuple(r) for r in summary.collect()} == {(1, 2, 1, 1, 1.0, 0.5, 50.0), (2, 0, 0, 0, 0.0, 0.0, None), (3, 0, 0, 0, 0.0, 0.0, None)}
    assert summary.columns == ["evidence_id", "added", "items_without_time", "duplicates_merged", "t1_minutes", "recovered_minutes", "gain_pct"]
    assert "MapInArrow" not in summary._jdf.queryExecution().optimizedPlan().toString()
