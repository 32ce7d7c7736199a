import pytest
from pyspark.sql import functions as F

from tracewell.operators import anomalies, timeline
from tracewell.functions import scalars

S = 1_000_000
MIN = 60 * S
SEG = "evidence_id long, channel int, start_us long, end_us long, uncertainty_us long, recording_id string"


def segs(spark, rows):
    return spark.createDataFrame([(1, c, a * MIN, b * MIN, u * S, f"r{i}") for i, (c, a, b, u) in enumerate(rows)], SEG)


def test_gap_between_neighbours(spark):
    rows = [(1, 0, 10, 0), (1, 20, 30, 0), (2, 0, 30, 0)]
    got = timeline.channel_gaps(segs(spark, rows)).collect()
    assert [(r.channel, (r.gap_end_us - r.gap_start_us) // S) for r in got] == [(1, 600)]
    unsure = [(c, a, b, 30) for c, a, b, _ in rows]
    got = timeline.channel_gaps(segs(spark, unsure)).collect()
    assert [(r.gap_end_us - r.gap_start_us) // S for r in got] == [540]


def test_nested_segments_open_a_gap_for_neighbours_only(spark):
    df = segs(spark, [(1, 0, 100, 0), (1, 10, 20, 0), (1, 50, 60, 0)])
    assert [(r.gap_start_us // MIN, r.gap_end_us // MIN) for r in timeline.channel_gaps(df).collect()] == [(20, 50)]
    assert timeline.covered_gaps(df, ["evidence_id"]).collect() == []


def test_synchronised_gap(spark):
    df = segs(spark, [(1, 0, 10, 0), (1, 50, 60, 0), (2, 0, 12, 0), (2, 50, 58, 0)])
    got = timeline.synchronised_gaps(df).collect()
    assert [((r.gap_end_us - r.gap_start_us) // MIN) for r in got] == [38]
    assert timeline.synchronised_gaps(df.where("channel = 1")).collect() == []


OBS = "evidence_id long, method string, device_local_us long, true_utc_us long, uncertainty_s double, valid_from_us long, valid_to_us long"
HOUR = 3600 * S


def test_clock_of_two_parts(spark):
    obs = [(1, "A_ntp", 10 * HOUR, 9 * HOUR, None, None, 12 * HOUR), (1, "C_external_event", 14 * HOUR, 14 * HOUR - HOUR // 2, None, 12 * HOUR, None)]
    seg = timeline.clock_segments(timeline.observe(spark.createDataFrame(obs, OBS)))
    rows = spark.createDataFrame([(1, 11 * HOUR), (1, 15 * HOUR), (1, 12 * HOUR), (1, None), (2, HOUR)], "evidence_id long, local_us long")
    got = {(r.evidence_id, r.local_us): (r.utc_us, r.uncertainty_s, r.method) for r in timeline.normalise(rows, seg).collect()}
    assert got[1, 11 * HOUR] == (10 * HOUR, 1.0, "A_ntp")
    assert got[1, 15 * HOUR] == (14 * HOUR + HOUR // 2, 60.0, "C_external_event")
    assert got[1, 12 * HOUR][2] == "C_external_event"
    assert got[1, None] == (None, None, "none") and got[2, HOUR] == (None, None, "none")


def test_overlapping_or_too_certain_observations_are_refused(spark):
    two = spark.createDataFrame([(1, "A_ntp", HOUR, 0, None, None, None), (1, "A_ntp", 2 * HOUR, 0, None, None, None)], OBS)
    with pytest.raises(Exception, match="overlap"):
        timeline.clock_segments(timeline.observe(two)).collect()
    with pytest.raises(Exception, match="floor"):
        timeline.observe(spark.createDataFrame([(1, "A_ntp", HOUR, 0, 0.5, None, None)], OBS)).collect()


def test_offset_text_and_ordering(spark):
    df = spark.createDataFrame([(1062.0, 0, 1, 20, 30), (-7200.0, 0, 1, 40, 30)], "o double, a long, ua long, b long, ub long")
    got = df.select(timeline.format_offset(F.col("o")), timeline.ordering(F.col("a"), F.col("ua"), F.col("b"), F.col("ub"))).collect()
    assert [tuple(r) for r in got] == [("+00:17:42", "not_determinable"), ("-02:00:00", "before")]


ANOM = "evidence_id long, recording_id string, channel int, start_us long, end_us long, index_position long, extent_key string"


def test_detectors(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, 0, 30 * MIN, 0, "x"), (1, "b", 1, 10 * MIN, 40 * MIN, 2, "y"), (1, "c", 1, 45 * MIN, 45 * MIN, 1, ""), (1, "d", None, 90 * MIN, 80 * MIN, 3, ""), (1, "e", 2, None, None, 4, "")], ANOM
    )
    volumes = spark.createDataFrame([(1, 5 * MIN, 60 * MIN)], "evidence_id long, formatted_us long, acquired_us long")
    got = {(r.kind, r.channel, tuple(r.recording_ids), r.seconds) for r in anomalies.detect(df, volumes).collect()}
    assert got == {
        ("duplicate_window", 1, ("a", "b"), 1200.0), ("backwards_sequence", 1, ("c", "b"), 2100.0), ("before_volume_format", None, ("a",), 300.0),
        ("future_dated", None, ("d",), 1800.0), ("zero_length", None, ("c",), 0.0), ("ends_before_start", None, ("d",), 600.0),
    }
    assert all(len(r.possible_causes) >= 2 for r in anomalies.with_causes(anomalies.detect(df, volumes)).collect())


def test_a_long_list_shows_twenty(spark):
    rows = [(1, f"r{i:03d}", 1, i, i, i, "") for i in range(50)]
    r = anomalies.zero_length(spark.createDataFrame(rows, ANOM)).first()
    assert r["count"] == 50 and r.recording_ids == [f"r{i:03d}" for i in range(20)]


def test_scalars(spark):
    import datetime as dt

    raw = (26 << 26) | (3 << 22) | (5 << 17) | (14 << 12) | (17 << 6) | 42
    df = spark.createDataFrame([(raw, bytes([1, 2, 3, 4, 5])), ((13 << 22) | (1 << 17), b"ab")], "raw long, b binary")
    rows = df.select(scalars.packed_datetime(F.col("raw")), scalars.le_uint(F.col("b"), 1, 4), scalars.unix_local(F.lit(1_772_720_262)), scalars.unix_local(F.lit(scalars.RECORDING_NOW)), scalars.human_bytes(F.lit(1280)), scalars.human_duration(F.lit(3723))).collect()
    assert rows[0][0] == dt.datetime(2026, 3, 5, 14, 17, 42) and rows[1][0] is None
    assert rows[0][1] == 0x05040302 and rows[1][1] is None
    assert rows[0][2] == dt.datetime(2026, 3, 5, 14, 17, 42) and rows[0][3] is None
    assert rows[0][4] == "1.2 KiB" and rows[0][5] == "1 h 02 min 03 s"
    iso = spark.sql("select timestamp_ntz'2026-03-05 14:17:42' a, timestamp_ntz'2026-03-05 14:17:42.5' b").select(scalars.iso_local(F.col("a")), scalars.iso_local(F.col("b"))).first()
    assert tuple(iso) == ("2026-03-05T14:17:42", "2026-03-05T14:17:42.500000")
