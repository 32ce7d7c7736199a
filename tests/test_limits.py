"""Long recordings in blocks, scans with a budget of time, and streams that stop, start again and fall idle."""

import random
import time

import pytest

from tests.test_bytes import windows_of
from tracewell.operators import carving, motion, sweeps
from tracewell.streaming import sessions

GRAY = "recording_id int, frame_no long, width int, height int, gray binary"


@pytest.mark.parametrize("stride", [1, 4, 50])
def test_frames_are_compared_across_blocks(spark, monkeypatch, stride):
    rng = random.Random(stride)
    rows = [(k, n, 4, 2, bytearray(rng.randrange(256) for _ in range(8))) for k in (1, 2, None) for n in sorted(rng.sample(range(400), 90))]
    df = spark.createDataFrame(rows, GRAY).repartition(3)
    key = lambda d: sorted((r.recording_id or 0, r.frame_no, r.changed, r.x0, r.y0, r.x1, r.y1) for r in d.collect())
    monkeypatch.setattr(motion, "STRIDE", 10**9)
    want = key(motion.frame_differences(df.where("recording_id is not null")))
    monkeypatch.setattr(motion, "STRIDE", stride)
    assert key(motion.frame_differences(df.where("recording_id is not null"))) == want and len(want) == 180
    assert sum(r[2] == 0 for r in want) >= 2  # the first of each recording has no frame before


def test_one_recording_is_many_tasks(spark):
    df = spark.range(50_000).selectExpr("cast(1 as int) as recording_id", "id as frame_no", "cast(id as string) as gray").repartition(40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = motion.with_before(df, "gray").selectExpr("spark_partition_id() as p", "frame_no", "before").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.p for r in made}) > 1 and len(made) == 50_000
    assert all(r.before == (str(r.frame_no - 1) if r.frame_no else None) for r in made)


def test_sessions_of_a_hot_recording(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2]), n, rng.random() < 0.3, rng.random()) for n in range(900)]
    df = spark.createDataFrame(rows, "recording_id int, frame_no long, motion boolean, score double")
    want = sorted(map(tuple, motion.motion_segments(df).collect()))
    for name, value in (("HOT", 50), ("RANGE", 40), ("SMALL_BYTES", 0)):
        monkeypatch.setattr(sweeps, name, value)
    assert sorted(map(tuple, motion.motion_segments(df).collect())) == want and len(want) > 20


def _slow(data, at):
    time.sleep(0.5)
    return 4


def test_a_scan_that_outlives_its_budget_raises(spark):
    chunks = spark.createDataFrame(windows_of(b"MARK" * 200, 40, 4), "evidence_id int, offset long, bytes binary").repartition(4)
    began = time.monotonic()
    with pytest.raises(carving.BudgetExceeded):
        carving.scan_within(chunks, {"mark": (b"MARK", _slow)}, 3, 40)
    assert time.monotonic() - began < 20
    assert carving.scan_within(chunks, {"mark": (b"MARK", None)}, 300, 40).count() == 200
    with pytest.raises(ZeroDivisionError), carving.budget(spark, 100):
        1 / 0
    assert spark.range(5).count() == 5  # jobs after a budget run as ever


def _run(spark, stream, out, checkpoint, **how):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**how).start()
    return query


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "recording_id int, frame_no long, motion boolean"
    moving = [0, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1]
    rows = [(r, k, bool(m)) for r in (1, 2) for k, m in enumerate(moving)]
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    spark.createDataFrame([], schema).write.parquet(folder)
    for part in (rows[:2] + rows[23:30], rows[2:14] + rows[30:38], rows[14:23] + rows[38:], [(1, None, False), (2, None, False)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = sessions.motion_sessions(spark.readStream.schema(schema).parquet(folder), idle_ms=None)
        query = _run(spark, stream, out, checkpoint, availableNow=True)
        assert query.awaitTermination(120)
    got = sorted((r.recording_id, r.first_frame, r.last_frame, r.motion_frames) for r in spark.read.parquet(out).collect())
    want = motion.motion_segments(spark.createDataFrame([(*r, 1.0) for r in rows], schema + ", score double")).collect()
    assert got == sorted((r.recording_id, r.first_frame, r.last_frame, r.motion_frames) for r in want) and len(got) == 4


def test_idle_recordings_leave_the_state(spark, tmp_path):
    schema = "recording_id int, frame_no long, motion boolean"
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    spark.createDataFrame([(1, k, True) for k in range(4)], schema).coalesce(1).write.parquet(folder)
    stream = sessions.motion_sessions(spark.readStream.schema(schema).parquet(folder), idle_ms=1000)
    query = _run(spark, stream, out, checkpoint, processingTime="500 milliseconds")
    try:
        until = time.monotonic() + 90
        while time.monotonic() < until:
            state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
            if len(state) > 1 and state[-1] == 0 and 1 in state:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert state[-1] == 0 and 1 in state
    assert [(r.first_frame, r.last_frame, r.motion_frames) for r in spark.read.parquet(out).collect()] == [(0, 3, 4)]
