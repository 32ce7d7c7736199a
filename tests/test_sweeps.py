"""Sweeps of one hot key by ranges give the rows of the plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell import staging
from tracewell.operators import anomalies, frames, intervals, sweeps, timeline


@pytest.fixture
def by_ranges(monkeypatch):
    monkeypatch.setattr(sweeps, "HOT", 50)
    monkeypatch.setattr(sweeps, "RANGE", 60)
    monkeypatch.setattr(sweeps, "SMALL_BYTES", 0)


def both(monkeypatch, make):
    plain = sorted(map(repr, make().collect()))
    monkeypatch.setattr(sweeps, "HOT", 50)
    monkeypatch.setattr(sweeps, "RANGE", 60)
    monkeypatch.setattr(sweeps, "SMALL_BYTES", 0)
    assert sorted(map(repr, make().collect())) == plain
    return plain


def spans(rng, n, width, keys=(1, 1, 1, 1, 1, 2, 3, None)):
    return [(rng.choice(keys), o := rng.randrange(width), o + rng.randrange(1, 30)) for _ in range(n)]


def test_running_values(spark, by_ranges):
    rng = random.Random(1)
    rows = [(rng.choice([7, 7, 7, 8, 9, None]), i, rng.choice([None, rng.randrange(100)])) for i in range(600)]
    df = sweeps.dealt(spark.createDataFrame(rows, "k int, i int, v int").repartition(5), ["k"], ["i"])
    assert df.select(sweeps.PART).distinct().count() > 5
    made = sweeps.swept(df, ["k"], ["i"], s=("sum", "v"), m=("max_before", "v"), l=("last", "v"), b=("last_before", "v"), g=("lag", "v"), d=("lead", "v"), n=("lead", "i")).collect()
    of = {}
    for r in sorted(made, key=lambda r: r.i):
        of.setdefault(r.k, []).append(r)
    assert len(made) == len(rows)
    for group in of.values():
        total = most = last = None
        for before, r, after in zip([None, *group], group, [*group[1:], None]):
            assert (r.m, r.b, r.g) == (most, last, before and before.v)
            if r.v is not None:
                total, most, last = (total or 0) + r.v, max(most or 0, r.v), r.v
            assert (r.s, r.l, r.d, r.n) == (total, last, after and after.v, after and after.i)


@pytest.mark.parametrize("gap", [0, 5])
def test_islands(spark, monkeypatch, gap):
    df = spark.createDataFrame(spans(random.Random(2), 800, 6000), "evidence_id int, start long, end long").repartition(4)
    assert len(both(monkeypatch, lambda: intervals.islands(df, ["evidence_id"], max_gap=gap))) > 50


def test_coverage_map(spark, monkeypatch):
    rng = random.Random(3)
    claims = spark.createDataFrame([(k, o, e - o, rng.choice(intervals.BUCKETS[:-1])) for k, o, e in spans(rng, 900, 9000, (1, 1, 1, 1, 2, 3))], "evidence_id int, offset long, length long, bucket string")
    images = spark.createDataFrame([(1, 8000), (2, 9500), (3, 0), (4, 100)], "evidence_id int, size long")
    assert len(both(monkeypatch, lambda: intervals.coverage_map(images, claims))) > 300
    assert intervals.coverage_problems(images, intervals.coverage_map(images, claims)).collect() == []


def test_subtract_and_complement(spark, monkeypatch):
    rng = random.Random(4)
    at, pieces = 0, []
    for _ in range(500):
        at += rng.randrange(0, 9)
        pieces.append((1 if at < 6000 else 2, at, at + (n := rng.randrange(1, 20))))
        at += n
    whole = spark.createDataFrame(pieces, "k int, start long, end long").repartition(3)
    places = sorted({12 * rng.randrange(700) for _ in range(400)})
    holes = spark.createDataFrame([(1 if o < 6000 else 2, o, o + 3) for o in places], "k int, start long, end long")
    bounds = spark.createDataFrame([(1, 5, 5900), (2, 6000, 9999), (3, 0, 7)], "k int, low long, high long")
    both(monkeypatch, lambda: intervals.subtract(whole, holes, ["k"], near=16))
    both(monkeypatch, lambda: intervals.complement(holes, ["k"], bounds))


def test_times_of_one_item(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), i, rng.choice([1, 1, 2, None]), s := rng.randrange(10**5), s + rng.randrange(-5, 300), rng.randrange(9), rng.randrange(500), rng.choice("ab")) for i in range(500)]
    schema = "evidence_id int, recording_id int, channel int, start_us long, end_us long, uncertainty_us long, index_position long, extent_key string"
    df = spark.createDataFrame(rows, schema).repartition(4)
    volumes = spark.createDataFrame([(1, 500, 90_000), (2, 0, 50)], "evidence_id int, formatted_us long, acquired_us long")

    def every():
        columns = ("gap_start_us", "gap_end_us")
        parts = [timeline.channel_gaps(df, 1), timeline.synchronised_gaps(df, 1), timeline.covered_gaps(df, ["evidence_id", "channel"])]
        out = parts[0].select("evidence_id", *columns)
        for p in parts[1:]:
            out = out.unionByName(p.select("evidence_id", *columns))
        found = anomalies.detect(df, volumes).selectExpr("evidence_id", "cast(seconds * 1e6 as long) as gap_start_us", "count as gap_end_us")
        return out.unionByName(found)

    assert len(both(monkeypatch, every)) > 200


def test_frames_of_one_span(spark, monkeypatch):
    rng = random.Random(6)
    at, rows = 0, []
    for i in range(600):
        at += rng.choice([0, 0, 0, 0, 7])
        rows.append((1 if i < 500 else 2, 5, at, 100, rng.choice(["I", "P", "P", "audio"]), rng.choice([1, 1, 1, 2, None]), rng.choice([None, i * 40_000, i * 40_000 - 9_000_000]), i - rng.choice([0] * 20 + [9]), rng.choice(["h264", None]), i * 40 % 65536, i // 25))
        at += 100
    schema = "evidence_id int, span_id int, offset long, length long, kind string, channel int, local_us long, sequence long, codec string, tick int, seconds long"
    df = spark.createDataFrame(rows, schema).repartition(4)
    ticks = lambda: frames.unwrapped_ticks(df, ["evidence_id"]).select("offset", "pts_ms")
    for make in (lambda: frames.runs(df), lambda: frames.carved_recordings(frames.runs(df)), lambda: frames.channel_segments(df, ["evidence_id"]), ticks):
        with monkeypatch.context() as m:
            assert len(both(m, make)) > 20


def test_no_task_has_most_of_a_hot_key(spark, by_ranges):
    rows = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("at"), F.lit(1).alias("by"))
    made = sweeps.swept(sweeps.dealt(rows, ["k"], ["at"]), ["k"], ["at"], s=("sum", "by"))
    sizes = sorted(r["count"] for r in made.groupBy(sweeps.PART).count().collect())
    assert len(sizes) > 100 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert made.agg(F.max("s")).first()[0] == 20_000
    staging.clear(spark)


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """Whatever the session's number of partitions is: 4 here."""
    monkeypatch.setattr(sweeps, "SMALL_BYTES", 0)
    monkeypatch.setattr(sweeps, "SHARE", 50)
    images = spark.range(40).selectExpr("id as evidence_id", "100000L as size")
    claims = spark.range(400).selectExpr("id % 40 as evidence_id", "id * 37 % 1000 as offset", "10L as length", "'parsed' as bucket")
    tiles = intervals.coverage_map(images, claims)
    assert tiles.rdd.getNumPartitions() == 18  # 800 ends of claims and 80 of images
    merged = intervals.islands(claims.selectExpr("evidence_id", "offset as start", "offset + length as end"), ["evidence_id"])
    assert merged.rdd.getNumPartitions() == 8
    made = sorted(map(tuple, tiles.collect()))
    monkeypatch.undo()
    assert made == sorted(map(tuple, intervals.coverage_map(images, claims).collect()))
