import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tracewell.operators import intervals as iv


def brute_map(size, claims):
    """The bucket of every byte, as runs."""
    rank = {b: i for i, b in enumerate(iv.BUCKETS)}
    bytes_ = ["unaccounted"] * size
    for offset, length, bucket in claims:
        for k in range(max(0, offset), min(size, offset + length)):
            if rank[bucket] < rank[bytes_[k]]:
                bytes_[k] = bucket
    runs = []
    for k, b in enumerate(bytes_):
        if runs and runs[-1][2] == b:
            runs[-1][1] += 1
        else:
            runs.append([k, 1, b])
    return [tuple(r) for r in runs]


def greedy(rows):
    """Reference model of first-fit clusters: (recording_id -> kept_id)."""
    order = sorted(rows, key=lambda r: (r[2], min(o for o, _ in r[3]), -(max(o + n for o, n in r[3]) - min(o for o, _ in r[3])), r[4], r[1]))
    clusters, out = [], {}
    for r in order:
        for c in clusters:
            if any(a < d + m and d < a + n for x in c for a, n in r[3] for d, m in x[3]):
                c.append(r)
                break
        else:
            clusters.append([r])
    for c in clusters:
        for r in c:
            out[r[1]] = c[0][1]
    return out


def claims_df(spark, images):
    rows = [(e, o, n, b) for e, (_, claims) in images.items() for o, n, b in claims]
    return spark.createDataFrame([(e, s) for e, (s, _) in images.items()], "evidence_id long, size long"), spark.createDataFrame(rows, "evidence_id long, offset long, length long, bucket string")


def test_known_map(spark):
    images, claims = claims_df(spark, {1: (1000, [(0, 512, "structural"), (512, 200, "parsed"), (900, 50, "carved")])})
    made = iv.coverage_map(images, claims)
    assert {(r.bucket, r.bytes) for r in iv.coverage_totals(images, made).collect()} == {("structural", 512), ("parsed", 200), ("carved", 50), ("unaccounted", 238), ("unreadable", 0)}
    assert iv.explained(images, made).first().unaccounted_bytes == 238
    assert iv.coverage_problems(images, made).collect() == []
    assert iv.bucket_at(made, 512).first().bucket == "parsed"


def test_maps_of_random_claims_tile_their_images(spark):
    rng = random.Random(20260918)
    images = {}
    for e in range(150):
        size = rng.randint(0, 300)
        images[e] = (size, [(rng.randint(0, 320), rng.randint(0, 80), rng.choice(iv.BUCKETS[:-1])) for _ in range(rng.randint(0, 12))])
    i, c = claims_df(spark, images)
    made = iv.coverage_map(i, c)
    got = {}
    for r in made.collect():
        got.setdefault(r.evidence_id, []).append((r.offset, r.length, r.bucket))
    assert {e: sorted(v) for e, v in got.items()} == {e: brute_map(*x) for e, x in images.items() if x[0]}
    assert iv.coverage_problems(i, made).collect() == []


def test_spoilt_maps_are_told(spark):
    images = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 0)], "evidence_id long, size long")
    rows = [(1, 0, 5, "parsed"), (1, 6, 4, "carved"), (2, 0, 5, "parsed"), (2, 5, 5, "parsed"), (3, 0, 6, "parsed"), (3, 5, 3, "carved")]
    got = {(r.evidence_id, r.problem) for r in iv.coverage_problems(images, spark.createDataFrame(rows, "evidence_id long, offset long, length long, bucket string")).collect()}
    assert got == {(1, "gap"), (2, "split run"), (3, "overlap"), (3, "wrong end")}


def test_tiers_are_merged_greedily_not_by_components(spark):
    e = lambda o, n: [(o, n)]
    rows = [(1, 1, "T1", e(0, 100), ""), (1, 2, "T1", e(200, 100), ""), (1, 3, "T3", e(50, 200), ""), (2, 4, "T1", e(0, 1000), ""), (2, 5, "T3", e(200, 300), "")]
    schema = "evidence_id long, recording_id long, tier string, extents array<struct<offset:bigint,length:bigint>>, note string"
    merged = iv.merge_tiers(spark.createDataFrame(rows, schema))
    assert {r.recording_id: r.kept_id for r in merged.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}
    stats = {r.evidence_id: (r.kept, r.dropped, r.groups) for r in iv.merge_stats(merged).collect()}
    assert stats == {1: (2, 1, 1), 2: (1, 1, 1)}


def test_random_merges_follow_the_model(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for e in range(60):
        own = [(e, e * 100 + k, rng.choice(iv.TIERS), [(rng.randint(0, 200), rng.randint(1, 40)) for _ in range(rng.randint(1, 2))], rng.choice("ab")) for k in range(rng.randint(1, 14))]
        rows += own
        want |= greedy(own)
    schema = "evidence_id long, recording_id long, tier string, extents array<struct<offset:bigint,length:bigint>>, note string"
    got = {r.recording_id: r.kept_id for r in iv.merge_tiers(spark.createDataFrame(rows, schema)).collect()}
    assert got == want


def test_merge_notes_name_what_was_absorbed(spark):
    rows = [(1, 1, "T1", 1), (1, 2, "T3", 1), (1, 3, "T2", 1), (1, 4, "TX", 1), (1, 5, "T3", 1), (1, 6, "T4", 6), (2, 1, "T4", 1), (2, 2, "T4", 1)]
    made = iv.merge_notes(spark.createDataFrame(rows, "evidence_id long, recording_id long, tier string, kept_id long")).collect()
    assert {(r.evidence_id, r.recording_id): (r.absorbed, r.tiers) for r in made} == {(1, 1): (4, ["T2", "T3", "TX"]), (2, 1): (1, ["T4"])}
    assert made[0].note.startswith(f"{made[0].absorbed} overlapping result(s) at {', '.join(made[0].tiers)} were merged")


def test_the_interval_index_equals_lists(monkeypatch):
    """Clusters as lists of all their members' spans, and blocks so short that they split and go all the time."""
    monkeypatch.setattr(iv.Painted, "FULL", 3)
    for seed in range(400):
        rng = random.Random(seed)
        rows = [(i, [{"offset": rng.randrange(rng.choice([20, 200])), "length": rng.choice([0, 1, 5, 30])} for _ in range(rng.randrange(3))]) for i in range(rng.randrange(60))]
        clusters, want = [], []
        for i, extents in rows:
            spans = [(e["offset"], e["offset"] + e["length"]) for e in extents]
            found = next((c for c in clusters if any(a < d and x < b for a, b in spans for x, d in c[1])), None)
            if found is None:
                clusters.append(found := (i, []))
            found[1].extend(spans)
            want.append(found[0])
        assert iv._clusters(rows) == want


def test_one_island_of_a_million_records(spark):
    rng = random.Random(1)
    rows = [(i, [{"offset": rng.randrange(100_000), "length": rng.randrange(1, 300)}]) for i in range(1_000_000)]
    heads = iv._clusters(rows)
    kept = sorted((e[0]["offset"], e[0]["offset"] + e[0]["length"]) for (i, e), h in zip(rows, heads) if i == h)
    assert len(heads) == 1_000_000 and all(b <= c for (_, b), (c, _) in zip(kept, kept[1:]))  # survivors are disjoint
    assert sum(h == i for (i, _), h in zip(rows, heads)) == len(kept) == len(set(heads))


def test_subtract_keeps_touching_spans_apart_and_names_its_holes(spark):
    spans = spark.createDataFrame([(1, 0, 100), (1, 100, 200), (1, 1000, 5000), (1, 9000, 9100)], "evidence_id long, start long, end long")
    holes = spark.createDataFrame([(1, 150, 160), (1, 2000, 2512), (1, 5100, 5200), (1, 8000, 9200)], "evidence_id long, start long, end long")
    got = {(r.start, r.end): [(h.start, h.end) for h in r.bounded_by] for r in iv.subtract(spans, holes, ["evidence_id"]).collect()}
    assert got == {
        (0, 100): [(150, 160)], (100, 150): [(150, 160)], (160, 200): [(150, 160)], (1000, 2000): [(2000, 2512)], (2512, 5000): [(2000, 2512), (5100, 5200)],
    }


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 15)), max_size=12), st.integers(0, 3))
def test_islands_and_complement_partition_the_line(spark, spans, gap):
    df = spark.createDataFrame([(1, o, o + n) for o, n in spans], "k long, start long, end long")
    covered = {x for o, n in spans for x in range(o, o + n)}
    isl = sorted((r.start, r.end) for r in iv.islands(df, ["k"]).collect())
    assert {x for a, b in isl for x in range(a, b)} == covered
    assert all(b < c for (_, b), (c, _) in zip(isl, isl[1:]))
    bounds = spark.createDataFrame([(1, 0, 80)], "k long, low long, high long")
    rest = iv.complement(df, ["k"], bounds).collect()
    assert {x for r in rest for x in range(r.start, r.end)} == set(range(80)) - covered
    wide = sorted((r.start, r.end) for r in iv.islands(df, ["k"], max_gap=gap).collect())
    assert all(c - b > gap for (_, b), (c, _) in zip(wide, wide[1:]))


@pytest.mark.parametrize("a,b,want", [([(0, 5)], [(5, 5)], False), ([(0, 6)], [(5, 5)], True), ([(0, 1), (9, 2)], [(3, 1), (10, 1)], True)])
def test_overlap_is_half_open(spark, a, b, want):
    kind = "array<struct<offset:bigint,length:bigint>>"
    df = spark.createDataFrame([(a, b)], f"a {kind}, b {kind}")
    from pyspark.sql import functions as F

    assert df.select(iv.overlap(F.col("a"), F.col("b"))).first()[0] is want


def test_islands_of_one_record_are_never_clustered(monkeypatch):
    """However the rows are cut to batches; an island of few records takes no index, one of many does."""
    import pyarrow as pa

    rng = random.Random(5)
    rows, want = [], []
    for island, size in enumerate([1, 1, 40, 1, 3, 2, 1, 33, 1, 1, 5]):
        mine = [(f"{island}.{k}", [{"offset": rng.randrange(60), "length": rng.choice([0, 1, 9])} for _ in range(rng.randrange(3))]) for k in range(size)]
        want += iv._clusters(mine)
        rows += [(None if island < 2 else "E", island, i, "T1", e) for i, e in mine]
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
    schema = pa.schema([("evidence_id", pa.string()), ("island", pa.int64()), ("recording_id", pa.string()), ("tier", pa.string()), ("extents", kind)])
    whole = pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
    seen, plain, few = [], iv._clusters, iv._few
    monkeypatch.setattr(iv, "_clusters", lambda r: seen.append(len(r)) or plain(r))
    monkeypatch.setattr(iv, "_few", lambda r: seen.append(len(r)) or few(r))
    for step in (1, 2, 7, 30, 1000):
        seen.clear()
        made = pa.Table.from_batches(iv._greedy(whole.slice(k, step) for k in range(0, whole.num_rows, step)))
        assert made.column("kept_id").to_pylist() == want and made.column("recording_id").to_pylist() == [r[2] for r in rows]
        assert sorted(seen) == [2, 3, 5, 33, 40]
