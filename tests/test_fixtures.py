"""Images of known content through identification, carving and reassembly."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions.scalars import micros, packed_datetime
from tracewell.operators import frames, intervals
from tracewell.sources import evidence, families, fixtures, formats


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    top, corpus = tmp_path_factory.mktemp("fixtures"), fixtures.corpus()
    made = {r.name: r.size for r in fixtures.build(spark, [*corpus.values()], str(top)).collect()}
    assert made == {n: f.size for n, f in corpus.items()}
    for f in corpus.values():  # as laid by hand
        data = bytearray(f.size)
        for at, piece in f.pieces:
            data[at : at + len(piece)] = piece
        assert (top / f.name).read_bytes() == data
    case = families.open_images(spark, {n: str(top / n) for n in corpus}, 256 * 1024, 64 * 1024)
    known = families.identified(case).cache()
    gaps = spark.createDataFrame([("S-06", *g) for g in corpus["S-06"].truth["gaps"]], "evidence_id string, offset long, length long")
    rows = families.carved(case, known, gaps)["recordings"].collect()
    found = {n: sorted((r for r in rows if r.evidence_id == n), key=lambda r: r.extents[0].offset) for n in corpus}
    return corpus, case, {r.evidence_id: (r.status, r.family) for r in known.collect()}, found


def test_carved_recordings_are_those_of_the_truth(built):
    corpus, _, known, found = built
    assert corpus["S-01"].recordings[0][2] == 5378 and [r[1] for r in corpus["S-01"].recordings] == [65536, 103682, 141828, 179974]
    for n in ("S-01", "S-08"):
        assert [(r.channel, r.extents[0].offset, r.extents[0].length) for r in found[n]] == [x[:3] for x in corpus[n].recordings]
        assert {(r.tier, r.codec) for r in found[n]} == {("T3", "h264")}
    assert found["S-08"][1].local_start_us - found["S-08"][0].local_start_us == -7_200_000_000
    assert known["S-11"] == ("unknown", None) and found["S-11"] == []


def test_what_survives_is_bounded_by_what_is_gone(built):
    corpus, _, _, found = built
    hit, lost = corpus["S-03"].truth["overwritten"]
    (low, size), first = corpus["S-03"].truth["surviving"][0], found["S-03"][0]
    assert first.extents[0].offset == low and low + size - 102 < low + first.extents[0].length <= low + size
    assert all(r.extents[0].offset >= hit + lost for r in found["S-03"][1:]) and len(found["S-03"]) > 1


def test_recordings_end_at_bad_sectors(spark, built):
    corpus, case, _, found = built
    gaps = corpus["S-06"].truth["gaps"]
    rows = found["S-06"]
    assert {r.tier for r in rows} == {"T4"} and len(rows) > 1
    assert all(o + n <= g or o >= g + m for r in rows for o, n in [tuple(r.extents[0])] for g, m in gaps)
    assert any("bounded by unreadable ranges at 51200+1536" in x for r in rows for x in r.notes)
    table = spark.createDataFrame([("S-06", *g) for g in gaps], "evidence_id string, offset long, length long")
    assert evidence.merged_gaps(table).count() == 4
    claims = intervals.claims_of(spark.createDataFrame([], "evidence_id string, index_extents array<struct<offset:bigint,length:bigint>>"), spark.createDataFrame([("S-06", "T4", [tuple(r.extents[0])]) for r in rows], "evidence_id string, tier string, extents array<struct<offset:bigint,length:bigint>>"), table)
    images = case.images.where("evidence_id = 'S-06'")
    totals = {r.bucket: r.bytes for r in intervals.coverage_totals(images, intervals.coverage_map(images, claims)).collect()}
    assert totals["unreadable"] == 8 * 512 and totals["carved"] == sum(r.extents[0].length for r in rows) and sum(totals.values()) == 2 << 20


def test_an_export_cut_short(built):
    corpus, case, _, found = built
    assert [r.extents[0].offset for r in found["S-09"]] == [0] and corpus["S-09"].size - 241 < found["S-09"][0].extents[0].length <= corpus["S-09"].size


def test_channel_segments_of_a_clock_set_back(built):
    _, case, _, _ = built
    walk = formats.frames_of_windows(case.windows.where("evidence_id = 'S-08'"), chunk=case.chunk)
    made = frames.channel_segments(walk.withColumn("local_us", micros(packed_datetime(F.col("date")))), ["evidence_id"]).collect()
    assert sorted(r.frame_count for r in made) == [25, 25]
