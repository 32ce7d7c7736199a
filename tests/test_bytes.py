import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from tracewell.operators import carving, frames, motion
from tracewell.sources import evidence, export, formats

S = 1_000_000


def packed(y, mo, d, h, mi, s):
    return ((y - 2000) << 26) | (mo << 22) | (d << 17) | (h << 12) | (mi << 6) | s


def frame(kind=0xFD, channel=1, sequence=0, date=packed(2026, 3, 5, 14, 0, 0), tick=0, payload=b"x" * 40, extension=b"\x81\0\x02\x19"):
    length = 24 + len(extension) + len(payload) + 8
    head = struct.pack("<4sBBBBIIIHBB", b"DHAV", kind, 0, channel, 0, sequence, length, date, tick, len(extension), 0)
    return head + extension + payload + b"dhav" + struct.pack("<I", length)


def test_frames_are_walked_and_resynchronised():
    data = b"head" + frame() + b"DHAVnoise" + frame(0xFC, sequence=1, tick=40) + frame(0xF0, channel=2)[:-1]
    got = list(formats.walk_frames(data))
    assert [(at, f["kind"], f["channel"], f["codec"], f["fps"]) for at, f in got] == [(4, "I", 1, "h264", 25), (4 + 76 + 9, "P", 1, "h264", 25)]


def test_frame_noise_gives_no_frames():
    rng = random.Random(1)
    for _ in range(200):
        data = bytearray(rng.randbytes(300))
        data[50:54] = b"DHAV"
        assert list(formats.walk_frames(bytes(data))) == []
    whole = frame()
    for k in range(len(whole)):
        broken = bytearray(whole)
        broken[k] ^= 0xFF
        found = list(formats.walk_frames(bytes(broken)))
        assert not found or k >= 4


def test_frames_of_files_scan_and_codec(spark):
    data = frame() + frame(0xFC, sequence=1, extension=b"") + b"gap" + frame(0xFD, sequence=2, extension=b"\x81\0\x0c\x19")
    files = spark.createDataFrame([("a", bytearray(data))], "path string, content binary")
    found = formats.with_codec(formats.frames_of_files(files)).orderBy("offset").collect()
    assert [(r.kind, r.codec_hint) for r in found] == [("I", "h264"), ("P", "h264"), ("I", "h265")]
    assert all(data[r.payload_offset : r.payload_offset + r.payload_length] == b"x" * 40 for r in found)
    chunks = files.select(F.lit(1).alias("evidence_id"), F.explode(carving.windows(F.col("content"), 50, 120)).alias("w")).select("evidence_id", "w.offset", "w.bytes")
    hits = carving.scan(chunks, formats.SIGNATURES, 50)
    assert sorted((r.offset, r.length) for r in hits.collect()) == [(0, 76), (76, 72), (151, 76)]
    spans = carving.group_hits(hits)
    assert sorted((r.start, r.end) for r in spans.collect()) == [(0, 148), (151, 227)]
    touched = carving.in_regions(chunks, spark.createDataFrame([(1, 99, 2)], "evidence_id int, offset long, length long"), 50)
    assert sorted(r.offset for r in touched.collect()) == [50, 100]


def image(rng, n):
    """Frames, some with frames in their payload, some noise, some spoilt."""
    out = bytearray()
    for i in range(n):
        inner = frame(0xFC, channel=7, sequence=i, payload=rng.randbytes(rng.randrange(30)))
        payload = rng.choice([b"p" * rng.randrange(50), inner, inner + b"DHAV" + inner, b"dhav" + rng.randbytes(9), b"q" * rng.randrange(1500)])
        made = frame(rng.choice([0xFD, 0xFC, 0xF0, 0xF1]), i % 3, i, payload=payload, extension=b"" if i % 2 else b"\x81\0\x0c\x19")
        out += rng.choice([made] * 6 + [made[:-1], made[:24] + made, b"noise" + made, b"DHAV"])
    return bytes(out)


def windows_of(data, chunk, overlap=320, evidence=1):
    return [(evidence, at, bytearray(data[at : at + chunk + overlap])) for at in range(0, len(data), chunk)]


@pytest.mark.parametrize("chunk", [400, 5000])
def test_frames_of_windows_are_those_of_the_walk(spark, monkeypatch, chunk):
    from tracewell.operators import chains

    monkeypatch.setattr(chains, "RANGE", 30)
    rng = random.Random(chunk)
    images = {1: image(rng, 120), 2: image(rng, 40), 3: b"", 4: frame()[:-1]}
    chunks = spark.createDataFrame([w for k, d in images.items() for w in windows_of(d, chunk, evidence=k)], "evidence_id int, offset long, bytes binary").repartition(3)
    made = formats.frames_of_windows(chunks, chunk=chunk).collect()
    fields = ("length", "kind", "channel", "sequence", "codec", "fps", "date", "tick")
    got = sorted((r.evidence_id, r.offset, *(r[f] for f in fields), r.payload_offset, r.payload_length) for r in made)
    want = [(k, at, *(f[x] for x in fields), f["payload"], at + f["length"] - 8 - f["payload"]) for k, d in images.items() for at, f in formats.walk_frames(d)]
    assert got == want
    assert any(r[4] == 7 for r in got)  # frames inside spoilt ones are found
    # in pieces: as the walk between their bounds
    cuts = {1: [(0, 1000), (1000, 1500), (1700, len(images[1]))], 2: [(13, len(images[2]) - 5)]}
    pieces = spark.createDataFrame([(k, a, b) for k, cs in cuts.items() for a, b in cs], "evidence_id int, start long, end long")
    made = formats.frames_of_windows(chunks, pieces, chunk).collect()
    assert sorted((r.evidence_id, r.piece, r.offset) for r in made) == [(k, a, at) for k, cs in cuts.items() for a, b in cs for at, _ in formats.walk_frames(images[k], a, b)]


def plain_recordings(data, holes, max_gap=0):
    """Reassembly by loops over one image."""
    hits = [(at, f["length"]) for at in range(len(data)) if data.startswith(b"DHAV", at) and (f := formats.frame_at(data, at))]
    spans = []
    for at, n in hits:
        if spans and at - spans[-1][1] <= max_gap:
            spans[-1][1] = max(spans[-1][1], at + n)
        else:
            spans.append([at, at + n])
    out = []
    for low, high in spans:
        edges = [low, *(x for o, n in holes for x in (o, o + n) if low < o + n and o < high), high]
        for a, b in zip(edges[::2], edges[1::2]):
            chain, codecs = [], {}
            for at, f in formats.walk_frames(data, a, b) if a < b else ():
                video = f["kind"] in ("I", "P", "B")
                if video and f["codec"]:
                    codecs[f["channel"]] = f["codec"]
                codec = codecs.get(f["channel"]) if video else None
                if chain and (f["channel"] != chain[-1][2] or f["date"] < chain[-1][3] or f["sequence"] < chain[-1][4] or at > chain[-1][0] + chain[-1][1]):
                    out.append(chain)
                    chain = []
                chain.append((at, f["length"], f["channel"], f["date"], f["sequence"], f["kind"], codec))
            out.append(chain)
    kept = []
    for chain in out:
        while chain and chain[0][5] != "I":
            chain = chain[1:]
        if chain:
            codecs = {c[6] for c in chain if c[6]}
            kept.append((chain[0][0], chain[-1][0] + chain[-1][1] - chain[0][0], len(chain), sum(c[5] == "I" for c in chain), codecs.pop() if len(codecs) == 1 else "unknown"))
    return sorted(kept)


def test_reassembly_equals_loops(spark):
    from tracewell.operators import reassembly

    rng = random.Random(8)
    images = {k: image(rng, 60) for k in range(4)}
    holes = {0: [], 1: [(512, 512)], 2: [(1024, 512), (2048, 1024)], 3: [(0, 512), (3000, 1)]}
    chunks = spark.createDataFrame([w for k, d in images.items() for w in windows_of(d, 700, evidence=k)], "evidence_id int, offset long, bytes binary").repartition(3)
    gaps = spark.createDataFrame([(k, *h) for k, hs in holes.items() for h in hs], "evidence_id int, offset long, length long")
    made = reassembly.reassembled(chunks, gaps, 700).collect()
    for k in images:
        rows = sorted((r for r in made if r.evidence_id == k), key=lambda r: r.position)
        assert [(r.offset, r.length, r.frame_count, r.keyframes, r.codec) for r in rows] == plain_recordings(images[k], holes[k])
        assert [r.position for r in rows] == [*range(1, len(rows) + 1)] and {r.tier for r in rows} <= {"T4" if holes[k] else "T3"}
        assert all(n.startswith("bounded") == (i == 3 and bool(r.bounded_by)) for r in rows for i, n in enumerate(r.notes))


@pytest.mark.parametrize("hot", [2_000_000, 20])
def test_reassembly_evaluates_its_inputs_once(spark, monkeypatch, hot):
    """Counted as large tables are: what is read more than once is staged, not made again. It took over 80 jobs."""
    from tracewell.operators import reassembly, sweeps

    monkeypatch.setattr(sweeps, "SMALL_BYTES", 0)
    monkeypatch.setattr(sweeps, "HOT", hot)
    data, holes, made_holes = image(random.Random(8), 60), [(1024, 512), (2048, 1024)], spark.sparkContext.accumulator(0)

    def passing(batches):
        for b in batches:
            made_holes.add(b.num_rows)
            yield b

    chunks = spark.createDataFrame(windows_of(data, 700, evidence=1), "evidence_id int, offset long, bytes binary")
    gaps = spark.createDataFrame([(1, *h) for h in holes], "evidence_id int, offset long, length long").mapInArrow(passing, "evidence_id int, offset long, length long")
    group = f"reassembly-{hot}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        rows = sorted(reassembly.reassembled(chunks, gaps, 700).collect(), key=lambda r: r.position)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [(r.offset, r.length, r.frame_count, r.keyframes, r.codec) for r in rows] == plain_recordings(data, holes)
    assert [r.position for r in rows] == [*range(1, len(rows) + 1)]
    assert made_holes.value == len(holes)
    if hot > len(data):
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 60


def test_surviving_ranges_of_an_overwritten_recording(spark):
    """An image as of fixture S-03: a recording at 65536, overwritten from 67616 on for 16384 bytes."""
    from tracewell.operators import reassembly

    one = frame(payload=b"v" * 28)  # 64 bytes
    data = bytearray(bytes(65536) + one * 32 + frame(payload=b"w" * 400) * 40)
    data[67616 : 67616 + 16384] = b"\xee" * 16384
    chunks = spark.createDataFrame(windows_of(bytes(data), 65536), "evidence_id int, offset long, bytes binary")
    made = reassembly.reassembled(chunks, spark.createDataFrame([], "evidence_id int, offset long, length long"), 65536).collect()
    assert [(r.tier, r.offset, r.length, r.frame_count) for r in made if r.offset < 67616] == [("T3", 65536, 2048, 32)]
    assert all(r.offset >= 67616 + 16384 for r in made[1:])


def test_a_frame_longer_than_windows_is_validated_whole(spark):
    body = bytes(range(256)) * 400
    data = b"x" * 90 + frame(payload=body) + frame()[:-1] + frame(payload=body[:300])
    for chunk, overlap in ((64, 24), (100, 24), (5000, 64)):
        df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data[:5000]))], "evidence_id int, content binary")
        chunks = df.select("evidence_id", F.explode(carving.windows(F.col("content"), chunk, overlap)).alias("w")).select("evidence_id", "w.offset", "w.bytes")
        got = sorted((r.evidence_id, r.offset, r.length) for r in carving.scan(chunks, formats.SIGNATURES, chunk).collect())
        whole = len(frame(payload=body))
        assert got == [(1, 90, whole), (1, 90 + whole + len(frame()) - 1, len(frame(payload=body[:300])))]


def test_occurrences_overlap(spark):
    df = spark.createDataFrame([(bytearray(b"aaaa"),), (bytearray(b"a"),)], "b binary")
    assert [r[0] for r in df.select(carving.occurrences(F.col("b"), b"aa")).collect()] == [[0, 1, 2], []]


def test_pack_headers():
    good = b"\0\0\1\xba" + bytes([0x44, 0, 0x04, 0, 0x04, 0x01, 0, 0, 0x03, 0xF8]) + b"\0\0\1\xe0"
    assert formats.pack_length(good, 0) == 14
    for k in (4, 6, 8, 9, 12, 16):
        bad = bytearray(good)
        bad[k] = 0
        assert formats.pack_length(bytes(bad), 0) is None


def volume(entries, pages=1, cycle=False):
    data = bytearray(0x10000)
    data[0x210 : 0x210 + 18] = b"HIKVISION@HANGZHOU"
    data[0x230:0x23E] = b"HIK.2011.03.08"
    data[0x1010:0x1018] = b"HIKBTREE"
    struct.pack_into("<Q", data, 0x1058, 0x2000)
    per = -(-len(entries) // pages)
    for p in range(pages):
        at, part = 0x2000 + p * 0x1000, entries[p * per : (p + 1) * per]
        struct.pack_into("<I", data, at + 0x10, len(part))
        last = 0x2000 if cycle else 0xFFFFFFFFFFFFFFFF
        struct.pack_into("<Q", data, at + 0x20, at + 0x1000 if p + 1 < pages else last)
        for k, (free, channel, start, end, block) in enumerate(part):
            e = at + 0x60 + k * 48
            struct.pack_into("<Q", data, e + 8, 0xFFFFFFFFFFFFFFFF if free else 1)
            struct.pack_into(">H", data, e + 0x10, channel)
            struct.pack_into("<II", data, e + 0x18, start, end)
            struct.pack_into("<Q", data, e + 0x20, block)
    return bytes(data)


@pytest.mark.parametrize("cycle", [False, True])
def test_volume_index(spark, tmp_path, cycle):
    entries = [(False, 1, 1_772_720_000, 1_772_721_800, 0x8000), (True, 2, 1_772_720_000, 0x7FFFFFFF, 0xF000), (False, 3, 5, 6, 0), (False, 0x104, 0x7FFFFFFF, 1_772_720_000, 0x9000)]
    data = bytearray(volume(entries, pages=2, cycle=cycle))
    struct.pack_into("<QQ", data, 0x260, 0x7000, 0x100000)  # log
    struct.pack_into("<QI", data, 0x288, 0x2000, 7)
    struct.pack_into("<I", data, 0x2F0, 1_700_000_000)
    sound, backup, none, other = (bytearray(data) for _ in range(4))
    struct.pack_into("<QIIQI", sound, 0x298, 0x1000, 0x1000, 0, 0x5000, 0)
    sound[0x5000:0x6000] = sound[0x1000:0x2000]
    struct.pack_into("<Q", sound, 0x5058, 0x3000)  # the backup's chain begins at the second page
    struct.pack_into("<QIIQI", backup, 0x298, 0x5000, 0x1000, 0, 0x1000, 0x1000)
    other[0x230:0x23E] = b"NEW.2031.03.08"
    images = {"sound": sound, "backup": backup, "none": none, "other": other, "noise": bytearray(0x4000)}
    for name, content in images.items():
        (tmp_path / name).write_bytes(content)
    assert formats.volume_version(bytes(data)) == "HIK.2011.03.08" and formats.volume_confidence("HIK.2011.03.08", True) == 0.99
    pages = formats.index_pages(spark.createDataFrame([(n, str(tmp_path / n)) for n in images], "evidence_id string, path string"))
    layouts = formats.volume_layouts(pages)
    got = {r.evidence_id: r for r in layouts.collect()}
    assert {n: (r.tree, r.confidence, r.parse_supported, r.entries) for n, r in got.items()} == {
        "sound": ("primary", 0.99, True, 4), "backup": ("backup", 0.99, True, 4), "none": (None, 0.85, False, None), "other": (None, 0.9, False, None),
    }
    r = got["sound"]
    assert (r.block_size, r.block_count, r.formatted_local.year) == (0x2000, 7, 2023)
    assert [tuple(e) for e in r.index_extents] == [(0x1000, 0x1000), (0x5000, 0x1000)] and [tuple(e) for e in r.log_extents] == [(0x7000, 0x9000)]
    assert r.notes == ([] if cycle else ["the copies of the index differ: 4 and 2 entries"])  # a cycle leads the backup to all pages
    assert got["backup"].notes == ["the primary copy of the index is not valid"]
    rows = sorted((r.tier, r.channel, r.start_local is None, r.end_local is None, tuple(r.extents[0]), r.evidence_id) for r in formats.volume_recordings(pages, layouts).collect())
    one = [("T1", 1, False, False, (0x8000, 0x2000)), ("T1", 0x104, True, True, (0x9000, 0x2000)), ("T2", 2, False, True, (0xF000, 0x1000))]
    assert rows == sorted((*x, e) for x in one for e in ("backup", "sound"))
    assert formats.volume_recordings(pages, layouts, orphans=False).count() == 4


def test_packs_of_an_extent(spark):
    pack = b"\0\0\1\xba" + bytes([0x44, 0, 0x04, 0, 0x04, 0x01, 0, 0, 0x03, 0xF8])
    key, other = b"\0\0\1\xe0\0\0\1\x65" + b"k" * 90, b"\0\0\1\xe0\0\0\1\x41" + b"p" * 30
    data = b"junk" + pack + key + pack + other + b"\0\0\1\xbaodd" + pack + other
    df = spark.createDataFrame([(1, bytearray(data))], "evidence_id int, content binary")
    chunks = df.select("evidence_id", F.explode(carving.windows(F.col("content"), 50, 30)).alias("w")).select("evidence_id", "w.offset", "w.bytes")
    rows = formats.pack_frames(chunks, spark.createDataFrame([(1, 0, len(data) - 5)], "evidence_id int, offset long, length long"), 50).orderBy("sequence").collect()
    assert [(r.kind, r.offset, r.payload_length) for r in rows] == [("I", 4, len(key)), ("P", 4 + 14 + len(key), len(other)), ("P", 4 + 28 + len(key + other) + 7, len(other) - 5)]


def test_export_sets(spark):
    files = [("a", "1", frame()), ("a", "2", b"DAHUA" + b"." * 50 + frame()), ("b", "1", frame()), ("b", "2", b"text"), ("b", "3", b""), ("c", "1", b"text"), ("c", "2", b"DAHUA" + frame()[:-1])]
    got = formats.export_set_probe(spark.createDataFrame([(e, p, bytearray(h)) for e, p, h in files], "evidence_id string, path string, head binary"))
    assert sorted(map(tuple, got.collect())) == [("a", 0.95, 2, 0), ("b", 0.9, 1, 1)]


def test_stream_units(spark):
    stream = b"\0\0\1\x67abc\0\0\1\x65pic\0\0\0\1\x41next\0"
    assert list(formats.nal_units(stream)) == [b"\x67abc", b"\x65pic", b"\x41next"]
    r = formats.stream_summaries(spark.createDataFrame([(1, bytearray(stream))], "stream_id int, content binary")).first()
    want = hashlib.sha256(b"".join(len(u).to_bytes(4, "big") + u for u in (b"\x65pic", b"\x41next"))).hexdigest()
    assert (r.units, r.pictures, r.picture_digest) == (3, 2, want)
    assert formats.picture_kind(stream) == "I"


FRAMES = "evidence_id int, span_id int, offset long, length long, kind string, channel int, local_us long, sequence long, codec string"


def test_runs_break_trim_and_score(spark):
    rows = [
        (1, 1, 0, 10, "P", 1, 0, 0, "h264"), (1, 1, 10, 10, "I", 1, S, 1, "h264"), (1, 1, 20, 10, "P", 1, 2 * S, 2, None), (1, 1, 30, 10, "I", 1, 3 * S, 3, "h264"),
        (1, 1, 45, 10, "I", 1, 4 * S, 4, "h264"), (1, 1, 55, 10, "P", None, None, 3, "h265"), (1, 1, 65, 10, "P", 2, 4 * S, 9, None), (1, 1, 75, 10, "I", 2, S, 10, None), (1, 1, 85, 10, "P", 3, 2 * S, 11, None),
    ]
    got = {r.run: r for r in frames.runs(spark.createDataFrame(rows, FRAMES)).collect()}
    assert {k: (r.offset, r.length, r.channel, r.frame_count, r.keyframes, r.trimmed_bytes, r.ended) for k, r in got.items()} == {
        1: (10, 30, 1, 3, 2, 10, "byte gap of 5"), 2: (45, 10, 1, 1, 1, 0, "sequence number ran backwards"), 4: (75, 10, 2, 1, 1, 0, "channel changed 2 -> 3"),
    }
    made = {r.position: (r.tier, r.confidence) for r in frames.carved_recordings(frames.runs(spark.createDataFrame(rows, FRAMES)), True).collect()}
    assert made == {1: ("T4", 0.9), 2: ("T4", 0.2), 3: ("T4", 0.2)}


def test_ticks_unwrap_like_the_sequential_clock(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for stream in range(30):
        ms, last_tick, last_sec, pts = rng.randint(0, 70_000), None, None, 0
        for k in range(40):
            ms += rng.choice([40, 40, 1000, 66_000, 200_000])
            tick, sec = ms % 65536, None if rng.random() < 0.3 else ms // 1000
            if last_tick is None:
                pts = tick
            else:
                delta = (tick - last_tick) % 65536
                if sec is not None and last_sec is not None:
                    delta += round(((sec - last_sec) * 1000 - delta) / 65536) * 65536
                pts += delta
            last_tick, last_sec = tick, sec if sec is not None else last_sec
            rows.append((stream, k, tick, sec))
            want[stream, k] = pts
    df = spark.createDataFrame(rows, "stream int, offset long, tick int, seconds long")
    assert {(r.stream, r.offset): r.pts_ms for r in frames.unwrapped_ticks(df, ["stream"]).collect()} == want


def test_channel_segments_split_on_steps_and_gaps(spark):
    rows = [(1, 0, 10, "I", 1, 0), (1, 10, 10, "I", 2, 0), (1, 20, 10, "P", 1, S), (1, 30, 10, "P", 1, 10 * S), (1, 40, 10, "audio", 1, 99 * S), (1, 50, 10, "P", 1, 9 * S), (1, 70, 10, "P", 2, S)]
    got = frames.channel_segments(spark.createDataFrame(rows, "path int, offset long, length long, kind string, channel int, local_us long"), ["path"]).collect()
    assert sorted((r.channel, r.offset, r.frame_count, r.start_us, r.end_us) for r in got) == [(1, 0, 2, 0, S), (1, 30, 1, 10 * S, 10 * S), (1, 50, 1, 9 * S, 9 * S), (2, 10, 1, 0, 0), (2, 70, 1, S, S)]


def test_orphans(spark):
    entries = spark.createDataFrame([(1, 1, 1, 0, 10, 0.6), (1, 2, 1, 0, 10, 0.6), (1, 3, 1, 0, 10, 0.6), (1, 4, None, None, None, 0.6)], "evidence_id int, entry_id int, channel int, start_us long, end_us long, confidence double")
    seen = spark.createDataFrame([(1, 1, 0, 1, 5), (1, 2, 0, 2, 50), (1, 4, 0, None, None)], "evidence_id int, entry_id int, offset long, channel int, local_us long")
    got = {r.entry_id: (r.structure_check, r.channel_check, r.time_check, r.tier, round(r.confidence, 3), r.channel) for r in frames.orphan_checks(entries, seen).collect()}
    assert got == {1: ("pass", "pass", "pass", "T2", 0.8, 1), 2: ("pass", "fail", "fail", "T3", 0.2, None), 3: ("fail", None, None, "T3", 0.2, None), 4: ("pass", "inapplicable", "inapplicable", "T2", 0.8, None)}


def test_motion_of_a_moving_box(spark):
    width, height, rows = 32, 24, []
    for k in range(12):
        g = bytearray(width * height)
        if 3 <= k <= 6:
            for y in range(5, 10):
                for x in range(k, k + 6):
                    g[y * width + x] = 200
        rows.append((1, k, width, height, g))
    df = spark.createDataFrame(rows, "recording_id int, frame_no long, width int, height int, gray binary")
    fast = motion.frame_differences(df)
    flat = df.select("recording_id", "frame_no", "width", F.transform(F.sequence(F.lit(1), F.length("gray")), lambda i: F.conv(F.hex(F.substring("gray", i, F.lit(1))), 16, 10).cast("int")).alias("pixels"))
    same = lambda d: sorted((r.frame_no, r.changed, r.x0, r.y0, r.x1, r.y1) for r in d.collect())
    assert same(fast) == same(motion.differences(flat))
    assert same(fast)[3] == (3, 30, 3, 5, 9, 10)
    segments = motion.motion_segments(motion.motion_frames(fast, width * height, 10))
    assert [(r.first_frame, r.last_frame, r.motion_frames) for r in segments.collect()] == [(3, 7, 5)]
    shown = motion.annotations(motion.motion_frames(fast, width * height, 10)).orderBy("frame_no").collect()
    assert [(r.frame_no, r.bbox, r.score, r.note) for r in shown][:2] == [(3, [3, 5, 6, 5], 0.2604, "changed_pixels=30"), (4, [3, 5, 7, 5], 0.0868, "changed_pixels=10")] and len(shown) == 5
    left = (-4, 6, 8, 100)
    assert same(motion.frame_differences(df, region=left)) == same(motion.differences(flat, region=left))
    assert same(motion.frame_differences(df, region=left))[3] == (3, 4, 3, 6, 4, 10)


def test_split_images_are_one_space(spark, tmp_path):
    parts = [b"a" * 700, b"b" * 50, b"c" * 900]
    for k, p in enumerate(parts, 1):
        (tmp_path / f"img.{k:03d}").write_bytes(p)
    whole = b"".join(parts)
    df = evidence.image_windows(spark, str(tmp_path / "img.001"), "E1", chunk=256, overlap=16)
    rows = df.orderBy("offset").collect()
    assert [r.offset for r in rows] == list(range(0, 1650, 256)) and all(bytes(r.bytes) == whole[r.offset : r.offset + 272] for r in rows)
    d = evidence.image_digests(df, 256).first()
    assert (d.md5, d.sha256, d.size) == (hashlib.md5(whole).hexdigest(), hashlib.sha256(whole).hexdigest(), 1650)
    assert [r.offset for r in evidence.image_windows(spark, str(tmp_path / "img.001"), "E1", 256, 0, [(300, 10)]).collect()] == [256]
    (tmp_path / "img.002").unlink()
    with pytest.raises(FileNotFoundError):
        evidence.members_of(str(tmp_path / "img.001"))
    parts = spark.createDataFrame([("x.001",), ("x.002",), ("x.004",), ("y.001",)], "path string")
    assert [(r.stem, r.after) for r in evidence.missing_parts(parts).collect()] == [("x", 2)]


def test_bad_sectors_read_as_zeros_and_are_reported():
    bad = {100, 101, 500}

    def read(file, at, length):
        if any(s in bad for s in range(at // 512, -(-(at + length) // 512))):
            raise OSError("bad")
        return b"x" * length

    data, gaps = evidence.read_at([("f", 2048 * 512)], 0, 2048 * 512, read)
    assert sorted(gaps) == [(s * 512, 512) for s in sorted(bad)] and data.count(b"\0") == 3 * 512
    with pytest.raises(evidence.Unreadable):
        evidence.read_at([("f", 4096 * 512)], 0, 4096 * 512, lambda *a: (_ for _ in ()).throw(OSError("bad")))
    with pytest.raises(evidence.Unreadable):
        evidence.read_at([("f", 1024)], 0, 1024, lambda f, a, n: b"short")


def test_file_set_ingest_and_gaps(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "b.bin").write_bytes(b"bb")
    (tmp_path / "d" / "a.bin").write_bytes(b"aaa")
    rows = evidence.file_set(spark, str(tmp_path)).orderBy("base").collect()
    assert [(r.path.rsplit("/", 1)[1], r.base) for r in rows] == [("b.bin", 0), ("a.bin", 2)]
    cand = spark.createDataFrame([("p", "A", "AB", "ab"), ("q", "B", "x", "y"), ("r", "C", None, "z"), ("known", "A", None, "z")], "source_path string, provenance_class string, stored_md5 string, md5 string")
    got = {r.source_path: r.notes for r in evidence.new_evidence(cand, spark.createDataFrame([("known",)], "source_path string")).collect()}
    assert got == {"p": "stored hash matches", "q": "stored hash MISMATCH", "r": "no stored hash"}
    gaps = spark.createDataFrame([(1, 0, 512), (1, 512, 512), (1, 2048, 512)], "evidence_id int, offset long, length long")
    images = spark.createDataFrame([(1, 4096), (2, 100)], "evidence_id int, size long")
    assert sorted((r.offset, r.length) for r in evidence.merged_gaps(gaps).collect()) == [(0, 1024), (2048, 512)]
    assert sorted((r.evidence_id, r.offset, r.length) for r in evidence.readable_ranges(images, gaps).collect()) == [(1, 1024, 1024), (1, 2560, 1536), (2, 0, 100)]
    changed = evidence.size_changed(spark.createDataFrame([(1, "p", 5), (2, "q", 5)], "evidence_id int, source_path string, capacity_bytes long"), spark.createDataFrame([("p", 5), ("q", 6)], "source_path string, size long"))
    assert [r.evidence_id for r in changed.collect()] == [2]


def test_frame_index_and_gray_frames(spark, tmp_path):
    rows = [(1, 0, "I", 1, 10, 0), (1, 20, "audio", 1, 5, 1), (1, 40, "P", 1, 7, 40), (1, 60, "P", 1, 3, 40)]
    index = export.frame_index(spark.createDataFrame(rows, "path int, offset long, kind string, channel int, payload_length long, pts_ms long"), ["path"])
    assert [(r.n, r.es_offset) for r in index.orderBy("n").collect()] == [(0, 0), (1, 10), (2, 17)]
    sizes = spark.createDataFrame([(1, 20)], "path int, es_bytes long")
    assert [r.problem for r in export.remux_problems(index, ["path"], sizes).collect()] == ["presentation times do not rise"]
    export.write_frame_index(index, str(tmp_path / "i"))
    with pytest.raises(Exception, match="(?i)exists"):
        export.write_frame_index(index, str(tmp_path / "i"))
    gray = export.gray_frames(spark.createDataFrame([(1, bytearray(range(13)))], "recording_id int, content binary"), 2, 2, 2.0)
    assert [(r.frame_no, r.pts_ms, list(r.gray)) for r in gray.collect()] == [(k, k * 500, list(range(4 * k, 4 * k + 4))) for k in range(3)]
