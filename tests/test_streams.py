import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tests.test_bytes import frame, windows_of
from tracewell.sources import formats, streams


def test_streams_are_joined_in_order_and_told(spark, tmp_path):
    rng = random.Random(1)
    parts = {f"r{k}.h264": [rng.randbytes(rng.randrange(2000)) for _ in range(rng.randrange(1, 40))] for k in range(12)}
    rows = [(name, n, bytearray(p)) for name, ps in parts.items() for n, p in enumerate(ps)]
    rng.shuffle(rows)
    made = streams.write_streams(spark.createDataFrame(rows, streams.STREAM).repartition(5), str(tmp_path)).collect()
    assert {r.name: (r.size, r.rows, r.sha256, r.md5) for r in made} == {name: (len(b := b"".join(ps)), len(ps), hashlib.sha256(b).hexdigest(), hashlib.md5(b).hexdigest()) for name, ps in parts.items()}
    assert {n: (tmp_path / n).read_bytes() for n in parts} == {n: b"".join(ps) for n, ps in parts.items()}
    assert sorted(os.listdir(tmp_path)) == sorted([*parts, "_manifests"])
    with pytest.raises(Exception, match="refusing to overwrite"):
        streams.write_streams(spark.createDataFrame([("new", 0, bytearray(b"x")), ("r1.h264", 0, bytearray(b"x"))], streams.STREAM), str(tmp_path))
    assert not (tmp_path / "new").exists() and (tmp_path / "r1.h264").read_bytes() == b"".join(parts["r1.h264"]) and not (tmp_path / "_temporary").exists()


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{k}", n, bytearray(b"x" * 100)) for k in range(4) for n in range(5)], streams.STREAM)
    broken = rows.withColumn("bytes", F.when((F.col("name") == "r2") & (F.col("n") == 3), F.raise_error("bad sector").cast("binary")).otherwise(F.col("bytes")))
    with pytest.raises(Exception, match="bad sector"):
        streams.write_streams(broken, str(tmp_path))
    assert [n for n in os.listdir(tmp_path) if n != "_temporary"] == [] and not any(f for _, _, f in os.walk(tmp_path))
    assert {r.rows for r in streams.write_streams(rows, str(tmp_path)).collect()} == {5}
    twice = spark.createDataFrame([("a", 1, bytearray(b"x")), ("a", 1, bytearray(b"y"))], streams.STREAM)
    with pytest.raises(Exception, match="not in order"):
        streams.write_streams(twice, str(tmp_path))


def test_recordings_are_exported_with_their_index(spark, tmp_path):
    rng = random.Random(3)
    data, truth = bytearray(b"head"), {1: [], 2: []}
    for i in range(60):
        channel, kind, payload = 1 + i % 2, rng.choice([0xFD, 0xFC, 0xF0]), rng.randbytes(rng.randrange(1, 300))
        at = len(data)
        data += frame(kind, channel, i, payload=payload)
        if kind != 0xF0:
            truth[channel].append((at, payload))
    image = tmp_path / "image.dd"
    image.write_bytes(data)
    walk = formats.frames_of_windows(spark.createDataFrame(windows_of(bytes(data), 1000), "evidence_id int, offset long, bytes binary"), chunk=1000)
    recordings = spark.createDataFrame([("REC-1", 1, "h264", 0, len(data)), ("REC-2", 2, "h265", 0, len(data))], "recording_id string, channel int, codec string, offset long, length long")
    made, index = streams.export_recordings(recordings, walk, str(image), str(tmp_path / "out"))
    for k, name in ((1, "REC-1.h264"), (2, "REC-2.h265")):
        stream = (tmp_path / "out" / name).read_bytes()
        assert stream == b"".join(p for _, p in truth[k])
        lines = [json.loads(x) for x in (tmp_path / "out" / f"REC-{k}.frames.jsonl").read_text().splitlines()]
        assert [(x["source_offset"], stream[x["es_offset"] : x["es_offset"] + x["size"]]) for x in lines] == truth[k]
    assert made.count() == 4 and index.count() == sum(map(len, truth.values()))
    with pytest.raises(ValueError, match="no video frames"):
        streams.export_recordings(recordings.withColumn("channel", F.lit(9)), walk, str(image), str(tmp_path / "none"))


def test_artefacts_are_kept_under_their_digest(spark, tmp_path):
    rows = spark.createDataFrame([("report", "R1", bytearray(b"one")), ("log", "R2", bytearray(b"one")), ("log", None, bytearray(b""))], "kind string, recording_id string, content binary")
    for _ in range(2):  # again: the same files
        made = streams.keep_artefacts(rows, str(tmp_path), "2026-01-01").collect()
        assert {(r.kind, r.sha256, r.size_bytes) for r in made} == {("report", h := hashlib.sha256(b"one").hexdigest(), 3), ("log", h, 3), ("log", hashlib.sha256(b"").hexdigest(), 0)}
        assert all(hashlib.sha256(open(r.path, "rb").read()).hexdigest() == r.sha256 for r in made)
