import random
import struct

import pytest

from tests.test_bytes import frame, image, plain_recordings, volume
from tracewell.sources import evidence as sources
from tracewell.sources import families

CHUNK = 4096


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    """A mixed case: an indexed volume, carved frames, a set of files, and bytes that nobody knows."""
    top = tmp_path_factory.mktemp("case")
    carved = image(random.Random(4), 50)
    entries = [(False, 1, 1_772_720_262, 1_772_723_862, 0x8000), (True, 2, 1_772_720_262, 1_772_723_862, 0x9000)]
    data = bytearray(volume(entries))
    struct.pack_into("<QI", data, 0x288, 0x1000, 7)
    struct.pack_into("<QI", data, 0x298, 0x1000, 0x1000)
    (top / "volume.dd").write_bytes(data)
    (top / "frames.dd").write_bytes(b"\0" * 512 + carved)
    (top / "text.dd").write_bytes(b"nothing of note " * 500)
    (top / "set" / "b").mkdir(parents=True)
    (top / "set" / "a.dav").write_bytes(carved[:1000])
    (top / "set" / "b" / "c.dav").write_bytes(carved[1000:])
    paths = {name: str(top / name) for name in ("volume.dd", "frames.dd", "text.dd", "set")}
    return families.open_images(spark, paths, CHUNK, 512), carved


def test_identification_joins_all_families(case):
    known = {r.evidence_id: (r.status, r.family, r.support) for r in families.identified(case[0]).collect()}
    assert known == {
        "volume.dd": ("identified", "hikvision", "parse"), "frames.dd": ("identified", "dahua", "carve_only"),
        "set": ("identified", "dahua", "carve_only"), "text.dd": ("unknown", None, "none"),
    }


def test_each_family_parses_and_carves_its_own(spark, case):
    evidence, carved = case
    known = families.identified(evidence)
    made = families.parsed(evidence, known, orphans=True)
    assert [(r.evidence_id, r.version[:8], r.family) for r in made["layouts"].collect()] == [("volume.dd", "HIK.2011", "hikvision")]
    assert sorted((r.tier, r.channel, r.local_end_us - r.local_start_us) for r in made["recordings"].collect()) == [("T1", 1, 3_600_000_000), ("T2", 2, 3_600_000_000)]
    assert {r.evidence_id: r.reason for r in made["refused"].collect()} == {"frames.dd": "the family has no layout", "set": "the family has no layout", "text.dd": "the format is unknown"}
    holes = spark.createDataFrame([("set", 1024, 512), ("volume.dd", 0, 512)], "evidence_id string, offset long, length long")
    made = families.carved(evidence, known, holes)
    rows = {}
    for r in made["recordings"].collect():
        rows.setdefault((r.evidence_id, r.tier), []).append((r.extents[0].offset, r.extents[0].length, r.codec))
    plain = lambda data, gaps: [(o, n, c) for o, n, _, _, c in plain_recordings(data, gaps)]
    assert {k: sorted(v) for k, v in rows.items()} == {("frames.dd", "T3"): plain(b"\0" * 512 + carved, []), ("set", "T4"): plain(carved, [(1024, 512)])}  # a file border is none in the set's space
    assert {r.evidence_id: r.reason for r in made["refused"].collect()} == {"volume.dd": "the family has no carve", "text.dd": "the format is unknown"}


def test_unregistered_families_are_refused_rows(spark, case):
    known = spark.createDataFrame([("text.dd", "identified", "other", "parse")], "evidence_id string, status string, family string, support string")
    assert [r.reason for r in families.refused(known, "layout").collect()] == ["no family is registered as other"]
    assert families.parsed(case[0], known)["recordings"].collect() == []


def test_registration(monkeypatch):
    monkeypatch.setattr(families, "FAMILIES", dict(families.FAMILIES))
    one = families.Family("third", (), probe=lambda e: e.images)
    families.register(one)
    with pytest.raises(ValueError, match="already"):
        families.register(one)
    with pytest.raises(ValueError, match="go together"):
        families.register(families.Family("fourth", (), probe=one.probe, layout=one.probe))
    with pytest.raises(ValueError, match="no such"):
        families.register(families.Family("fifth", (), probe=one.probe, signatures=("what",)))


def test_sources_by_kind(spark, tmp_path):
    (tmp_path / "x.E01").write_bytes(b"")
    with pytest.raises(NotImplementedError):
        sources.open_source(spark, str(tmp_path / "x.E01"), "x")
    with pytest.raises(FileNotFoundError):
        sources.open_source(spark, str(tmp_path / "none"), "x")


def test_a_set_of_files_is_one_space(spark, tmp_path):
    names = ["a/b/1", "a/2", "a-c", "z"]
    data = {n: (n.encode() + b"." * 7) * (50 * k) for k, n in enumerate(names)}  # the first is empty
    for n, d in data.items():
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(d)
    members = sources.file_set(spark, str(tmp_path)).orderBy("base", "length").collect()
    whole = b"".join(open(r.path, "rb").read() for r in members)
    assert [r.base for r in members] == [sum(x.length for x in members[:k]) for k in range(len(members))] and len(members) == 4
    rows = sources.image_windows(spark, str(tmp_path), "S", 300, 20).orderBy("offset").collect()
    assert all(bytes(r.bytes) == whole[r.offset : r.offset + 320] for r in rows) and [r.offset for r in rows] == list(range(0, len(whole), 300))


def test_a_million_members_plan_without_a_task(monkeypatch):
    monkeypatch.setattr(sources, "members_of", lambda path: [(f"{path}/{k}", 1000 + k % 7) for k in range(1_000_000)])
    windows = sources._ImageReader({"path": "/set"}).partitions()
    size = sum(1000 + k % 7 for k in range(1_000_000))
    assert len(windows) == -(-size // sources.CHUNK) and all(len(w.members) < 70_000 for w in windows)
    assert all(w.base <= w.offset < w.base + w.members[0][1] for w in windows)
