import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tracewell.operators import findings, identify, integrity
from tracewell.sources.casestore import CaseStore, Conflict
from tracewell.streaming import sessions


def test_canonical_form():
    assert integrity.canonical({"b": [1, -0.0, None], "a": "é"}) == '{"a":"é","b":[1,0.0,null]}'
    for bad in (math.nan, math.inf, {1: 2}, b"x", {"a": {2: 1}}):
        with pytest.raises(ValueError):
            integrity.canonical(bad)


def test_canonical_column(spark):
    df = spark.createDataFrame([('{"b":1,"a":[2, 1.50]}',), ("no",), (None,)], "t string")
    assert [r[0] for r in df.select(integrity.canonical_json(F.col("t"))).collect()] == ['{"a":[2,1.5],"b":1}', '{"unparsable_json":"no"}', None]


def chain(n, case="c"):
    rows, prev = [], integrity.GENESIS
    for seq in range(n):
        body = {"seq": seq, "ts_utc": f"2026-01-01T00:00:{seq:02d}.000000Z", "operator": "op", "action": "x", "target": None, "params": {"k": seq}, "result": "ok", "hash_before": None, "hash_after": None, "prev_digest": prev}
        digest = hashlib.sha256(integrity.canonical(body).encode()).hexdigest()
        rows.append({**body, "params": json.dumps(body["params"]), "digest": digest, "case_id": case})
        prev = digest
    return rows


AUDIT = "case_id string, seq long, ts_utc string, operator string, action string, target string, params string, result string, hash_before string, hash_after string, prev_digest string, digest string"


def verify(spark, rows):
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in AUDIT.split(", ")) for r in rows], AUDIT)
    return integrity.verify_chain(df, digest_of=integrity.record_digest(integrity.body_json())).first()


def test_chain_verifies_and_every_change_is_found(spark):
    rows = chain(12)
    r = verify(spark, rows)
    assert (r.ok, r.records_checked, r.broken_at, r.warnings) == (True, 12, None, [])
    changed = [dict(x) for x in rows]
    changed[5]["operator"] = "other"
    assert verify(spark, changed).broken_at == 5
    assert verify(spark, rows[:3] + rows[4:]).reason.startswith("sequence break: expected 3, found 4")
    forged = [dict(x) for x in rows]
    forged[7]["prev_digest"] = "0" * 64
    assert "link" in verify(spark, forged).reason and verify(spark, forged).records_checked == 7
    late = chain(3)
    late[2]["ts_utc"], late[2]["result"] = "2025-01-01T00:00:00.000000Z", "odd"
    late[2]["digest"] = hashlib.sha256(integrity.canonical({**{c: late[2][c] for c in integrity.BODY}, "params": {"k": 2}}).encode()).hexdigest()
    r = verify(spark, late)
    assert r.ok and len(r.warnings) == 2


def test_store_manifest_and_case(spark, tmp_path):
    store = CaseStore(spark, str(tmp_path / "case")).create().open()
    with pytest.raises(Exception, match="(?i)exists"):
        store.create()
    rows = spark.createDataFrame([("E1", 0, 10, "parsed"), ("E2", 0, 5, "carved")], "evidence_id string, offset long, length long, bucket string")
    store.append("coverage", rows)
    store.replace_evidence("coverage", rows.where("evidence_id = 'E1'").withColumn("length", F.lit(99).cast("long")))
    assert sorted((r.evidence_id, r.length) for r in store.table("coverage").collect()) == [("E1", 99), ("E2", 5)]
    move = "evidence_id string, seq long, from_holder string, to_holder string, purpose string, seal_intact int, ts_utc string"
    store.transfer(spark.createDataFrame([("E1", 0, "a", "b", "lab", 1, "t")], move))
    with pytest.raises(ValueError):
        store.transfer(spark.createDataFrame([("E1", 1, " ", "b", "lab", None, "t")], move))
    assert [r.id for r in store.numbered("coverage", rows, "COV", ["evidence_id"]).orderBy("id").collect()] == ["COV-003", "COV-004"]
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, content string")
    manifest = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest()), ("b", "0"), ("c", "0")], "path string, sha256 string")
    problems = integrity.manifest_problems(manifest, files)
    assert {(r.path, r.problem) for r in problems.collect()} == {("b", "changed"), ("c", "missing")}
    chains = spark.createDataFrame([("c", True, 3, None)], "case_id string, ok boolean, records_checked long, reason string")
    whole = integrity.case_verified(chains, problems.withColumn("case_id", F.lit("c")), spark.createDataFrame([("c", 4)], "case_id string, audit_records long")).first()
    assert not whole.ok and len(whole.problems) == 3


COVERAGE = "evidence_id string, offset long, length long, bucket string"


def test_case_commits(spark, tmp_path, monkeypatch):
    store = CaseStore(spark, str(tmp_path / "case")).create().open()
    rows = lambda *r: spark.createDataFrame(list(r), COVERAGE)
    store.append("coverage", rows(("E1", 0, 1, "parsed"), ("E2", 0, 2, "parsed")))
    store.append("coverage", rows(("E3", 0, 3, "parsed")))
    lengths = lambda version=None: sorted((r.evidence_id, r.length) for r in store.table("coverage", version).collect())
    # a transaction of several tables is seen whole or not at all, and can be read inside
    with pytest.raises(RuntimeError, match="stop"), store.transaction() as work:
        work.append("coverage", rows(("E4", 0, 4, "parsed")))
        work.replace_evidence("coverage", rows(("E1", 0, 9, "carved")))
        assert work.table("coverage").count() == 4
        raise RuntimeError("stop")
    assert lengths() == [("E1", 1), ("E2", 2), ("E3", 3)] and store.version() == 2
    # a crash between the files and the commit leaves the old rows, and files that are nobody's
    with monkeypatch.context() as m:
        m.setattr(CaseStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            store.replace_evidence("coverage", rows(("E1", 0, 7, "carved")))
    assert lengths() == [("E1", 1), ("E2", 2), ("E3", 3)]
    assert store.vacuum() == 0 and store.vacuum(-1) > 0
    before = {f for f in store.state()["tables"]["coverage"]}
    store.replace_evidence("coverage", rows(("E1", 0, 5, "carved"), ("E1", 5, 6, "parsed")))
    assert lengths() == [("E1", 5), ("E1", 6), ("E2", 2), ("E3", 3)] and lengths(2) == [("E1", 1), ("E2", 2), ("E3", 3)]
    assert before & set(store.state()["tables"]["coverage"])  # E3's file is not written anew
    # appends at once both stay; a replacement on a state that has changed is refused
    with store.transaction() as one:
        one.append("coverage", rows(("E5", 0, 5, "parsed")))
        store.append("coverage", rows(("E6", 0, 6, "parsed")))
    assert {k for k, _ in lengths()} == {"E1", "E2", "E3", "E5", "E6"}
    with pytest.raises(Conflict, match="coverage"), store.transaction() as one:
        one.replace_evidence("coverage", rows(("E2", 0, 8, "parsed")))
        store.append("coverage", rows(("E7", 0, 7, "parsed")))
    assert ("E2", 2) in lengths() and ("E7", 7) in lengths()


def test_two_appends_to_one_chain(spark, tmp_path):
    store = CaseStore(spark, str(tmp_path / "case")).create()
    new = spark.createDataFrame([("C", 1, "2026-01-01T00:00:00.000000Z", "op", "case.create", "C", "{}", "ok", None, None)], "case_id string, n int, ts_utc string, operator string, action string, target string, params string, result string, hash_before string, hash_after string")
    store.append_records(new)
    with pytest.raises(Conflict, match="audit"), store.transaction() as late:
        late.append("audit", integrity.append_records(late.table("audit"), new))
        store.append_records(new)
    rows = store.table("audit").orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1] and rows[1].prev_digest == rows[0].digest
    assert integrity.verify_chain(store.table("audit"), digest_of=integrity.record_digest(integrity.body_json())).first().ok


def test_commits_from_threads_are_all_there(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = CaseStore(spark, str(tmp_path / "case")).create()
    with ThreadPoolExecutor(4) as threads:
        list(threads.map(lambda k: store.append("coverage", spark.createDataFrame([(f"E{k}", 0, k, "parsed")], COVERAGE)), range(8)))
    assert store.version() == 8 and sorted(r.length for r in store.table("coverage").collect()) == [*range(8)]


def test_artefacts_keep_the_first(spark):
    df = spark.createDataFrame([("p2", 1, "x"), ("p1", 1, "x"), ("p0", 2, "x"), ("q", 0, "y")], "path string, created long, content string")
    assert {(r.path, r.copies) for r in integrity.content_addressed(df).collect()} == {("p1", 3), ("q", 1)}


def test_identify_never_selects_among_several(spark):
    images = spark.createDataFrame([(1,), (2,), (3,)], "evidence_id int")
    cands = spark.createDataFrame([(1, "a", 0.9, None, True), (2, "a", 0.5, None, True), (2, "b", 0.9, None, False)], "evidence_id int, family string, confidence double, layout string, parses boolean")
    made = identify.identify(images, cands)
    assert {r.evidence_id: (r.status, r.family, r.support) for r in made.collect()} == {1: ("identified", "a", "parse"), 2: ("ambiguous", None, "pending_selection"), 3: ("unknown", None, "none")}
    assert [r.family for r in made.where("evidence_id = 2").first().candidates] == ["b", "a"]
    choice = identify.select_family(made, cands, spark.createDataFrame([(2, "b")], "evidence_id int, family string"))
    assert choice.where("evidence_id = 2").first().support == "carve_only"
    with pytest.raises(Exception, match="candidate"):
        identify.select_family(made, cands, spark.createDataFrame([(2, "zz")], "evidence_id int, family string")).collect()


def plan_model(size, windows=32, window=1 << 20):
    head, tail = min(window, size), max(0, size - window)
    out, span = [("lba0", 0, min(512, size)), ("head", 0, head), ("tail", tail, size - tail)], tail - head
    end = -1
    if span > 0:
        for i in range(windows):
            s = head + int(i * (span / windows))
            n = min(window, tail - s)
            if n > 0 and s >= end:
                out.append(("sweep", s, n))
                end = s + n
    return sorted(x for x in out if x[2])


def test_probe_plans(spark):
    sizes = [1, 511, 1 << 20, (1 << 20) + 5, 5 << 20, 33_554_433, 100 << 20, 12 << 40]
    df = spark.createDataFrame(list(enumerate(sizes)), "evidence_id int, size long")
    got = {}
    for r in identify.probe_plan(df).collect():
        got.setdefault(r.evidence_id, []).append((r.region, r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: plan_model(s) for k, s in enumerate(sizes)}


def test_magics(spark):
    head = bytearray(4096)
    head[510:512], head[3:11] = b"\x55\xaa", b"NTFS    "
    got = identify.observations(spark.createDataFrame([(1, head)], "evidence_id int, head binary")).collect()
    assert {r.offset for r in got} == {510, 3}


def test_findings_document_is_the_same_whatever_the_order(spark):
    rows = [(1, "b", 2.0), (1, "a", None), (2, "c", 1.5)]
    make = lambda r: findings.findings_document({"x": spark.createDataFrame(r, "evidence_id int, k string, v double"), "y": spark.createDataFrame([(1, "q")], "evidence_id int, z string")})
    one, two = ({r.evidence_id: (r.document, r.digest) for r in make(x).collect()} for x in (rows, rows[::-1]))
    assert one == two
    assert one[1][0] == '{"x":[{"k":"a","v":null},{"k":"b","v":2.0}],"y":[{"z":"q"}]}'
    assert one[1][1] == hashlib.sha256(one[1][0].encode()).hexdigest()


def test_custody_names_ignore_case_and_space(spark):
    rows = [(1, 0, "x", "Officer A"), (1, 1, " officer a ", "Lab"), (1, 2, "Court", "Store")]
    got = findings.custody_breaks(spark.createDataFrame(rows, "evidence_id int, seq int, from_holder string, to_holder string")).collect()
    assert [(r.seq, r.expected, r.found) for r in got] == [(2, "Lab", "Court")]


def streamed(spark, tmp_path, batches, schema, transform, name):
    folder = str(tmp_path / name)
    spark.createDataFrame([], schema).write.parquet(folder)
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = transform(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_sessions_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    from tracewell.operators import motion

    moving = [0, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 1]
    rows = [(1, k, bool(m)) for k, m in enumerate(moving)]
    batches = [rows[:7], rows[7:15], rows[15:] + [(1, None, False)]]
    got = streamed(spark, tmp_path, batches, "recording_id int, frame_no long, motion boolean", sessions.motion_sessions, "sessions")
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "recording_id int, frame_no long, motion boolean, score double")
    want = motion.motion_segments(df).collect()
    assert sorted((r.first_frame, r.last_frame, r.motion_frames) for r in got) == sorted((r.first_frame, r.last_frame, r.motion_frames) for r in want) == [(1, 5, 3), (12, 13, 2)]


def test_gaps_of_a_stream(spark, tmp_path):
    s = 1_000_000
    batches = [[(1, 1, 0, 10 * s, s)], [(1, 1, 30 * s, 40 * s, 0), (1, 2, 0, 5 * s, 0)], [(1, 2, 5 * s, 9 * s, 0)]]
    got = streamed(spark, tmp_path, batches, "evidence_id int, channel int, start_us long, end_us long, uncertainty_us long", sessions.channel_gaps, "gaps")
    assert [(r.channel, r.gap_start_us, r.gap_end_us) for r in got] == [(1, 11 * s, 30 * s)]


def test_tender_withholds_what_changed_or_is_gone(spark):
    from tracewell.operators import certificate as c

    sha = lambda b: hashlib.sha256(b).hexdigest()
    arts = spark.createDataFrame([(sha(b"a"), "a", "report", 1), (sha(b"b"), "b", "findings", 1), (sha(b"c"), "c", "report", 9), (sha(b"d"), "d", "tool_log", 1)], "sha256 string, path string, kind string, size_bytes long")
    rows = c.tender_rows(arts, spark.createDataFrame([("a", "a"), ("b", "changed"), ("d", "d")], "path string, content string"))
    assert {(r.artefact, r.kind) for r in c.tendered(rows).collect()} == {("a", "report")}
    assert {(r.artefact, r.kind, r.md5, r.size_bytes) for r in c.withheld(rows).collect()} == {("b", "WITHHELD - findings", "", 1), ("c", "WITHHELD - report", "", 9)}
    dates = spark.sql("select date'2024-06-30' d union all select date'2024-07-01' union all select null").select(c.statute_for(F.col("d"))).collect()
    assert [r[0] for r in dates] == ["IEA_65B", "BSA_63", "BSA_63"]
    att = c.attached(spark.createDataFrame([("panchnama", "x"), ("photograph", "y")], "kind string, content string")).collect()
    assert [r.statute is None for r in att] == [False, True]
    with pytest.raises(Exception, match="attachment"):
        c.attached(spark.createDataFrame([("diary", "x")], "kind string, content string")).collect()
    tz = "evidence_id int, tz_offset_s int"
    assert {(r.evidence_id, r.tz_offset_s) for r in c.stated_timezones(spark.createDataFrame([(1, 19800), (1, None), (2, None)], tz)).collect()} == {(1, 19800), (2, None)}
    with pytest.raises(Exception, match="timezones"):
        c.stated_timezones(spark.createDataFrame([(1, 0), (1, 3600)], tz)).collect()


def test_operations_appended_verify_and_manifests_follow(spark):
    kind = "case_id string, n long, ts_utc string, ended_utc string, operator string, action string, target string, params string, outcome string, error_type string, error string, hash_before string, hash_after string"
    rows = [("a", 1, "1", "2", "x", "scan", "t", '{"b": 1, "a": -0.0}', '{"hits": 2}', None, None, None, "h"), ("a", 2, "3", "4", "x", "export", None, None, None, "IOError", "gone", "g", "h"), ("b", 1, "1", "2", "x", "scan", "é", "{}", "{}", None, None, None, None)]
    none = spark.createDataFrame([], "case_id string, seq long, digest string")
    first = spark.createDataFrame(integrity.append_records(none, integrity.operation_records(spark.createDataFrame(rows[:1], kind))).collect(), "case_id string, seq long, ts_utc string, operator string, action string, target string, params string, result string, hash_before string, hash_after string, prev_digest string, digest string")
    all_ = first.unionByName(integrity.append_records(first, integrity.operation_records(spark.createDataFrame(rows[1:], kind))))
    got = {(r.case_id, r.seq): (r.action, r.result, r.params, r.hash_after) for r in all_.collect()}
    assert got == {
        ("a", 0): ("scan.start", "started", '{"a":0.0,"b":1}', None), ("a", 1): ("scan.complete", "ok", '{"hits":2,"start_seq":0}', "h"),
        ("a", 2): ("export.start", "started", "{}", None), ("a", 3): ("export.error", "error", '{"error":"gone","error_type":"IOError","start_seq":2}', None),
        ("b", 0): ("scan.start", "started", "{}", None), ("b", 1): ("scan.complete", "ok", '{"start_seq":0}', None),
    }
    checked = integrity.verify_chain(all_, digest_of=integrity.record_digest(integrity.body_json())).collect()
    assert {(r.case_id, r.ok, r.records_checked, tuple(r.warnings)) for r in checked} == {("a", True, 4, ()), ("b", True, 2, ())}

    evidence = spark.createDataFrame([("a", "e2", None, "s", 5), ("a", "e1", "m", None, None)], "case_id string, evidence_id string, md5 string, sha256 string, capacity_bytes long")
    old = integrity.case_manifests(integrity.chain_heads(first), evidence, evidence.select("case_id"), 2)
    digest = first.where("seq = 1").first().digest
    assert old.first().manifest == '{"artifact_count":2,"audit":{"head_digest":"%s","head_seq":1},"case_id":"a","evidence":[{"id":"e1","md5":"m","sha256":null,"size":null},{"id":"e2","md5":null,"sha256":"s","size":5}],"schema_version":2}' % digest
    assert [tuple(r) for r in integrity.manifest_heads(old, all_).collect()] == [("a", None, "the manifest is behind the chain, which ends at 3")]
    new = integrity.case_manifests(integrity.chain_heads(all_), evidence, evidence.select("case_id"), 2)
    assert {r.case_id: r.problem for r in integrity.manifest_heads(new, first).collect()} == {"a": "the manifest's head 3 is not in the chain", "b": "the manifest's head 1 is not in the chain"}
    assert integrity.manifest_heads(spark.createDataFrame([("a", "{")], "case_id string, manifest string"), all_).first().problem == "the manifest states no head"


def test_forms_name_what_the_form_does_not_list(spark):
    from tracewell.operators import certificate

    rows = [("DVR", ["Owned", "Operated"], 1), ("Tape", ["Owned", "Lent"], 0), (None, None, None)]
    got = [r.problems for r in certificate.form_problems(spark.createDataFrame(rows, "source_type string, control_modes array<string>, instance int")).collect()]
    assert got == [[], ["the form has no such source", "the form has no such control: Lent", "submissions are numbered from 1"], ["the form has no such source", "submissions are numbered from 1"]]


def test_chains_stay_whole_where_a_join_is_broadcast_at_run_time(spark):
    """What the planner took for a large join turns out small while it runs: its shuffle may be read in pieces then."""
    set_ = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "100MB", "adaptive.coalescePartitions.enabled": "false"}
    for c, v in set_.items():
        spark.conf.set(f"spark.sql.{c}", v)
    try:
        rows = spark.range(0, 4000, 1, 8).selectExpr(
            "id % 5 as case_id", "id as n", "'t' as ts_utc", "'o' as operator", "'a' as action", "'x' as target", "'{}' as params", "'ok' as result", "cast(null as string) as hash_before", "cast(null as string) as hash_after"
        )
        made = integrity.append_records(spark.createDataFrame([(0, 6, "f" * 64)], "case_id long, seq long, digest string"), rows).collect()
        joined = rows.join(spark.range(5).withColumnRenamed("id", "case_id"), "case_id", "left")
        heads = {r.case_id: (r.head, r.records) for r in integrity.fold_chain(joined, "case_id", "n", "target").collect()}
        linked = integrity.stored_chain(joined, "case_id", "n", "target").groupBy("case_id").count().collect()
    finally:
        for c in set_:
            spark.conf.unset(f"spark.sql.{c}")
    for case in range(5):
        mine = sorted((r.seq, r.prev_digest, r.digest) for r in made if r.case_id == case)
        assert [s for s, *_ in mine] == list(range(7 if case == 0 else 0, 807 if case == 0 else 800))
        assert [p for _, p, _ in mine] == [("f" if case == 0 else "0") * 64, *(d for *_, d in mine[:-1])]
        head = "0" * 64
        for _ in range(800):
            head = hashlib.sha256((head + "x").encode()).hexdigest()
        assert heads[case] == (head, 800)
    assert {(r.case_id, r["count"]) for r in linked} == {(k, 800) for k in range(5)}
