import hashlib
import random
import re

import numpy as np
import pytest

from tracewell.llm import exact_dedup, line_dedup, mixing, spotsigs, warc

DOCS = "doc_id long, text string"


# --- exact dedup ------------------------------------------------------------------------
def test_equal_texts_without_white_space(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh é\n") for _ in range(60_000))
    rows = [(5, "a b"), (2, "ab"), (3, "a\tb\r\n"), (4, "ab "), (7, None), (8, ""), (9, " \v\f"), (10, "a b"), (11, long), (12, " " + long), (13, long + "x"), (None, "ab"), (6, "solo"), (6, "solo"), (-(2**63), "low"), (2**63 - 1, "low")]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS).repartition(3)).collect())
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(bare(t), []).append((d, t or ""))
    want = []
    for key, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        want += [(-1 if d is None else d, best[0], len(members), d == best[0] and len(t) == len(best[1]), hashlib.sha256(key.encode()).hexdigest()) for d, t in members]
    assert got == sorted(want)


def test_a_shared_identifier_is_found_and_renamed(spark, monkeypatch):
    true = exact_dedup.chunk_id

    def weak(chunk, salt):
        return b"same" * 4 if salt == 0 else true(chunk, salt)

    monkeypatch.setattr(exact_dedup, "chunk_id", weak)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(exact_dedup)  # so that tasks see the weak names
    try:
        got = exact_dedup.exact_groups(spark.createDataFrame([(1, "x"), (2, "y")], DOCS)).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(exact_dedup)
    assert all(r.group_size == 1 for r in got)


def test_cuts_follow_the_content():
    rng = random.Random(2)
    a, b = rng.randbytes(200_000), rng.randbytes(999)
    chunks = lambda d: {d[s:e] for s, e in zip([0, *exact_dedup.cuts(d)], exact_dedup.cuts(d))}
    one, two = chunks(a), chunks(b + a)
    assert len(one & two) > 0.9 * len(one)
    for data in (b"", b"x", bytes(100_000), a):
        ends = exact_dedup.cuts(data)
        assert ends[-1] == len(data) and all(0 < e - s <= exact_dedup.MOST for s, e in zip([0, *ends], ends)) or not data


# --- lines ------------------------------------------------------------------------------
def test_lines_in_ten_documents_go(spark):
    rows = [(i, f"own {i}\n  Common LINE\t\nÉ{i}\n\nend{i}") for i in range(9)]
    rows += [(100, "common line"), (101, "É\ncommon  line"), (102, None), (103, ""), (104, "\n\n"), (105, "rep\nrep"), (105, "common line\nx")]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS).repartition(2)).collect())
    want = [(i, f"own {i}\nÉ{i}\n\nend{i}", 5, 1) for i in range(9)]
    want += [(100, "", 1, 1), (101, "É\ncommon  line", 2, 0), (102, "", 1, 0), (103, "", 1, 0), (104, "\n\n", 3, 0), (105, "rep\nrep", 2, 0), (105, "x", 2, 1)]
    assert got == sorted(want)
    nine = [r for r in rows if r[0] not in (100, 105)]
    assert all(r.n_dropped == 0 for r in line_dedup.line_dedup(spark.createDataFrame(nine, DOCS)).collect())


def test_only_ascii_letters_fold_and_other_columns_pass(spark):
    rows = [(i, "É" if i % 2 else "é", f"s{i}", 3) for i in range(18)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, a string, n_lines long"))
    assert got.columns == ["doc_id", "text", "a", "n_lines", "n_dropped"]
    assert all(r.n_dropped == 0 for r in got.collect())
    assert line_dedup.line_dedup(spark.createDataFrame([], DOCS)).collect() == []


# --- mixing -----------------------------------------------------------------------------
def filled(sizes, weights, budget):
    """Targets by resharing: the excess over twice a source's size goes to the others by weight, again and again."""
    target = {}
    free = dict(weights)
    while True:
        level = (budget - sum(target.values())) / sum(free.values()) if free else 0
        over = [s for s in free if free[s] * level > 2 * sizes[s]]
        if not over:
            return target | {s: free[s] * level for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            del free[s]


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_budgets(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "é", "z", None, ""]
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(names[: 3 + seed] if rng.random() < 0.7 else names[-2:])) for i in range(400)] + [(1000, None, "a"), (3, "again word", "a")]
    got = [r.asDict() for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["__source_size"] == sizes[r["source"]] and abs(r["__target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["__taken"] <= 2 * r["__size"]
        taken[r["source"]] += r["__taken"]
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i, f" a{i}  b{i}\nc{i} ", "s" if i % 3 else "t") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.doc_id: r["__taken"] for r in mixing.mix(df).collect()}
    texts = {}
    for r in mixing.mixed_documents(df).collect():
        texts[r.doc_id] = texts.get(r.doc_id, 0) + len(r.text.split())
    assert {d: texts.get(d, 0) for d in plan} == plan
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).collect() == []
    none = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r["__taken"], r["__target"]) for r in mixing.mix(none).collect()} == {(0, 0.0)}


# --- spot signatures --------------------------------------------------------------------
def spots(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    content = [i for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    found = set()
    for j in range(len(content) - spotsigs.CHAIN + 1):
        chain = tuple(words[i] for i in content[j : j + spotsigs.CHAIN])
        found |= {(w, *chain) for w in words[(content[j - 1] + 1 if j else 0) : content[j]]}
        if j == 0:
            found.add(("^", *chain))
        elif j >= spotsigs.RUN and content[j - 1] - content[j - spotsigs.RUN] == spotsigs.RUN - 1:
            found.add((words[content[j - 1]], *chain))
    return found or ({tuple(words)} if words else set())


def test_fingerprints_and_likeness_against_sets(spark):
    rng = random.Random(4)
    words = ["the", "of", "und", "la", "apple", "pear", "plum", "kiwi", "fig", "lime", "Straße"]
    rows = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 30, 80])))) for i in range(60)] + [(900, " | ".join(f"x{i % 17}" for i in range(40))), (1000, None), (1001, "no anchors here"), (1002, "no, anchors here!")]
    got = {r.doc_id: r for r in spotsigs.fingerprints(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    texts = [t or "" for _, t in rows]
    near = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for k, (d, _) in enumerate(rows):
        t, following = texts[k], texts[(k + 1) % len(rows)]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert len(r.fingerprint) == 16 * len(spots(t))
        assert abs(r.near_edited - near(spots(t), spots(changed))) < 1e-12 and abs(r.near_next - near(spots(t), spots(following))) < 1e-12
    assert got[1001].fingerprint == got[1002].fingerprint


def test_likely_pairs_are_all_pairs_of_fingerprints(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join("the " + rng.choice(words) + " " + rng.choice(words) for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(50):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    sets = {}
    for d, t in rows:
        sets.setdefault(frozenset(spots(t)), d)
    items = [(d, s) for s, d in sets.items()]
    want = {(a, b) for a, x in items for b, y in items if a < b and len(x & y) >= 0.8 * len(x | y)}
    got = {(r.left_id, r.right_id) for r in spotsigs.likely_pairs(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want and want


def test_one_row_and_repeats(spark):
    one = spotsigs.fingerprints(spark.createDataFrame([(1, "the red fox ran")], DOCS)).first()
    assert one.near_next == 1.0
    rows = [(1, "x"), (1, "y"), (1, "y"), (None, "the big dog"), (2**63 - 1, "z"), (-(2**63), "w")]
    assert spotsigs.fingerprints(spark.createDataFrame(rows, DOCS)).count() == 6
    assert spotsigs.fingerprints(spark.createDataFrame([], DOCS)).collect() == []


# --- archives ---------------------------------------------------------------------------
def test_loser_tree_merges():
    rng = random.Random(7)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([], lambda x: x)) == []


PAGES = "page_id long, url string, html string"


def test_archives_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CAPTURES_PER_RANGE", 10)
    big = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(5, "http://b.example/x?q=1", big), (3, "http://www.a.example/", big), (9, None, big), (4, "http://a.example/\r\nX: 1%0A", "small"), (6, "http://a.example/", "small"), (7, "", None), (3, "http://again", big), (8, "http://b.example/y", big + "!")]
    rows += [(100 + i, f"http://h{i % 5}.example/{i}", f"{i}" * 60) for i in range(60)] + [(2**62, "http://far.example/", "x" * 101), (-5, "http://far.example/", "x" * 102)]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(4), path)
    index = warc.capture_index(spark, path).collect()
    want = []
    first = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    for p, u, h in rows:
        again = h in first and first[h] != p
        data = (h or "").encode()
        want.append((p, u, "revisit" if again else "response", first[h] if again else None, len(data), hashlib.sha256(data).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest)) for r in index)
    keys = [(r.url_key, r.captured, r.page_id) for r in index]
    assert keys == sorted(keys)


def test_a_changed_archive_is_refused():
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx"
    good = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    cut = lambda data, n: [data[i : i + n] for i in range(0, len(data), n)]
    for n in (1, 3, 7, 1000):
        for rest in (b"", b"\r\n\r\n"):
            assert [(o, k, b) for o, k, _, b in warc.records(cut(good + good + rest, n))] == [(0, len(good), body), (len(good), len(good), body)]
        for bad in (good[:-1] + b"x", b"x" + good, good[:-5] + b"xx\r\n\r\n", good[:-6] + b"\r\n\r\n", good[:30], good[:50], good + b"\r\n\r\n" * 2):
            with pytest.raises(ValueError):
                list(warc.records(cut(bad, n)))


def test_archives_of_many_long_records(spark, tmp_path, monkeypatch):
    """Pages of up to 3 MB, of nothing but blank lines, and ends that look like a record's: read back in pieces."""
    long = ["\r\n\r\n" * 50_000, "é\n" * 1_000_000, "x\r\n\r", "y" * 200 + "\r\n\r\n", "\r\n" * 101, "\n\r\n\r\n\r" * 30, " " * 3_000_000]
    rows = [(i, f"http://h.example/{i}", t) for i, t in enumerate(long)]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type) for r in warc.capture_index(spark, path).collect()}
    assert got == {i: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest(), "response") for i, t in enumerate(long)}


def test_empty_pages(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame([], PAGES), path)
    assert warc.capture_index(spark, path).collect() == []


def test_numpy_version_keeps_tables():
    assert int(exact_dedup._GEAR[0]) == int(np.random.default_rng(20240601).integers(0, 2**32, 256, dtype=np.uint32)[0])
