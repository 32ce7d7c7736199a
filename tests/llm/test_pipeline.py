from collections import Counter, defaultdict

import corpus_pipeline as cp
from tests.llm.test_near_dedup import brute as near_brute
from tracewell.llm import quality

SF = "/root/testdata/sf0.001"


def lines_brute(docs):
    """doc_id -> text without the lines whose key stands in ten documents."""
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    key = lambda x: x.strip(" \t\n\v\f\r").translate(lower)
    seen = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            seen[key(line)].add(d)
    common = {k for k, v in seen.items() if k and len(v) >= 10}
    return {d: "\n".join(x for x in (t or "").split("\n") if key(x) not in common) for d, t in docs}


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, (_, first), (_, second), (_, third), (_, fourth), (_, fifth) = docs.columns, *cp.STAGES

    good = first(spark, docs, SF)
    assert good.columns == columns
    table = quality.scored(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in table.where("predicted = 1").collect()}

    lines = second(spark, good, SF)
    assert lines.columns == columns
    want = lines_brute([(r.doc_id, r.text) for r in good.collect()])
    assert {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    one = third(spark, lines, SF)
    assert one.columns == columns
    pairs = [(r.doc_id, r.text) for r in lines.collect()]
    assert {r.doc_id for r in one.collect()} == {c for c, _ in near_brute(pairs).values()}

    mixed = fourth(spark, one, SF)
    assert mixed.columns == columns
    sizes, taken, texts = Counter(), Counter(), {r.doc_id: r.text for r in one.collect()}
    for r in one.collect():
        sizes[r.source] += len(r.text.split())
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
        assert texts[r.doc_id].split()[: len(r.text.split())] == r.text.split()
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= len(sizes)
    assert all(taken[s] <= 2 * sizes[s] for s in sizes)

    packed = fifth(spark, mixed, SF).collect()
    per_sequence = Counter()
    for r in packed:
        per_sequence[r.sequence_id] += r.length
    assert max(per_sequence.values()) <= 1024
    assert sum(r.doc_tokens for r in packed if r.start == 0) == sum(per_sequence.values())


def test_run_gives_the_last_stage(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 0


def test_stages_take_odd_tables(spark):
    rows = [(1, None, "en", None, 0, "x"), (2, "", None, "a", 0, "y"), (None, "some words here in a row", "en", "a", 24, "z"), (3, "dup words one two three four five", "en", "a", 34, "n"), (3, "dup words one two three four five", "en", "a", 34, "n"), (4, "long " * 60_000, "en", "b", 300_000, "n")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in cp.STAGES:
            made = stage(spark, docs, SF)
            n = made.count()
            if name != "packing":
                assert made.columns == docs.columns
            elif docs.count():
                assert n >= len(rows)
            else:
                assert n == 0
