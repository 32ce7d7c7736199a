import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tracewell.llm import near_dedup as nd
from tracewell.llm.components import components


def sets_of(text):
    words = (text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def brute(docs):
    """doc_id -> (class_id, n_links) over all pairs."""
    ids, sets = [d for d, _ in docs], [sets_of(t) for _, t in docs]
    root, links = {d: d for d in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[ids[i]] += 1
                links[ids[j]] += 1
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    return {d: (find(d), links[d]) for d in ids}


def fixture(seed, n=250):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(n):
        if docs and rng.random() < 0.5:
            t = rng.choice(docs[: 1 + len(docs) // 4]).split()
            for _ in range(rng.randint(0, 3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
            docs.append(" ".join(t))
        else:
            docs.append(" ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 4, 6, 60, 150]))))
    docs += [None, "", " \n", docs[3], docs[3] + "\n"]
    return [(i * 7 + 1, t) for i, t in enumerate(docs)]


def test_against_all_pairs(spark, monkeypatch):
    for block in (512, 7):
        monkeypatch.setattr(nd, "BLOCK", block)
        docs = fixture(block)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.class_id, r.n_links) for r in nd.near_groups(df).collect()}
        assert got == brute(docs)
        kept = {r.doc_id for r in nd.one_of_each(df).collect()}
        assert kept == {c for c, _ in brute(docs).values()}


def test_trees_are_shortened_where_that_is_cheap_until_the_recall_is_reached():
    pairs = {(t, d): (t + 1) * 10.0 ** (nd.DEPTH - d) for t in range(nd.TREES) for d in range(1, nd.DEPTH + 1)}
    depths = nd.chosen_depths(pairs)
    assert nd.chance(depths) >= nd.RECALL
    short = [t for t in range(nd.TREES) if depths[t] < nd.DEPTH]
    assert short == list(range(len(short))) and 0 < len(short) < nd.TREES  # the first trees bring the fewest pairs
    assert nd.chance([*depths[: short[-1]], depths[short[-1]] + 1, *depths[short[-1] + 1 :]]) < nd.RECALL
    assert nd.chosen_depths(pairs, recall=0.99) == [nd.DEPTH] * nd.TREES
    assert nd.chance(nd.chosen_depths(pairs, least=0.5, recall=0.9), 0.5) >= 0.9


def test_runs_are_the_nodes_of_the_tries():
    rng = random.Random(8)
    for _ in range(30):
        rows = sorted((rng.randrange(3), bytes(rng.choice((0, 1)) for _ in range(nd.DEPTH * nd.STEP)), rng.randrange(-9, 9)) for _ in range(rng.randrange(1, 80)))
        want = Counter((t, d, x[: d * nd.STEP]) for t, x, _ in rows for d in (3, 4, 5, 6))
        xor = defaultdict(int)
        for t, x, h in rows:
            for d in (3, 4, 5, 6):
                xor[t, d, x[: d * nd.STEP]] ^= h
        got, got_xor = Counter(), defaultdict(int)
        cuts = [0, *sorted(rng.randrange(len(rows) + 1) for _ in range(3)), len(rows)]  # ranges
        for low, high in zip(cuts, cuts[1:]):
            part = rows[low:high]
            inner = sorted({0, len(part), *(rng.randrange(len(part) + 1) for _ in range(2))})  # batches of a range
            batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in x], pa.int32()), pa.array([r[1] for r in x], pa.binary()), pa.array([r[2] for r in x], pa.int64())], ["tree", "label", "h"]) for x in (part[i:j] for i, j in zip(inner, inner[1:]))]
            for b in nd._runs(3)(iter(batches)):
                for r in b.to_pylist():
                    got[r["tree"], r["depth"], r["prefix"]] += r["m"]
                    got_xor[r["tree"], r["depth"], r["prefix"]] ^= r["x"]
        several = {k: n for k, n in want.items() if n > 1}
        assert {k: n for k, n in got.items() if n > 1} == several
        assert all(got_xor[k] == xor[k] for k in several)


def test_a_template_does_not_join_unlike_texts(spark):
    rng = random.Random(9)
    template = [f"t{i}" for i in range(100)]
    docs = [(i, " ".join(template + [f"w{i}x{rng.randrange(10**6)}" for _ in range(100)])) for i in range(300)]
    docs += [(1000 + i, docs[0][1] + f" end{i}") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = {d: nd.signature(nd.shingles(t)) for d, t in docs}
    reps = spark.createDataFrame([(d, x) for d, x in labels.items()], "rep long, labels binary")
    joined = {frozenset((r.u, r.v)) for r in nd.candidate_edges(reps).collect()}
    assert joined and all(x <= {0, *range(1000, 1005)} for x in joined)
    assert {r.doc_id: (r.class_id, r.n_links) for r in nd.near_groups(df).collect()} == brute(docs)


def test_links_by_matrix_are_those_by_sets():
    rng = random.Random(2)
    sets = [np.unique(np.array([rng.randrange(30) for _ in range(rng.randint(1, 25))], np.uint64)) for _ in range(40)]
    plain = [set(s.tolist()) for s in sets]
    want = np.array([[i != j and len(a & b) >= 0.5 * len(a | b) for j, b in enumerate(plain)] for i, a in enumerate(plain)])
    assert (nd.linked(sets, None, 0.5) == want).all()
    assert (nd.linked(sets[:15], sets[15:], 0.5) == want[:15, 15:]).all()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(70, 70), (81, 80)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 1 for i in range(2, 60)}, 81: 80}


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "a b c")]
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 2, 0), (3, 3, 0)]
    assert nd.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
