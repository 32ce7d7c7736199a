import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import exact_topk as t

SCHEMA = "vec_id long, embedding array<double>"


def plain(queries, candidates, k):
    """All scores in Python's integers."""
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    whole = lambda v: [int(np.floor(x * 256)) for x in v]
    own = [(i, whole(v)) for i, v in candidates if i is not None and fine(v)]
    rows = []
    for i, v in {(i, tuple(v)) for i, v in queries if i is not None and fine(v)}:
        q = whole(v)
        found = sorted((-min(max(sum(a * b for a, b in zip(q, c)), -(2**63)), 2**63 - 1), j) for j, c in own if j != i and len(c) == len(q))[:k]
        rows += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(rows)


def got(spark, queries, candidates, k):
    made = t.exact_topk(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(candidates, SCHEMA).repartition(3), k)
    assert made.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(tuple(r) for r in made.collect())


@pytest.mark.parametrize("scale", [0.01, 1.0, 300.0, 1e7, 1e12], ids=str)
def test_equals_all_scores(spark, scale, monkeypatch):
    monkeypatch.setattr(t, "CANDIDATES", 16)
    monkeypatch.setattr(t, "QUERIES", 4)
    monkeypatch.setattr(t, "ACROSS", 2)
    rng = random.Random(scale)
    rows = [(i, [scale * rng.gauss(0, 1) for _ in range(7)]) for i in range(150)]
    rows += [(200 + i, rows[5][1]) for i in range(40)]  # copies: ties wherever they stand
    queries = [r for r in rows if r[0] % 10 == 0]
    assert got(spark, queries, rows, 5) == plain(queries, rows, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0, 1.0]), (1, None), (2, [nan, 0.0]), (3, [inf, 0.0]), (4, [None, 1.0]), (5, []), (6, [1.0]), (7, [2.0]), (8, [0.0, 0.0]), (8, [0.0, 0.0]), (9, [-1.0, -1.0]), (9, [-1.0, 3.0]), (10, [5e300, 1.0]), (11, [1e308, 1.0]), (12, [])]
    made = got(spark, odd, odd, 3)
    want = plain(odd[:13] + odd[14:], odd[:13] + odd[14:], 3)
    assert [r for r in made if r[0] != 11] == want
    assert (5, 1, 12, 0) in made  # no components: 0 with its like


def test_ties_in_one_block_and_few_candidates(spark):
    rows = [(i, [1.0, 0.5]) for i in range(3000, 0, -1)]
    assert got(spark, [(0, [1.0, 1.0])], rows, 5) == [(0, r, r, 256 * 256 + 128 * 256) for r in range(1, 6)]
    assert got(spark, [(1, [1.0, 1.0])], rows[-2:], 5) == [(1, 1, 2, 98304)]


def test_empty_and_further_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0]), (2, [1.0])], SCHEMA)
    assert t.exact_topk(empty, one).collect() == t.exact_topk(one, empty).collect() == t.exact_topk(empty, empty).collect() == []
    wide = one.select(*[F.lit(9).alias(c) for c in ("q", "g", "s", "base", "need", "bin", "n", "rank", "score", "query_id", "block", "ids", "above")], "*")
    assert sorted(map(tuple, t.exact_topk(wide, wide).collect())) == [(1, 1, 2, 65536), (2, 1, 1, 65536)]
