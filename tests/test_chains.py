import random

import pytest

from tracewell.operators import chains


def walked(rows):
    """(key, start, length) on the walk of each key."""
    kept, reach = [], {}
    for key, start, length in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if key not in reach or start >= reach[key]:
            kept.append((key, start, length))
            reach[key] = start + length
    return sorted(kept, key=str)


@pytest.mark.parametrize("size", [10_000, 40, 7])
def test_equals_a_walk(spark, monkeypatch, size):
    """Ranges of 7 rows: paths of a hundred ranges, found in seven rounds."""
    monkeypatch.setattr(chains, "RANGE", size)
    rng = random.Random(size)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.randrange(3000), rng.choice([1, 3, 40, 300]) + rng.randrange(20)) for _ in range(700)]
    rows += [(9, 5, 10_000), (9, 6, 3), (8, 0, 1)]
    df = spark.createDataFrame([(*r, f"row {i}") for i, r in enumerate(rows)], "k int, offset long, length long, note string").repartition(4)
    made = chains.on_chain(df, ["k"]).collect()
    assert sorted(((r.k, r.offset, r.length) for r in made), key=str) == walked(rows)
    assert all(rows[int(r.note[4:])] == (r.k, r.offset, r.length) for r in made)


def test_paths_that_differ_for_long(spark, monkeypatch):
    """Two chains that never meet: the walk takes the first one's rows only, through every range."""
    monkeypatch.setattr(chains, "RANGE", 10)
    rows = [(1, 10 * i, 10) for i in range(60)] + [(1, 10 * i + 5, 10) for i in range(60)]
    made = chains.on_chain(spark.createDataFrame(rows, "k int, offset long, length long").repartition(3), ["k"]).collect()
    assert sorted(r.offset for r in made) == [10 * i for i in range(60)]


def test_odd_tables(spark):
    schema = "k int, offset long, length long"
    assert chains.on_chain(spark.createDataFrame([], schema), ["k"]).collect() == []
    with pytest.raises(Exception, match="no length"):
        chains.on_chain(spark.createDataFrame([(1, 0, 0)], schema), ["k"]).collect()
