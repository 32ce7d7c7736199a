"""Chains: of rows that may overlap, those that a walk from the start of each key takes, one after another.

The walk takes the first row, then the first that starts at or after the end of the one taken, and so on: how frames
follow one another in bytes where a frame's mark may also stand inside another frame. Every row has one row that follows
it, so the walk is a path through pointers. Where no key has more rows than a range, whole keys are dealt to tasks and walked
as their sorted rows stream by. Else the walk is found without reading a key's rows in one task:

1. Rows are dealt to ranges of (key, start), written once.
2. In each range every row's path is followed to where it leaves the range. The paths run together, so the places where
   they leave are few.
3. Those places are the nodes of a graph much smaller than the rows: each points to the place where the path that enters
   with it leaves the next range. The nodes on the walk are found by pointer doubling, in as many rounds as the number of
   ranges of a key has binary digits.
4. Each range follows the path from the place where the walk enters it, and keeps the rows on it."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from . import sweeps

RANGE = 200_000
LOWEST = -(2**63)


def _runs(table: pa.Table, keys: list[str]):
    """(key, rows' numbers, starts, ends) of each key of a range, in order of start."""
    table = table.append_column("__row", pa.array(range(table.num_rows), pa.int64())).select([*keys, "__start", "__end", "__row"])
    rows: dict[tuple, list] = {}
    for *key, start, end, row in zip(*(c.to_pylist() for c in table.columns)):
        rows.setdefault(tuple(key), []).append((start, end, row))
    for key, found in rows.items():
        found.sort()
        starts, ends, at = zip(*found)
        yield key, at, starts, ends


def _following(starts: tuple, ends: tuple) -> list[int]:
    """For each row the first one that starts at or after its end; as many as there are rows if none does."""
    return [bisect_left(starts, end, k + 1) for k, end in enumerate(ends)]


def _streamed(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The rows on the walk of each key, whole keys to a task (count: all rows, 0 if not known)."""
    columns = [c for c in rows.columns if c not in ("__start", "__end")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = reach = None
        for b in batches:
            kept = []
            for row, (start, end, *key) in enumerate(zip(*(b.column(c).to_pylist() for c in ("__start", "__end", *keys)))):
                if key != now or start >= reach:
                    now, reach = key, end
                    kept.append(row)
            yield b.select(columns).take(pa.array(kept, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in columns)
    by = [F.col(c).asc_nulls_first() for c in [*keys, "__start", "__end"]]
    return sweeps.shared_out(rows, keys, count).sortWithinPartitions(*by).mapInArrow(walk, schema)


def on_chain(rows: DataFrame, keys: list[str], start: str = "offset", length: str = "length", size: tuple[int, int] | None = None) -> DataFrame:
    """The rows on the walk of each key. Lengths must be above 0; rows of one start are taken in order of length.
    size: at most so many rows of one key, and of all, where they are known and each key fits a task (sweeps.HOT)."""
    checked = F.when(F.col(length) > 0, F.col(start) + F.col(length)).otherwise(F.raise_error("a row of a chain has no length").cast("long"))
    rows = rows.withColumns({"__start": F.col(start).cast("long"), "__end": checked})
    if size and size[0] <= sweeps.HOT:
        return _streamed(rows, keys, size[1])
    rows = staged(rows, "candidates")
    most, count = (n or 0 for n in rows.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first())
    if most <= RANGE:
        return _streamed(rows, keys, count)
    parts = max(1, -(-count // RANGE))
    by = [F.col(c).asc_nulls_first() for c in [*keys, "__start"]]
    rows = staged(rows.repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id()), "ranges")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    key_schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    slim = rows.select("__part", *keys, "__start", "__end")

    def leaves(table: pa.Table) -> pa.Table:
        """A row for each place where paths leave this range, and for each key the place of its first row's path: from null."""
        out = []
        for key, _, starts, ends in _runs(table, keys):
            leave = list(ends)
            for k, to in reversed([*enumerate(_following(starts, ends))]):
                if to < len(starts):
                    leave[k] = leave[to]
            out += [(*key, place) for place in set(leave)]
        return _table(out, keys, ["__at"], table.schema)

    def enters(key: tuple, table: pa.Table, places: pa.Table) -> pa.Table:
        """(key, place, where the path that enters with it leaves)."""
        out, asked = [], {}
        for *k, at in zip(*(places.column(c).to_pylist() for c in [*keys, "__at"])):
            asked.setdefault(tuple(k), []).append(at)
        for k, _, starts, ends in _runs(table, keys):
            if k in asked:
                leave = list(ends)
                for i, to in reversed([*enumerate(_following(starts, ends))]):
                    if to < len(starts):
                        leave[i] = leave[to]
                out += [(*k, at, leave[bisect_left(starts, at)]) for at in asked[k]]
        return _table(out, keys, ["__at", "__next"], table.schema)

    def taken(key: tuple, table: pa.Table, places: pa.Table) -> pa.Table:
        """The rows on the paths that enter with the places given, one for each key."""
        asked = {tuple(k): at for *k, at in zip(*(places.column(c).to_pylist() for c in [*keys, "__at"]))}
        kept = []
        for k, numbers, starts, ends in _runs(table, keys):
            if k in asked:
                follow, i = _following(starts, ends), bisect_left(starts, asked[k])
                while i < len(starts):
                    kept.append(numbers[i])
                    i = follow[i]
        return table.take(pa.array(sorted(kept), pa.int64()))

    # (staged also because a cogroup of two frames of one lineage confuses their columns)
    # where each range's rows of a key end: a place is met by the first later range with a row that starts there or after
    reach = slim.groupBy(*keys, "__part").agg(F.max("__start").alias("__last"), F.min("__start").alias("__first"))
    crossing = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    reach = staged(reach.withColumn("__cross", crossing), "reach")
    first = reach.groupBy(*keys).agg(F.min_by("__part", "__first").alias("__part"), F.lit(LOWEST).alias("__at"))
    if parts > 1:
        # only keys of several ranges have paths from one to another
        spread = reach.where("__cross")
        wide = slim.join(spread.select(*keys, "__part"), _same(slim, spread, [*keys, "__part"]), "left_semi")
        places = wide.groupBy("__part").applyInArrow(leaves, f"{key_schema}, __at long").distinct()
        marks = spread.select(*keys, F.col("__last").alias("__at"), F.col("__part").alias("__to"))
        both = places.withColumn("__to", F.lit(None).cast("int")).unionByName(marks)
        ahead = Window.partitionBy(*keys).orderBy("__at", F.col("__to").asc_nulls_first()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
        nodes = both.withColumn("__part", F.first("__to", True).over(ahead)).where("__to is null and __part is not null").select(*keys, "__part", "__at")
        start_nodes = first.join(spread.select(*keys, "__part"), _same(first, spread, [*keys, "__part"]), "left_semi").select(*keys, "__part", "__at")
        nodes = staged(nodes.unionByName(start_nodes), "nodes")
        jumps = wide.groupBy("__part").cogroup(nodes.groupBy("__part")).applyInArrow(enters, f"{key_schema}, __at long, __next long")
        known = nodes.select(*keys, F.col("__at").alias("__next"))
        jumps = staged(jumps.join(known, _same(jumps, known, [*keys, "__next"]), "left_semi"), "jumps")
        reached = start_nodes.select(*keys, "__at")
        count = 0
        while True:  # after k rounds all nodes within 2^k steps of the start are reached, and jumps go 2^k steps
            step = reached.withColumnsRenamed({k: f"__r_{k}" for k in [*keys, "__at"]})
            on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in [*keys, "__at"]]
            more = step.join(jumps, on).select(*keys, F.col("__next").alias("__at"))
            reached = staged(reached.unionByName(more).distinct(), "reached")
            now = reached.count()
            if now == count:
                break
            count = now
            ahead_ = jumps.withColumnsRenamed({k: f"__r_{k}" for k in [*keys, "__at", "__next"]})
            on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys] + [F.col("__next") == F.col("__r___at")]
            jumps = staged(jumps.join(ahead_, on).select(*keys, "__at", F.col("__r___next").alias("__next")), "jumps")
        hit = reached.withColumnsRenamed({k: f"__r_{k}" for k in [*keys, "__at"]})
        entered = nodes.join(hit, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in [*keys, "__at"]], "left_semi")
        single = first.join(spread.select(*keys).distinct(), _same(first, spread, keys), "left_anti").select(*keys, "__part", "__at")
        first = entered.unionByName(single)
    columns = [c for c in rows.columns if c not in ("__start", "__end", "__part")]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns)
    entered = first.select("__part", *keys, "__at")
    return rows.groupBy("__part").cogroup(entered.groupBy("__part")).applyInArrow(taken, schema).select(*columns)


def _same(left: DataFrame, right: DataFrame, columns: list[str]):
    on = None
    for c in columns:
        one = left[c].eqNullSafe(right[c])
        on = one if on is None else on & one
    return on


def _table(rows: list[tuple], keys: list[str], more: list[str], schema: pa.Schema) -> pa.Table:
    types = [schema.field(k).type for k in keys] + [pa.int64()] * len(more)
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], [*keys, *more])
