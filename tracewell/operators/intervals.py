"""Interval operators over byte ranges and time: islands, complements, subtraction, coverage and tier merging.

Intervals are half open, `start` included and `end` not, as integers (bytes or microseconds). Every window is partitioned
by the caller's keys (evidence, channel), and one key's boundaries are swept by many tasks where a key is hot (see sweeps);
no operator joins a table with itself on a range.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sweeps
from .sweeps import dealt, ranges, swept

#: What a byte can be, the first one winning where claims overlap.
BUCKETS = ("unreadable", "structural", "parsed", "carved", "unaccounted")
TIERS = ("T1", "T2", "T3", "T4")
SECTOR = 512


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", max_gap: int = 0, size: tuple[int, int] | None = None) -> DataFrame:
    """keys, start, end, members: intervals that overlap, touch or lie within max_gap of each other, joined. size: as dealt has it."""
    rows = swept(dealt(df.select(*keys, start, end), keys, [start, end], size), keys, [start, end], __reach=("max_before", end))
    new = F.when(F.col("__reach").isNull() | (F.col(start) - F.col("__reach") > max_gap), 1).otherwise(0)
    marked = swept(rows.withColumn("__new", new), keys, [start, end], __island=("sum", "__new"))
    joined = marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("members"))
    return joined.drop("__island")


def complement(df: DataFrame, keys: list[str], bounds: DataFrame, low: str = "low", high: str = "high", start: str = "start", end: str = "end") -> DataFrame:
    """keys, start, end of what the intervals leave uncovered within each key's [low, high); empty pieces left out."""
    inside = df.join(bounds, keys).where((F.col(end) > F.col(low)) & (F.col(start) < F.col(high)))
    clipped = inside.select(*keys, F.greatest(start, low).alias(start), F.least(end, high).alias(end))
    edges = bounds.select(*keys, F.col(low).alias(start), F.col(low).alias(end)).unionByName(bounds.select(*keys, F.col(high).alias(start), F.col(high).alias(end)))
    every = islands(clipped.unionByName(edges), keys, start, end)
    gaps = swept(dealt(every, keys, [start]), keys, [start], __from=("lag", end)).select(*keys, "__from", F.col(start).alias("__to")).where("__from < __to")
    return gaps.select(*keys, F.col("__from").alias(start), F.col("__to").alias(end))


def subtract(spans: DataFrame, holes: DataFrame, keys: list[str], near: int = SECTOR) -> DataFrame:
    """keys, start, end, bounded_by: what holes leave of disjoint spans, and the holes within `near` of a piece's ends.

    One sweep over both sets of boundaries; a piece meets its bounding holes by cells of `near` bytes, not by range."""
    change = lambda df, what, at, by: df.select(*keys, F.col(at).alias("at"), F.lit(by if what == "span" else 0).alias("s"), F.lit(by if what == "hole" else 0).alias("h"))
    events = None
    for df, what in ((spans, "span"), (holes, "hole")):
        for at, by in (("start", 1), ("end", -1)):
            one = change(df, what, at, by)
            events = one if events is None else events.unionByName(one)
    # two spans that touch stay two pieces: the place where one ends and the next starts is a boundary of its own
    cut = spans.select(*keys, F.col("start").alias("at")).distinct().withColumn("opens", F.lit(True))
    events = events.unionByName(cut, allowMissingColumns=True)
    most, rows = sweeps.counted(events, keys)
    hot = most > sweeps.HOT
    points = (events if hot else sweeps.shared_out(events, keys, rows)).groupBy(*keys, "at").agg(F.sum("s").alias("s"), F.sum("h").alias("h"), F.max("opens").alias("opens"))
    points = ranges(points, keys, ["at"]) if hot else points
    runs = swept(points.withColumnsRenamed({"s": "__s", "h": "__h"}), keys, ["at"], next=("lead", "at"), s=("sum", "__s"), h=("sum", "__h"))
    runs = swept(runs.withColumn("in", (F.col("s") > 0) & (F.col("h") == 0)), keys, ["at"], __was=("lag", "in"))
    first = F.when(F.col("opens").isNotNull() | ~F.coalesce("__was", F.lit(False)), 1).otherwise(0)
    runs = swept(runs.withColumn("__first", first), keys, ["at"], __piece=("sum", "__first")).where("in and next is not null")
    pieces = runs.groupBy(*keys, "__piece").agg(F.min("at").alias("start"), F.max("next").alias("end")).drop("__piece")
    # a hole lies in the cells of its start and its end, a piece looks in the cells that `near` reaches from its own
    cell = lambda c: F.floor(c / near).cast("long")
    place = lambda side, c: F.struct(F.lit(side).alias("side"), cell(c).alias("cell"))
    start, end = F.col("start"), F.col("end")
    of_hole = F.explode(F.array(place("ahead", start), place("behind", end)))
    seen = holes.select(*keys, F.struct("start", "end").alias("hole"), of_hole.alias("p")).select(*keys, "hole", "p.side", "p.cell")
    of_piece = F.explode(F.array(place("ahead", end), place("ahead", end + near), place("behind", start), place("behind", start - near)))
    looks = pieces.select(*keys, "start", "end", of_piece.alias("p")).select(*keys, "start", "end", "p.side", "p.cell")
    gap = F.when(F.col("side") == "ahead", F.col("hole.start") - end).otherwise(start - F.col("hole.end"))
    met = looks.join(seen, [*keys, "side", "cell"], "left").groupBy(*keys, "start", "end")
    return met.agg(F.array_sort(F.collect_set(F.when(gap.between(0, near), F.col("hole")))).alias("bounded_by"))


def coverage_map(images: DataFrame, claims: DataFrame) -> DataFrame:
    """evidence_id, offset, length, bucket: a tiling of each image [0, size) by the strongest claim on each byte.

    images: evidence_id, size. claims: evidence_id, offset, length, bucket. Claims are clipped; an image of size 0 has
    no runs. One boundary sweep: a shuffle by evidence, or by ranges of offsets where one image has most of the claims."""
    high = F.least("size", F.col("offset") + F.col("length"))
    clipped = claims.join(images, "evidence_id").select("evidence_id", "bucket", F.greatest(F.lit(0), "offset").alias("low"), high.alias("high")).where("high > low")
    edge = lambda at, by: clipped.select("evidence_id", F.col(at).alias("at"), "bucket", F.lit(by).alias("by"))
    frame = images.where("size > 0").select("evidence_id", F.explode(F.array(F.lit(0).cast("long"), F.col("size").cast("long"))).alias("at"))
    events = edge("low", 1).unionByName(edge("high", -1)).unionByName(frame.select("evidence_id", "at", F.lit("").alias("bucket"), F.lit(0).alias("by")))
    depth = [F.sum(F.when(F.col("bucket") == b, F.col("by")).otherwise(0)).alias(b) for b in BUCKETS[:-1]]
    keys = ["evidence_id"]
    most, rows = sweeps.counted(events, keys)
    hot = most > sweeps.HOT
    points = (events if hot else sweeps.shared_out(events, keys, rows)).groupBy("evidence_id", "at").agg(*depth)  # dealt once, for all that follows
    points = ranges(points, keys, ["at"]) if hot else points
    runs = swept(points.withColumnsRenamed({b: f"__{b}" for b in BUCKETS[:-1]}), keys, ["at"], next=("lead", "at"), **{b: ("sum", f"__{b}") for b in BUCKETS[:-1]})
    won = F.coalesce(*[F.when(F.col(b) > 0, F.lit(b)) for b in BUCKETS[:-1]], F.lit(BUCKETS[-1]))
    runs = runs.where("next is not null").withColumn("bucket", won)
    runs = swept(runs, keys, ["at"], __was=("lag", "bucket"))
    changed = F.when(F.col("__was").eqNullSafe(F.col("bucket")), 0).otherwise(1)
    runs = swept(runs.withColumn("__new", changed), keys, ["at"], run=("sum", "__new"))
    tiled = runs.groupBy("evidence_id", "run", "bucket").agg(F.min("at").alias("offset"), (F.max("next") - F.min("at")).alias("length"))
    return tiled.select("evidence_id", "offset", "length", "bucket")


def coverage_totals(images: DataFrame, coverage: DataFrame) -> DataFrame:
    """evidence_id, bucket, bytes for all five buckets of each image, zeros present."""
    every = images.select("evidence_id", F.explode(F.array(*map(F.lit, BUCKETS))).alias("bucket"))
    sums = coverage.groupBy("evidence_id", "bucket").agg(F.sum("length").alias("bytes"))
    return every.join(sums, ["evidence_id", "bucket"], "left").select("evidence_id", "bucket", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def explained(images: DataFrame, coverage: DataFrame) -> DataFrame:
    """evidence_id, size, unaccounted_bytes, explained_fraction (null for an empty image)."""
    lost = coverage.groupBy("evidence_id").agg(F.sum(F.when(F.col("bucket") == "unaccounted", F.col("length")).otherwise(0)).alias("u"))
    both = images.join(lost, "evidence_id", "left").withColumn("u", F.coalesce("u", F.lit(0)).cast("long"))
    return both.select("evidence_id", "size", F.col("u").alias("unaccounted_bytes"), F.when(F.col("size") > 0, 1 - F.col("u") / F.col("size")).alias("explained_fraction"))


def coverage_problems(images: DataFrame, coverage: DataFrame) -> DataFrame:
    """evidence_id, problem of each map that does not tile its image: gap, overlap, empty run, wrong end, split run."""
    order = Window.partitionBy("evidence_id").orderBy("offset", "length")
    end = F.col("offset") + F.col("length")
    runs = coverage.select("evidence_id", "offset", "length", "bucket", F.lag(end).over(order).alias("before"), F.lag("bucket").over(order).alias("last"))
    expected = F.coalesce("before", F.lit(0))
    found = F.array_compact(
        F.array(
            F.when(F.col("length") <= 0, "empty run"), F.when(F.col("offset") > expected, "gap"), F.when(F.col("offset") < expected, "overlap"),
            F.when(F.col("last") == F.col("bucket"), "split run"), F.when(~F.col("bucket").isin(*BUCKETS), "unknown bucket"),
        )
    )
    problems = runs.select("evidence_id", F.explode(found).alias("problem"))
    ends = images.join(coverage.groupBy("evidence_id").agg(F.max(end).alias("reach")), "evidence_id", "left")
    ends = ends.where(F.coalesce("reach", F.lit(0)) != F.col("size")).select("evidence_id", F.lit("wrong end").alias("problem"))
    return problems.unionByName(ends).distinct()


def bucket_at(coverage: DataFrame, offset: int) -> DataFrame:
    return coverage.where((F.col("offset") <= offset) & (F.col("offset") + F.col("length") > offset)).select("evidence_id", "bucket")


def claims_of(layouts: DataFrame, recordings: DataFrame, gaps: DataFrame) -> DataFrame:
    """The claims a coverage map is made of: index extents, kept recordings by tier, unreadable ranges.

    layouts: evidence_id, index_extents; recordings: evidence_id, tier, extents; gaps: evidence_id, offset, length."""
    flat = lambda df, c, bucket: df.select("evidence_id", F.explode(c).alias("e"), bucket.alias("bucket")).select("evidence_id", "e.offset", "e.length", "bucket")
    structural = flat(layouts, "index_extents", F.lit("structural"))
    by_tier = F.when(F.col("tier").isin("T1", "T2"), "parsed").otherwise("carved")
    return structural.unionByName(flat(recordings, "extents", by_tier)).unionByName(gaps.select("evidence_id", "offset", "length", F.lit("unreadable").alias("bucket")))


def overlap(a: Column, b: Column) -> Column:
    """Whether any extent of one list overlaps any of the other (structs of offset and length)."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x.offset < y.offset + y.length) & (y.offset < x.offset + x.length)))


class Painted:
    """Disjoint intervals that each carry a number, in order, in lists of bounded length.

    `lowest` reads the least number of the intervals that a span overlaps; `paint` gives the span one number. Painting a
    span takes away what lies in it, so a span that is read and then painted costs little more than a search."""

    FULL = 1024

    def __init__(self) -> None:
        self.blocks: list[list[tuple[int, int, int]]] = [[]]
        self.firsts: list[int] = []  # the start of each block but the first

    def _place(self, start: int) -> tuple[int, int]:
        """Where the first interval that ends after `start` can be."""
        k = bisect_right(self.firsts, start)
        at = bisect_right(self.blocks[k], (start, float("inf"))) - 1
        if at < 0 and k:
            k -= 1
            at = len(self.blocks[k]) - 1
        return k, max(at, 0)

    def lowest(self, start: int, end: int) -> int | None:
        k, at = self._place(start)
        least = None
        while k < len(self.blocks):
            block = self.blocks[k]
            while at < len(block):
                low, high, number = block[at]
                if low >= end:
                    return least
                if high > start and (least is None or number < least):
                    least = number
                at += 1
            k, at = k + 1, 0
        return least

    def paint(self, start: int, end: int, number: int) -> None:
        k, at = self._place(start)
        first, made = (k, at), [(start, end, number)]
        if at < len(self.blocks[k]) and self.blocks[k][at][1] <= start:
            first = (k, at + 1)
        k, at = first
        while k < len(self.blocks):
            block = self.blocks[k]
            upto = bisect_left(block, (end,), at)
            for low, high, was in block[at:upto]:
                if low < start:
                    made.insert(0, (low, start, was))
                if high > end:
                    made.append((end, high, was))
            whole = upto == len(block)
            del block[at:upto]
            if not whole:
                break
            k, at = k + 1, 0
        k, at = first
        self.blocks[k][at:at] = made
        emptied = k + 1 < len(self.blocks) and not self.blocks[k + 1]
        full = len(self.blocks[k]) > self.FULL
        if full:
            half = len(self.blocks[k]) // 2
            self.blocks.insert(k + 1, self.blocks[k][half:])
            del self.blocks[k][half:]
        if full or emptied:
            self.blocks = [self.blocks[0], *(block for block in self.blocks[1:] if block)]
            self.firsts = [block[0][0] for block in self.blocks[1:]]
        else:
            for j in (k, k + 1):
                if 0 < j < len(self.blocks):
                    self.firsts[j - 1] = self.blocks[j][0][0]


def _clusters(rows: list[tuple]) -> list:
    """For records (recording_id, extents) in tier order: the head of the first cluster with a member each overlaps.

    Each byte keeps the number of the first cluster that has it. A record's bytes all go to the first cluster they meet, so
    they are painted with its number. Extents of no bytes are kept apart: they overlap what they lie inside."""
    painted, points = Painted(), Painted()
    heads_of: list = []
    heads = []
    for recording_id, extents in rows:
        spans = [(e["offset"], e["offset"] + e["length"]) for e in extents]
        met = []
        for a, b in spans:
            if a < b:
                met += [painted.lowest(2 * a + 1, 2 * b), points.lowest(2 * a + 1, 2 * b)]
            else:
                met.append(painted.lowest(2 * a, 2 * a + 1))
        number = min((m for m in met if m is not None), default=len(heads_of))
        if number == len(heads_of):
            heads_of.append(recording_id)
        for a, b in spans:
            if a < b:
                painted.paint(2 * a + 1, 2 * b, number)
            elif (was := points.lowest(2 * a, 2 * a + 1)) is None or number < was:
                points.paint(2 * a, 2 * a + 1, number)
        heads.append(heads_of[number])
    return heads


def _few(spans: list[list[tuple[int, int]]]) -> list[int]:
    """_clusters of a few records, each against all before it: the place of the head of each. A span of no bytes overlaps
    what it lies inside."""
    heads_of: list[int] = []
    seen: list[tuple[int, int, int]] = []
    heads = []
    for k, mine in enumerate(spans):
        mine = [(a, max(a, b)) for a, b in mine]
        number = min((n for x, y, n in seen for a, b in mine if a < y and x < b), default=len(heads_of))
        if number == len(heads_of):
            heads_of.append(k)
        seen += [(a, b, number) for a, b in mine]
        heads.append(heads_of[number])
    return heads


#: Records of an island up to which each is held against all before it.
FEW = 32


def _heads(table: pa.Table) -> pa.RecordBatch:
    """kept_id of each record of whole islands. Most islands are one record, which is its own head."""
    table = table.combine_chunks()
    n = table.num_rows
    starts = np.flatnonzero(_changes(table))
    sizes = np.diff(np.append(starts, n))
    heads, many = np.arange(n), np.flatnonzero(sizes > 1)
    chosen = table.column("extents").take(pa.array(np.flatnonzero(np.repeat(sizes > 1, sizes)))).combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(chosen), 0).to_pylist()
    flat = pc.list_flatten(chosen)
    low = flat.field("offset").to_pylist()
    spans = iter(list(zip(low, (o + size for o, size in zip(low, flat.field("length").to_pylist())))))
    for start, size, first in zip(starts[many].tolist(), sizes[many].tolist(), np.cumsum(sizes[many]).tolist()):
        mine = [list(islice(spans, count)) for count in lengths[first - size : first]]
        found = _few(mine) if size <= FEW else _clusters([(k, [{"offset": a, "length": b - a} for a, b in m]) for k, m in enumerate(mine)])
        heads[start : start + size] = start + np.array(found)
    made = table.select(["evidence_id", "recording_id", "tier"])
    return made.append_column("kept_id", table.column("recording_id").take(pa.array(heads))).combine_chunks().to_batches()[0]


def _changes(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Whether each row is of another island than the row before it; true for the first."""
    new = np.ones(table.num_rows, bool)
    for c in ("evidence_id", "island"):
        column = table.column(c)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] = (code[1:] != code[:-1]) | new[1:] if c == "island" else code[1:] != code[:-1]
    return new


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kept_id of each record; rows come sorted by evidence, island and tier order. What is held is the last island."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        edge = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        new = _changes(pa.Table.from_batches([*edge, b]).combine_chunks())[len(edge) :]
        if not held:
            new[0] = False  # begins the first island, and ends none
        ends = np.flatnonzero(new)
        if len(ends):
            cut = int(ends[-1])
            whole = [*held, b.slice(0, cut)]
            yield _heads(pa.Table.from_batches(whole))
            held = []
            b = b.slice(cut)
        held.append(b)
    if held:
        yield _heads(pa.Table.from_batches(held))


def merge_tiers(recordings: DataFrame) -> DataFrame:
    """evidence_id, recording_id, tier, kept_id: the survivor that each recording was merged into (itself if kept).

    recordings: evidence_id, recording_id, tier, extents (array of offset, length), note. Clusters are filled greedily in
    the order tier, start, longer span, note, recording_id, so two clusters bridged later stay two. Recordings of
    different islands of their spans cannot overlap, so each island is filled on its own."""
    low = F.array_min(F.transform("extents", lambda e: e.offset))
    high = F.array_max(F.transform("extents", lambda e: e.offset + e.length))
    known = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    rank = F.when(known > 0, known).otherwise(len(TIERS) + 1)  # unknown tiers and none come last
    rows = recordings.withColumns({"low": low, "high": high, "tier_rank": rank})
    rows = rows.withColumn("neg_span", F.col("low") - F.col("high"))
    keys, along = ["evidence_id"], ["low", "high", "recording_id"]
    rows = swept(dealt(rows, keys, along), keys, along, __reach=("max_before", "high"))
    rows = rows.withColumn("__new", F.when(F.col("__reach").isNull() | (F.col("low") >= F.col("__reach")), 1).otherwise(0))
    rows = swept(rows, keys, along, island=("sum", "__new"))
    kinds = {f.name: f.dataType.simpleString() for f in recordings.schema}
    schema = f"evidence_id {kinds['evidence_id']}, recording_id {kinds['recording_id']}, tier string, kept_id {kinds['recording_id']}"
    order = ["evidence_id", "island", "tier_rank", "low", "neg_span", "note", "recording_id"]
    rows = rows.select(*order, "tier", "extents").repartition("evidence_id", "island").sortWithinPartitions(*order)
    return rows.mapInArrow(_greedy, schema)


def merge_notes(merged: DataFrame) -> DataFrame:
    """evidence_id, recording_id, absorbed, tiers, note of each survivor that others were merged into: how many, at which tiers
    (best first, unknown ones last), and a sentence that says so."""
    known = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    rank = F.when(known > 0, known).otherwise(len(TIERS) + 1)
    others = merged.where("recording_id != kept_id").groupBy("evidence_id", "kept_id")
    made = others.agg(F.count(F.lit(1)).alias("absorbed"), F.transform(F.array_sort(F.collect_set(F.struct(rank.alias("rank"), "tier"))), lambda x: x.tier).alias("tiers"))
    said = F.concat(F.col("absorbed").cast("string"), F.lit(" overlapping result(s) at "), F.array_join("tiers", ", "), F.lit(" were merged into this one, which has the highest tier"))
    return made.select("evidence_id", F.col("kept_id").alias("recording_id"), "absorbed", "tiers", said.alias("note"))


def merge_stats(merged: DataFrame) -> DataFrame:
    """evidence_id, kept, dropped, groups: survivors, records merged away, survivors that absorbed any."""
    sizes = merged.groupBy("evidence_id", "kept_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("n") - 1).alias("dropped"), F.count_if(F.col("n") > 1).alias("groups"))


def fresh_recordings(kept: DataFrame, existing: DataFrame) -> DataFrame:
    """Survivors whose extents no stored recording of the same evidence has."""
    return kept.join(existing.select("evidence_id", "extents"), ["evidence_id", "extents"], "left_anti")


def extents_of(recordings: DataFrame) -> DataFrame:
    """Every extent of the recordings: the input of a coverage map."""
    return recordings.select("evidence_id", F.explode("extents").alias("e")).select("evidence_id", "e.offset", "e.length")
