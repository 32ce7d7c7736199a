"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

Prefix doubling ranks every position of the corpus by its first h bytes, then sorts the pairs (rank at p, rank at p+h),
doubles h, and drops positions whose rank is unique, until h passes the threshold. A row for each byte of the corpus in
each round is more than the limits allow (README has figures), so the rounds here start from a sparse set of positions
that stands for all of them:

* Names. A byte string is named by a 64-bit polynomial hash; names of adjoining strings combine, so a position's rank at
  any h needs no table of ranks. (Two such names are compared together wherever rows are removed.)
* Anchors. Each window of 100 bytes is represented by the position in it whose first 32 bytes have the smallest name
  (the leftmost of equals). Equal windows have the same anchor at the same place, so windows need only be compared
  where their anchors are equal, and one position in about 35 bytes is an anchor.
* Round 1, h = 32: anchors are counted by name; those with a unique rank go, with all their windows.
* Round 2, h = 168: the others are ranked by the bytes from 68 before to 100 after them, which contain every window they
  stand for. All but the first of a rank repeat an earlier place: their windows are removed. A first one keeps its
  windows if no other rank has its 32 bytes.
* Round 3, h = 100: the first ones that are left differ somewhere in their 168 bytes. Where up to FEW ranks share 32
  bytes, their surroundings meet in one place and are compared there, in corpus order; where more do, each window is
  named and all but the first of a name are removed. Both give the same rows; the first moves fewer.

Spark counts, joins and sorts the rows of each round; tasks make names with numpy over whole texts. A text of any length
is read in stretches that overlap by 99 bytes, so memory is bounded by the text itself. Hot anchors (a passage in a
third of all documents) are counted with partial aggregates, and the joins that hand ranks back split their rows.

Defined results: a null text is empty; matches may overlap; texts under 100 bytes lose nothing; of rows that repeat a
doc_id (which the contract does not foresee) the places are ordered by doc_id, then start, and a place that occurs twice
counts once; null doc_ids order first; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, spread, written

LENGTH = 100
GRAM = 32
SIDE = LENGTH - GRAM
#: Up to so many different surroundings of equal 32 bytes are compared in one place.
FEW = 64
#: Bytes that are named at once (their arrays stay in a core's cache), and bits for a place within them.
STRETCH, BITS = 1 << 16, 17

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = [0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64, n of them at least."""
    if which not in _powers or len(_powers[which][0]) < n:
        size = max(n, STRETCH + 4 * LENGTH + 1)
        base = _BASE[which]
        tables = []
        for b in (base, pow(base, -1, 2**64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[which] = (tables[0], tables[1])
    return _powers[which]


class Names:
    """Names of the substrings of a byte array."""

    def __init__(self, data: np.ndarray, which: int = 0):
        power, self.inverse = _power(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[which][data] * power[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def anchors(names: Names, start: int, n: int) -> np.ndarray:
    """The anchor of each window in n bytes (LENGTH at least) from start on, counted from there."""
    at = np.arange(n - GRAM + 1, dtype=np.uint64)
    sums, end = names.sums, start + n - GRAM + 1
    gram = _mix((sums[start + GRAM : end + GRAM] - sums[start:end]) * names.inverse[start:end])
    low, span = (gram >> np.uint64(BITS) << np.uint64(BITS)) | at, 1
    while 2 * span <= SIDE + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = SIDE + 1 - span
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return (low & np.uint64((1 << BITS) - 1)).astype(np.int64)


def stretches(data: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(from, to, first window) parts of a text: windows that start in a part lie in it, with SIDE bytes to each side."""
    for start in range(0, max(1, len(data) - LENGTH + 1), STRETCH):
        yield max(0, start - SIDE), min(len(data), start + STRETCH + 2 * LENGTH), start


class Anchors:
    """Anchors of some texts that lie in one byte array: for each, its text (row), place in the text, place `at` and
    first and last window in the array, and the text's start (base) in the array."""

    def __init__(self, part: np.ndarray, names: Names, row: np.ndarray, base: np.ndarray, size: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.part, self.names, self.row, self.base, self.size = part, names, row, base, size
        self.at, self.first, self.last, self.place = at, first, last, at - base

    def gram(self) -> np.ndarray:
        """The names of the anchors' 32 bytes."""
        return self.names.of(self.at, self.at + GRAM)

    def around(self) -> np.ndarray:
        """The names of the bytes from SIDE before to LENGTH after each anchor, cut at the text's ends."""
        left, right = np.maximum(self.at - SIDE, self.base), np.minimum(self.at + LENGTH, self.base + self.size)
        lengths = np.uint64(0x9E3779B97F4A7C15) * (self.at - left).astype(np.uint64) + (right - self.at).astype(np.uint64)
        return _mix(self.names.of(left, right) + lengths)


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[Anchors]:
    """Anchors of the texts data[offsets[i] : offsets[i + 1]]: of as many as STRETCH bytes hold at once, and of a longer
    text in parts."""
    rows = len(offsets) - 1
    low = 0
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + STRETCH, "right")) - 1)
        start, end = int(offsets[low]), int(offsets[high])
        if high == low + 1 and end - start > STRETCH:
            for a, b, first in stretches(data[start:end]):
                stop = min(first + STRETCH, end - start - LENGTH + 1)
                part = data[start + a : start + b]
                names = Names(part)
                chosen = anchors(names, first - a, stop + LENGTH - 1 - first) + first - a
                new = np.concatenate(([0], np.flatnonzero(np.diff(chosen)) + 1, [len(chosen)]))
                n = len(new) - 1
                yield Anchors(part, names, np.full(n, low), np.full(n, -a), np.full(n, end - start), chosen[new[:-1]], new[:-1] + first - a, new[1:] - 1 + first - a)
        elif end - start >= LENGTH:
            part = data[start:end]
            names = Names(part)
            chosen = anchors(names, 0, len(part))
            doc = np.repeat(np.arange(low, high, dtype=np.int32), np.diff(offsets[low : high + 1]))
            inside = doc[: len(chosen)] == doc[LENGTH - 1 :]  # windows that do not cross into the next text
            owner = np.where(inside, chosen, -1 - doc[: len(chosen)])
            new = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]))
            first, last = new[:-1], new[1:] - 1
            keep = inside[first]
            first, last = first[keep], last[keep]
            row = doc[first].astype(np.int64)
            base = offsets[row] - start
            yield Anchors(part, names, row, base, offsets[row + 1] - offsets[row], chosen[first], first, last)
        low = high


def anchor_rows(data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(name of 32 bytes, name of the surroundings, place, first window, last window) of one text's anchors."""
    for x in anchors_of(data, np.array([0, len(data)])):
        yield x.gram(), x.around(), x.place, x.first - x.base, x.last - x.base


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, joined, and each one's start in them (and the end)."""
    values = column.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets if len(offsets) else np.zeros(1, np.int64)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of lists of numbers."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), column.flatten().to_numpy()


def _keys(row: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (row.astype(np.int64) << 44) | place


def _among(x: Anchors, keys: np.ndarray) -> np.ndarray:
    """Which of the anchors are among sorted keys: only those of the anchors' own texts are looked at."""
    low, high = np.searchsorted(keys, (x.row[0] << 44, (x.row[-1] + 1) << 44)) if len(x.row) else (0, 0)
    return np.isin(_keys(x.row, x.place), keys[low:high]) if low < high else np.zeros(len(x.row), bool)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchors(with_place: bool):
    """Rows (gram) or (gram, around, doc_id, place) for the anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in anchors_of(*_texts(b.column("text"))):
                if with_place:
                    columns = [_signed(x.gram()), _signed(x.around()), b.column("doc_id").take(pa.array(x.row)), pa.array(x.place)]
                    yield pa.RecordBatch.from_arrays(columns, ["gram", "around", "doc_id", "place"])
                else:
                    yield pa.RecordBatch.from_arrays([_signed(x.gram())], ["gram"])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the anchors in `many`: (a, b, doc_id, first) of each window; for those in `few`: (a: the 32 bytes' name,
    doc_id, first, last, place, left: bytes before it, around)."""
    for b in batches:
        few, many = (np.sort(_keys(*_lists(b.column(c)))) for c in ("few", "many"))
        for x in anchors_of(*_texts(b.column("text"))):
            made = []
            own = np.flatnonzero(_among(x, many))
            if len(own):
                size = x.last[own] - x.first[own] + 1
                starts = np.arange(size.sum()) + np.repeat(x.first[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
                two = Names(x.part, 1).of(starts, starts + LENGTH).view(np.int64) >> np.int64(32)
                none = np.full(len(starts), -1)
                made.append((x.names.of(starts, starts + LENGTH).view(np.int64), two, np.repeat(x.row[own], size), starts - np.repeat(x.base[own], size), none, none, none, [None] * len(starts)))
            own = np.flatnonzero(_among(x, few))
            if len(own):
                left, right = np.maximum(x.at - SIDE, x.base)[own], np.minimum(x.at + LENGTH, x.base + x.size)[own]
                around = [x.part[s:e].tobytes() for s, e in zip(left.tolist(), right.tolist())]
                made.append((x.gram().view(np.int64)[own], np.zeros(len(own), np.int64), x.row[own], (x.first - x.base)[own], (x.last - x.base)[own], x.place[own], x.at[own] - left, around))
            for one, two, row, *numbers, around in made:
                columns = [pa.array(one), pa.array(two.astype(np.int32)), b.column("doc_id").take(pa.array(row)), *map(pa.array, numbers), pa.array(around, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "doc_id", "first", "last", "place", "left", "around"])


def shared_windows(group: list[tuple]) -> Iterator[tuple[object, int, int]]:
    """(doc_id, first, last) starts of windows that also lie in an earlier member of the group.

    group: (doc_id, first, last, place, left, around) of anchors with equal 32 bytes, in corpus order. Rows of one anchor
    that a long text's stretches share are one member."""
    joined: list[tuple] = []
    for g in group:
        if joined and (joined[-1][0], joined[-1][3]) == (g[0], g[3]):
            doc_id, first, last, *rest = joined[-1]
            joined[-1] = (doc_id, min(first, g[1]), max(last, g[2]), *rest)
        else:
            joined.append(g)
    group = joined
    m = len(group)
    here = np.zeros((m, SIDE + LENGTH), np.uint8)
    left, right = np.array([g[4] for g in group]), np.array([len(g[5]) - g[4] - GRAM for g in group])
    for k, g in enumerate(group):
        here[k, SIDE - g[4] : SIDE - g[4] + len(g[5])] = np.frombuffer(g[5], np.uint8)
    before, after = here[:, SIDE - 1 :: -1] if SIDE else here[:, :0], here[:, SIDE + GRAM :]
    for i in range(1, m):
        reach = []
        for side, room in ((before, left), (after, right)):
            differ = side[:i] != side[i]
            same = np.where(differ.any(axis=1), differ.argmax(axis=1), SIDE)
            reach.append(np.minimum(same, np.minimum(room[:i], room[i])))
        low, high = SIDE - reach[1], reach[0]  # windows that begin low to high bytes before the anchor are shared
        change = np.zeros(SIDE + 2, np.int64)
        good = low <= high
        np.add.at(change, low[good], 1)
        np.add.at(change, high[good] + 1, -1)
        doc_id, first, last, place = group[i][:4]
        shared = np.cumsum(change)[: SIDE + 1] > 0
        shared[: max(0, place - last)] = False
        shared[place - first + 1 :] = False
        edges = np.flatnonzero(np.diff(np.concatenate(([0], shared.astype(np.int8), [0]))))
        for s, e in edges.reshape(-1, 2):
            yield doc_id, place - int(e) + 1, place - int(s)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shared_windows of each run of rows with one name `a`; rows come sorted by name and in corpus order."""
    name, group, found, kind = None, [], [], pa.int64()
    for b in batches:
        kind = b.schema.field("doc_id").type
        columns = [b.column(c).to_pylist() for c in ("a", "doc_id", "first", "last", "place", "left", "around")]
        for a, *row in zip(*columns):
            if a != name:
                found += shared_windows(group)
                name, group = a, []
            group.append(tuple(row))
        if len(found) > 50_000:
            yield _ranges(found, kind)
            found = []
    found += shared_windows(group)
    if found:
        yield _ranges(found, kind)


def _ranges(found: list, kind: pa.DataType) -> pa.RecordBatch:
    ids, first, last = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["doc_id", "first", "last"])


def removed_ranges(data: np.ndarray, offsets: np.ndarray, places: tuple, windows: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end): the bytes of each text covered by repeated anchors' windows and by repeated windows, joined.

    places: (row, place); windows: (row, first start, last start)."""
    keys = np.sort(_keys(*places))
    spans = [(offsets[windows[0]] + windows[1], offsets[windows[0]] + windows[2] + LENGTH)]
    if len(keys):
        for x in anchors_of(data, offsets):
            own = _among(x, keys)
            start = (offsets[x.row] - x.base)[own]
            spans.append((x.first[own] + start, x.last[own] + start + LENGTH))
    start, end = (np.concatenate([s[k] for s in spans]) for k in (0, 1))
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    if not len(start):
        return start, start, start
    reach = np.maximum.accumulate(end)
    row = np.searchsorted(offsets, start, "right") - 1
    new = np.concatenate(([True], (start[1:] > reach[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(new)
    stop = reach[np.concatenate((first[1:], [len(start)])) - 1]
    return row[first], start[first] - offsets[row[first]], stop - offsets[row[first]]


def _removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = _texts(b.column("text"))
        row, last = _lists(b.column("first"))[0], _lists(b.column("last"))[1]
        row, start, end = removed_ranges(data, offsets, _lists(b.column("places")), (row, _lists(b.column("first"))[1], last))
        bounds = np.searchsorted(row, np.arange(b.num_rows + 1))
        ranges, kept, digests = [], [], []
        for i in range(b.num_rows):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            own = np.stack([start[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]]], axis=1)
            if len(own):
                ends = [0, *own.ravel().tolist(), len(raw)]
                raw = b"".join(raw[s:e] for s, e in zip(ends[::2], ends[1::2]))
            ranges.append(own.tolist())
            kept.append(raw)
            digests.append(hashlib.sha256(raw).hexdigest())
        size = np.diff(offsets)
        left = np.array([len(k) for k in kept], np.int64)
        columns = [b.column("doc_id"), pa.array(size), pa.array(size - left), pa.array(ranges, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "removed", "kept", "kept_sha256"])


def repeated_places(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, place) of anchors whose windows all repeat earlier ones; (doc_id, start) of further windows that do."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # round 1: 32 bytes
    grams = docs.select("doc_id", "text").mapInArrow(_anchors(False), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    grams = written(grams.where("n > 1").select("gram"), "grams")
    places = docs.select("doc_id", "text").mapInArrow(_anchors(True), f"gram long, around long, doc_id {kind}, place long")
    places = written(places.join(spread(grams, "gram"), "gram"), "places")
    # round 2: 168 bytes
    ranks = written(places.groupBy("gram", "around").agg(F.min(F.struct("doc_id", "place")).alias("first")), "ranks")
    several = ranks.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranks = written(ranks.join(spread(several, "gram"), "gram", "left"), "ranks")
    told = places.join(spread(ranks, "gram", "around"), ["gram", "around"])
    is_first = F.struct("doc_id", "place").eqNullSafe(F.col("first"))
    told = told.select("doc_id", "place", is_first.alias("is_first"), "n").where("not is_first or n is not null")
    told = written(told, "told")
    # round 3: windows of 100 bytes
    asked = told.where("is_first").groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("n") <= FEW, F.col("place"))).alias("few"), F.collect_set(F.when(F.col("n") > FEW, F.col("place"))).alias("many")
    )
    texts = docs.select("doc_id", "text").join(asked.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")))
    windows = texts.select("doc_id", "text", "few", "many").mapInArrow(
        _asked, f"a long, b int, doc_id {kind}, first long, last long, place long, left long, around binary"
    )
    windows = written(windows, "windows")
    few = windows.where("around is not null").repartition("a").sortWithinPartitions("a", "doc_id", "place")
    few = few.mapInArrow(_compared, f"doc_id {kind}, first long, last long")
    many = windows.where("around is null").select("a", "b", "doc_id", "first")
    firsts = many.groupBy("a", "b").agg(F.min(F.struct("doc_id", "first")).alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = written(firsts.drop("n"), "firsts")
    again = many.join(spread(firsts, "a", "b"), ["a", "b"]).where(~F.struct("doc_id", "first").eqNullSafe(F.col("one")))
    found = few.unionByName(again.select("doc_id", "first", F.col("first").alias("last")))
    return told.where("not is_first").select("doc_id", "place"), written(found, "found")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (byte ranges), kept (the remaining bytes), kept_sha256 for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    with scratch(docs.sparkSession):
        places, windows = repeated_places(rows)
        found = places.groupBy("doc_id").agg(F.collect_set("place").alias("places")).withColumn("pairs", F.lit(None).cast("array<struct<first:bigint,last:bigint>>"))
        found = found.unionByName(
            windows.groupBy("doc_id").agg(F.lit(None).cast("array<bigint>").alias("places"), F.collect_list(F.struct("first", "last")).alias("pairs"))
        )
        found = found.groupBy("doc_id").agg(F.first("places", True).alias("places"), F.first("pairs", True).alias("pairs"))
        found = written(found.select(F.col("doc_id").alias("__id"), "places", F.col("pairs.first").alias("first"), F.col("pairs.last").alias("last")), "removed", keep=True)
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", "text", "places", "first", "last")
    return both.mapInArrow(_removal, f"doc_id {kind}, n_bytes long, n_removed long, removed array<array<long>>, kept binary, kept_sha256 string")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    made = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return made.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
