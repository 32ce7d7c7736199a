"""N-gram Jaccard join by a MinHash LSH forest.

A text's shingles are its runs of WORDS words (runs of non-white space, as they stand), hashed to 64 bits; a text of
fewer words has one shingle, all of them. Texts with equal shingle sets are folded to one representative. Each set has
TREES labels of DEPTH minhash values of 16 bits.

The forest: labels are sorted by (tree, label) in ranges, so a tree is a sorted prefix trie and its nodes at any depth
are runs of equal prefixes; a pass over the sorted labels counts each node's members (a run that crosses a border of
ranges is added up). All trees start at the longest prefix, DEPTH values. While the chance that two sets at the
similarity asked for share a node in some tree is below the target recall, the tree is shortened by a value whose nodes
then bring the fewest further pairs together, as counted on these data.

Verification has two steps, both where sets meet and without pairs leaving a task. First, at each node (nodes with the
same members are one) members' whole labels are compared, all TREES * DEPTH values; pairs whose values agree less often
than five standard errors below the threshold go, and the others are closed to connected components by Spark jobs. So
sets that only share a template's prefix are not joined. Then each set of a component travels once and every pair is
counted exactly by a product of incidence matrices. In both steps a group of more than BLOCK members is dealt to blocks
and each pair of blocks meets once: pairs of a group grow with its square, as its links do, but no task does.

What leaves is a row for each set: the number of links (copies counted) and the smallest set it is linked to; classes
are the connected components of exact links.

Results: class_id is the smallest doc_id of the class; n_links is the number of other rows at least LEAST alike.

Defined results: texts without a word (null, empty, white space) are like nothing: they are classes of their own without
links; rows with a null doc_id too; rows that repeat a doc_id are one document for classes, and each such row counts as
a copy (of different texts under one doc_id only one is held against other texts); a text of any length is one task's
set; an empty table gives an empty table; further columns are not read (`one_of_each` passes them through, whatever
their names).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, scratch, spread, written
from .components import components
from .suffix_dedup import Names, _mix

WORDS, LEAST, RECALL = 5, 0.8, 0.999
TREES, DEPTH = 20, 6
VALUES, STEP = TREES * DEPTH, 2  # bytes of a label's value
BLOCK = 512
COLUMNS = 4096

_rng = np.random.default_rng(20240611)
_TURN = _rng.integers(0, 2**64, (VALUES, 1), dtype=np.uint64)
_STRETCH = _rng.integers(0, 2**64, (VALUES, 1), dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE.encode())] = True


def chance(depths: list[int], least: float = LEAST) -> float:
    """The chance that two sets `least` alike share a node in some of the trees cut at these depths."""
    return 1 - math.prod(1 - least**d for d in depths)


def shortest_depth(least: float = LEAST, recall: float = RECALL) -> int:
    """The depth below which no tree needs to be cut: the longest at which all trees together reach the recall."""
    return next((d for d in range(DEPTH, 1, -1) if chance([d] * TREES, least) >= recall), 1)


def chosen_depths(pairs: dict[tuple[int, int], float], least: float = LEAST, recall: float = RECALL) -> list[int]:
    """Each tree's depth. pairs: (tree, depth) -> pairs of sets that the tree's nodes at that depth bring together."""
    depths, floor = [DEPTH] * TREES, shortest_depth(least, recall)
    while chance(depths, least) < recall:
        open_trees = [t for t in range(TREES) if depths[t] > floor]
        if not open_trees:
            break
        gain = lambda t: math.log((1 - least ** depths[t]) / (1 - least ** (depths[t] - 1)))
        more = lambda t: pairs.get((t, depths[t] - 1), 0) - pairs.get((t, depths[t]), 0)
        depths[min(open_trees, key=lambda t: (more(t) / gain(t), t))] -= 1
    return depths


def least_agreement(least: float) -> int:
    """Agreeing values, of all, below which a pair is not compared exactly: five standard errors under `least`."""
    return max(0, math.floor(VALUES * least - 5 * math.sqrt(VALUES * least * (1 - least))))


def shingles(text: str) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    data = np.frombuffer(text.encode(), np.uint8)
    white = np.concatenate(([True], _IS_WHITE[data], [True]))
    edges = np.flatnonzero(white[1:] != white[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = Names(data).of(starts, ends)
    width = min(WORDS, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total += words[k : len(words) - width + 1 + k] * _PLACE[k]
    return np.unique(_mix(total + np.uint64(width)))


def signature(found: np.ndarray) -> bytes:
    """TREES labels of DEPTH minhash values, 16 bits each."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(found), 2048):
        part = (found[None, s : s + 2048] ^ _TURN) * _STRETCH
        least = np.minimum(least, part.min(axis=1))
    return (_mix(least) >> np.uint64(48)).astype(">u2").tobytes()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, one, two, labels = [], [], [], []
        for text in b.column("text").to_pylist():
            found = shingles(text or "")
            n.append(len(found))
            one.append(found.sum(dtype=np.uint64))
            two.append(_mix(found + np.uint64(1)).sum(dtype=np.uint64))
            labels.append(signature(found))
        columns = [pa.array(n, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)), pa.array(labels, pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n", "a", "b", "labels"])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """A column of values of `width` bytes as rows of bytes."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(-1, width)


def _runs(shortest: int):
    """Nodes of sorted labels: (tree, depth, prefix, members, xor of the members' hashes), and single members that may go
    on beyond the range's border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, list] = {}  # by depth, the run that has not ended: tree, prefix, members, xor, whether at a border

        def made(rows: list) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["tree", "depth", "prefix", "m", "x"])

        for b in batches:
            if not b.num_rows:
                continue
            tree, hashes = b.column("tree").to_numpy(), b.column("h").to_numpy()
            label, rows = _bytes(b.column("label"), DEPTH * STEP), []
            for depth in range(shortest, DEPTH + 1):
                prefix = label[:, : depth * STEP]
                new = np.concatenate(([True], (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1]).any(axis=1)))
                starts = np.flatnonzero(new)
                members, xor = np.diff(np.append(starts, len(tree))), np.bitwise_xor.reduceat(hashes, starts)
                before, border = last.get(depth), depth not in last
                if before and before[:2] == [int(tree[0]), prefix[0].tobytes()]:
                    members[0] += before[2]
                    xor[0] ^= before[3]
                    border = before[4]
                elif before and (before[2] > 1 or before[4]):
                    rows.append((before[0], depth, *before[1:4]))
                end = len(starts) - 1
                told = members[:end] > 1
                if end:
                    told[0] |= border
                for k in np.flatnonzero(told):
                    rows.append((int(tree[starts[k]]), depth, prefix[starts[k]].tobytes(), int(members[k]), int(xor[k])))
                last[depth] = [int(tree[starts[end]]), prefix[starts[end]].tobytes(), int(members[end]), int(xor[end]), border and not end]
            yield made(rows)
        yield made([(x[0], depth, *x[1:4]) for depth, x in last.items()])

    return run


def alike(left: np.ndarray, right: np.ndarray, least: int) -> np.ndarray:
    """Whether row i of left and row j of right agree in at least `least` values."""
    found = np.zeros((len(left), len(right)), bool)
    step = max(1, 2**22 // max(1, right.size))
    for i in range(0, len(left), step):
        found[i : i + step] = (left[i : i + step, None, :] == right[None]).sum(axis=2) >= least
    return found


def _node_links(least: int):
    """(rep, root) for the members of a node's block, or pair of blocks, that likely links join to a smaller one."""

    def group(rows: list[tuple]) -> tuple[list, list]:
        """rows: (rep, block, labels)."""
        labels = np.frombuffer(b"".join(r[2] for r in rows), ">u2").reshape(-1, VALUES)
        block = np.array([r[1] for r in rows])
        if block[0] == block[-1] and (block == block[0]).all():
            found = alike(labels, labels, least)
        else:
            one = np.flatnonzero(block == block.min())
            two = np.flatnonzero(block != block.min())
            found = np.zeros((len(rows), len(rows)), bool)
            part = alike(labels[one], labels[two], least)
            found[np.ix_(one, two)], found[np.ix_(two, one)] = part, part.T
        root = roots(found)
        moved = np.flatnonzero(root != np.arange(len(rows)))
        return [rows[i][0] for i in moved], [rows[root[i]][0] for i in moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out, kind = None, [], ([], []), pa.int64()

        def end() -> None:
            if len(rows) > 1 and (key[1] == key[2] or len({r[1] for r in rows}) == 2):
                for column, values in zip(out, group(sorted(rows))):
                    column.extend(values)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c in out], ["u", "v"])

        for b in batches:
            kind = b.schema.field("rep").type
            columns = [b.column(c).to_pylist() for c in ("node", "low", "high", "rep", "block", "labels")]
            for node, low, high, *row in zip(*columns):
                if (node, low, high) != key:
                    end()
                    key, rows = (node, low, high), []
                rows.append(tuple(row))
            if len(out[0]) > 50_000:
                yield made()
                for column in out:
                    column.clear()
        end()
        yield made()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of representatives; a row whose text is not the representative's (a doc_id twice) is left out."""
    for b in batches:
        keep, sets = [], []
        for i, (text, a) in enumerate(zip(b.column("text").to_pylist(), b.column("a").to_pylist())):
            found = shingles(text or "")
            if int(found.sum(dtype=np.uint64).view(np.int64)) == a:
                keep.append(i)
                sets.append(found.tobytes())
        rows = b.select(["rep", "copies", "component", "blocks", "block"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sets, pa.binary())], [*rows.schema.names, "shingles"])


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, least: float) -> np.ndarray:
    """Whether set i of left and set j of right (of left itself if None) are at least `least` alike, i unlike j."""
    sets = left + (right or [])
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    new = np.concatenate(([0], np.cumsum(np.diff(column) > 0))) if len(column) else column
    m = len(left)
    common = np.zeros((m, len(right) if right else m), np.float32)
    for c in range(0, int(new[-1]) + 1 if len(new) else 0, COLUMNS):
        low, high = np.searchsorted(new, (c, c + COLUMNS))
        x = np.zeros((len(sets), min(COLUMNS, int(new[-1]) + 1 - c)), np.float32)
        x[row[low:high], new[low:high] - c] = 1
        common += x[:m] @ (x[m:].T if right else x.T)
    both = size[:m, None] + (size[m:] if right else size)[None, :]
    found = common >= least * (both - common) - 1e-6
    if not right:
        np.fill_diagonal(found, False)
    return found


def roots(found: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each in a symmetric matrix of links."""
    label = np.arange(len(found))
    while True:
        new = np.minimum(label, np.where(found, label[None, :], len(found)).min(axis=1, initial=len(found)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(least: float):
    def group(rows: list[tuple]) -> tuple[list, list, list]:
        """rows: (rep, copies, block, set); of one block or of two. Each pair is counted where its blocks meet."""
        rows = sorted({r[0]: r for r in rows}.values())
        blocks = sorted({r[2] for r in rows})
        sides = [[r for r in rows if r[2] == k] for k in blocks]
        ids, copies = (np.array([r[k] for s in sides for r in s]) for k in (0, 1))
        sets = [[np.frombuffer(r[3], np.uint64) for r in s] for s in sides]
        if len(sides) == 1:
            full = linked(sets[0], None, least)
        else:
            part, m = linked(*sets, least), len(sets[0])
            full = np.zeros((len(ids), len(ids)), bool)
            full[:m, m:], full[m:, :m] = part, part.T
        order = np.argsort(ids)
        full, ids, copies = full[np.ix_(order, order)], ids[order], copies[order]
        return ids.tolist(), ids[roots(full)].tolist(), (full @ copies).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out, kind = None, [], ([], [], [], []), pa.int64()

        def end() -> None:
            if rows and (key[1] == key[2] or len({r[2] for r in rows}) == 2):
                made = group(rows)
                for column, values in zip(out, (*made, [key[3]] * len(made[0]))):
                    column.extend(values)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], kind), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["rep", "root", "links", "blocks"])

        for b in batches:
            kind = b.schema.field("rep").type
            columns = [b.column(c).to_pylist() for c in ("component", "low", "high", "blocks", "rep", "copies", "block", "shingles")]
            for component, low, high, blocks, *row in zip(*columns):
                if (component, low, high, blocks) != key:
                    end()
                    key, rows = (component, low, high, blocks), []
                rows.append(tuple(row))
            if len(out[0]) > 50_000:
                yield made()
                for column in out:
                    column.clear()
        end()
        if out[0]:
            yield made()

    return run


def _met(members: DataFrame, *key: str) -> DataFrame:
    """Members (with key, block and blocks) once for each pair of blocks (low, high) that theirs is in, dealt and sorted by it."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = members.select("*", other).select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return met.repartition(*key, "low", "high").sortWithinPartitions(*key, "low", "high")


def candidate_edges(reps: DataFrame, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """(u, v): sets (rep, labels) that share a node of the forest and whose labels are likely those of links."""
    kind = reps.schema["rep"].dataType.simpleString()
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    label = lambda values: F.substring(F.col("labels"), F.col("tree") * (DEPTH * STEP) + 1, values * STEP)
    sorted_labels = reps.select("rep", "labels", tree).select("tree", label(F.lit(DEPTH)).alias("label"), "rep", F.xxhash64("rep").alias("h"))
    sorted_labels = sorted_labels.repartitionByRange("tree", "label", "rep").sortWithinPartitions("tree", "label")
    runs = sorted_labels.select("tree", "label", "h").mapInArrow(_runs(shortest_depth(least, recall)), "tree int, depth int, prefix binary, m long, x long")
    nodes = written(runs.groupBy("tree", "depth", "prefix").agg(F.sum("m").alias("m"), F.bit_xor("x").alias("x")).where("m > 1"), "nodes")
    pairs = nodes.groupBy("tree", "depth").agg(F.sum(F.col("m").cast("double") * (F.col("m") - 1) / 2).alias("pairs")).collect()  # TREES * DEPTH rows at most
    depths = chosen_depths({(r["tree"], r["depth"]): r["pairs"] for r in pairs}, least, recall)
    depth = F.element_at(F.array(*[F.lit(d) for d in depths]), F.col("tree") + 1)
    chosen = nodes.where(F.col("depth") == depth).groupBy("m", "x").agg(F.min(F.struct("tree", "prefix")).alias("n"))  # nodes with the same members are one
    chosen = chosen.select("n.tree", "n.prefix", F.xxhash64("n.tree", "n.prefix").alias("node"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    members = reps.select("rep", "labels", tree).select("tree", label(depth).alias("prefix"), "rep")
    members = members.join(spread(chosen, "tree", "prefix"), ["tree", "prefix"]).drop("tree", "prefix")
    members = members.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "rep"), F.col("blocks")).cast("int"))
    members = members.join(reps.select("rep", "labels").hint("merge"), "rep")
    return _met(members, "node").mapInArrow(_node_links(least_agreement(least)), f"u {kind}, v {kind}")


def near_groups(docs: DataFrame, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, kept) for each row of docs; kept marks one document of each class."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    with scratch(docs.sparkSession):
        signed = written(rows.mapInArrow(_signed, f"doc_id {kind}, n long, a long, b long, labels binary"), "signatures", keep=True)
        named = signed.where("n > 0 and doc_id is not null")
        reps = named.groupBy("a", "b", "n").agg(F.min(F.struct("doc_id", "labels")).alias("r"), F.count(F.lit(1)).alias("copies"))
        reps = written(reps.select("a", "b", "n", F.col("r.doc_id").alias("rep"), "copies", "r.labels"), "representatives")
        found = components(candidate_edges(reps, least, recall))
        member = written(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "components")
        sizes = member.groupBy(F.col("root").alias("component")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        member = member.withColumnRenamed("root", "component").join(spread(sizes, "component"), "component")
        member = member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        member = written(member.join(reps.select(F.col("rep").alias("node"), "copies", "a"), "node").withColumnRenamed("node", "rep"), "members")
        # verification: sets travel, each pair of blocks meets once
        sets = rows.join(member.hint("merge"), rows.doc_id == member.rep).select("text", "rep", "copies", "a", "component", "blocks", "block")
        sets = sets.mapInArrow(_sets, f"rep {kind}, copies long, component {kind}, blocks int, block int, shingles binary")
        links = written(_met(sets, "component").mapInArrow(_links(least), f"rep {kind}, root {kind}, links long, blocks long"), "links")
        # classes
        counted = links.groupBy("rep").agg(F.sum("links").alias("links"))
        whole = links.where("blocks = 1").select(F.col("rep").alias("node"), "root")
        parts = components(links.where("blocks > 1").select(F.col("rep").alias("u"), F.col("root").alias("v")))
        classes = written(counted.join(whole.unionByName(parts).withColumnRenamed("node", "rep"), "rep", "left"), "classes")
        told = reps.select("a", "b", "n", "rep", "copies").join(classes, "rep", "left")
        told = told.select("a", "b", "n", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        told = written(told, "told", keep=True)
    out = signed.select("doc_id", "n", "a", "b").withColumn("usable", F.col("n").cast("boolean") & F.col("doc_id").isNotNull())
    out = out.join(spread(told.withColumn("usable", F.lit(True)), "a", "b"), ["a", "b", "n", "usable"], "left")
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs that stand for their class, unchanged."""
    kept = written(near_groups(docs, least).where("kept").select(F.col("doc_id").alias("__id")).distinct(), "kept")
    return docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["__id"]), "left_semi")


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
