"""Exact top-k search by distributed histogram selection.

Vectors are turned into integers, floor(SCALE * x), and packed into blocks of some thousand rows. Blocks of queries meet
blocks of candidates on a grid of (candidate group, query stripe), whose cells are bounded; in a cell every query is
scored against every candidate by a matrix product. No score leaves its task. A pass makes a histogram of the scores of
each query instead: BINS bins over the range that still holds the k-th value, of which a cell sends only those from the
top down that can hold it. The histograms are summed over all cells, the bin with the k-th value becomes the next pass's
range, and passes go on until a bin is one value wide (two passes for vectors of norm about one). The last pass scores
once more and keeps what lies above the k-th value, and of those equal to it the smallest vec_ids; a query's rows of all
cells are then ranked.

Scores are exact: products are of 32-bit floats while every partial sum is below 2^24, of 64-bit floats below 2^53, and
of Python's integers beyond. A score beyond the range of a long counts as that range's end.

Between the passes only counts and a row for each query move; vectors travel once a pass, S copies of a candidate and G
of a query. Every table between is written to the shared folder, so a lost executor repeats tasks, not passes.

Defined results: vectors that are null, or hold a null or a component that is not finite, take no part; nor do rows
without vec_id; vectors of different length don't meet; an empty vector scores 0 with others of no length; rows that
share the query's vec_id are not its candidates; rows that repeat a vec_id are candidates each, and with equal vectors
one query; queries of fewer than k candidates get all; ties go to the smaller vec_id; an empty table gives an empty
table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written

SCALE, TOP, EVERY = 256, 5, 50
BITS = 12
BINS = 1 << BITS
CANDIDATES, QUERIES = 1024, 512  # rows of a block
ACROSS = 32  # blocks of one side in a cell, at most about
LONG = 2**63

PACKED = "dims int, n int, most double, ids binary, matrix binary"


def whole(matrix: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly: a double times a power of two."""
    return np.floor(matrix * float(SCALE))


def _packed(size: int, extra: tuple[str, ...] = ()):
    """Rows (vec_id, embedding, further longs) to blocks of vectors of one length, as PACKED with a binary for each further long."""

    def block(ids: np.ndarray, matrix: np.ndarray, rest: list[np.ndarray]) -> list:
        most = float(np.abs(matrix).max(initial=0.0))
        matrix = matrix.astype("<i2" if most < 2**15 else "<f8")
        return [matrix.shape[1], len(ids), most, ids.tobytes(), matrix.tobytes(), *(r.tobytes() for r in rest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * (2 + len(extra))]
        names = ["dims", "n", "most", "ids", "matrix", *extra]
        held: dict[int, list] = {}

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)

        for b in batches:
            ids = b.column("vec_id").to_numpy(zero_copy_only=False).astype("<i8")
            rest = [b.column(c).to_numpy(zero_copy_only=False).astype("<i8") for c in extra]
            vectors = b.column("embedding")
            flat, dims = vectors.flatten().to_numpy(zero_copy_only=False).astype(float), np.diff(vectors.offsets.to_numpy())
            start = np.concatenate(([0], np.cumsum(dims)))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                matrix = whole(flat[start[at][:, None] + np.arange(d)])
                was = held.get(d)
                parts = [ids[at], matrix, *(r[at] for r in rest)]
                held[d] = [np.concatenate(x) for x in zip(was, parts)] if was else parts
                while len(held[d][0]) >= size:
                    one = [x[:size] for x in held[d]]
                    held[d] = [x[size:] for x in held[d]]
                    yield out([block(one[0], one[1], one[2:])])
        for left in held.values():
            if len(left[0]):
                yield out([block(left[0], left[1], left[2:])])

    return run


def scores(queries: np.ndarray, candidates: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of all pairs of rows, exact; bound: no partial sum is larger."""
    if bound < 2**24:
        return (queries.astype(np.float32) @ candidates.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (queries.astype(float) @ candidates.astype(float).T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in queries], object).reshape(queries.shape) @ np.array([[int(x) for x in row] for row in candidates], object).reshape(candidates.shape).T
    return np.clip(exact, -LONG, LONG - 1).astype(np.int64)


def _blocks(table: pa.Table, extra: tuple[str, ...] = ()) -> Iterator[tuple]:
    for row in table.to_pylist():
        kind = "<i2" if row["most"] < 2**15 else "<f8"
        yield (np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["matrix"], kind).reshape(row["n"], row["dims"]), row["most"], *(np.frombuffer(row[c], "<i8") for c in extra))


def _met(left: pa.Table, right: pa.Table, offset: int) -> Iterator[tuple]:
    """For each block of queries: its state, and an iterator over (ids, above zero by `offset`, is a candidate) of the blocks it meets."""
    candidates = [*_blocks(left)]
    for ids, matrix, most, *state in _blocks(right, ("q", "base", "need")):

        def each(ids=ids, matrix=matrix, most=most):
            for other, against, theirs in candidates:
                if against.shape[1] == matrix.shape[1]:
                    key = scores(matrix, against, max(matrix.shape[1], 1) * most * theirs).view(np.uint64) + np.uint64(offset)
                    yield other, key, ids[:, None] != other[None, :]

        yield ids, state, each()


def _histograms(offset: int, shift: int, last: int):
    """Cells to (q, bin, n): bins of width 2^shift from each query's base, among the scores of its range of 2^last."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for _, (q, base, need), each in _met(left, right, offset):
            found = np.zeros(len(q) * BINS, np.int64)
            low = base.view(np.uint64)[:, None]
            for _, key, real in each:
                away = (key - low) >> np.uint64(shift)  # below the base: wraps to a large number
                real &= (key >= low) & (away < np.uint64(1 << (last - shift)))
                at, _ = np.nonzero(real)
                found += np.bincount(at * BINS + away[real].astype(np.int64), minlength=len(found))
            found = found.reshape(len(q), BINS)
            above = np.cumsum(found[:, ::-1], axis=1)[:, ::-1] - found
            at, bins = np.nonzero((found > 0) & (above < need[:, None]))
            rows.append((q[at], bins, found[at, bins]))
        columns = [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("q", "bin", "n"), columns)))

    return run


def _chosen(offset: int, k: int):
    """Cells to (q, vec_id, score): what lies above a query's k-th value, and the k smallest ids of those equal to it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for _, (q, base, _), each in _met(left, right, offset):
            low = base.view(np.uint64)[:, None]
            for other, key, real in each:
                order = np.argsort(other, kind="stable")
                other, key, real = other[order], key[:, order], real[:, order]
                equal = real & (key == low)
                at, to = np.nonzero(real & (key > low) | equal & (np.cumsum(equal, axis=1) <= k))
                rows.append((q[at], other[to], (key[at, to] - np.uint64(offset)).view(np.int64)))
        columns = [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("q", "vec_id", "score"), columns)))

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) * SCALE < float("inf")))  # of NaN it isn't
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k candidates of highest score. Both tables: vec_id, embedding."""
    spark = queries.sparkSession
    with scratch(spark):
        asked = usable(queries).dropDuplicates(["vec_id", "embedding"])
        asked = written(asked.withColumn("q", F.monotonically_increasing_id()), "asked")
        blocks = written(usable(candidates).mapInArrow(_packed(CANDIDATES), PACKED).withColumn("block", F.monotonically_increasing_id()), "vectors")
        n_blocks, dims, most = blocks.agg(F.count(F.lit(1)), F.coalesce(F.max("dims"), F.lit(0)), F.coalesce(F.max("most"), F.lit(0.0))).first()
        largest = F.array_max(F.transform("embedding", lambda x: F.abs(F.floor(x * float(SCALE)).cast("double"))))
        n_asked, largest = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(largest), F.lit(0.0))).first()
        groups = max(1, min(n_blocks, max(-(-n_blocks // ACROSS), spark.sparkContext.defaultParallelism)))
        stripes = max(1, -(-n_asked // (ACROSS * QUERIES)))
        offset = min(dims * int(most) * int(largest), LONG)  # scores lie between -offset and offset
        left = blocks.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).drop("block")

        def cells(state: DataFrame, run, schema: str) -> DataFrame:
            packed = state.mapInArrow(_packed(QUERIES, ("q", "base", "need")), PACKED + ", q binary, base binary, need binary")
            packed = written(packed.withColumn("s", F.pmod(F.monotonically_increasing_id(), F.lit(stripes)).cast("int")), "stripes")
            right = packed.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
            return left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(run, schema)

        state = asked.withColumns({"base": F.lit(0).cast("long"), "need": F.lit(k).cast("long")})
        last = min(64, (2 * offset).bit_length() or 1)
        while last:
            shift = max(0, last - BITS)
            found = cells(state, _histograms(offset, shift, last), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            down = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
            found = found.withColumn("above", F.sum("n").over(down) - F.col("n")).withColumnRenamed("q", "__q")
            holds = (F.col("q") == F.col("__q")) & (F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need"))
            low = F.col("base").bitwiseOR(F.shiftleft("bin", shift))
            state = state.join(found, holds, "left")  # a bin or, where there are fewer than k candidates, none: all are above 0
            state = state.withColumns({"base": F.coalesce(low, F.lit(0)).cast("long"), "need": F.coalesce(F.col("need") - F.col("above"), F.lit(k)).cast("long")})
            state = written(state.select("q", "vec_id", "embedding", "base", "need"), "state")
            last = shift
        rows = cells(state, _chosen(offset, k), "q long, vec_id long, score long")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = asked.select("q", F.col("vec_id").alias("query_id"))
        return written(rows.join(named, "q").select("query_id", "rank", "vec_id", "score"), "found", keep=True)


def op13_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_topk(vectors.where(F.col("vec_id") % EVERY == 0), vectors)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
"""
