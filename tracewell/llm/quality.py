"""Quality classifier by positive-unlabelled learning.

Trusted positives (rows labelled of good quality) and all texts as unlabelled ones train g(x) = w . phi(x) by minimising
the non-negative unbiased risk  prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])  with the squared loss
l(z) = (1 - z)^2 / 4 and a ridge. With that loss each expectation is a quadratic form in w, given by the first and second
moments of phi over the positives and over all rows. So no row is sampled: tasks add up moments, Spark sums them (a
matrix of a few hundred rows, whatever the input), and the risk is minimised exactly from the sums. Where the second part
would be negative, the least risk lies on the edge where it is 0, which is found by bisecting its multiplier.

Rows labelled bad are never used. The class prior is estimated: classifiers of positives against unlabelled, each fitted
to one half of the rows, score the other half; the prior is the smallest ratio, over the top of that ranking, of the
unlabelled share to the positive share (with an allowance for small counts). Score shares are counted in bins by tasks.

A text's features are made once, over its whole bytes and words: shares of kinds of bytes, counts of words and lines,
hashed runs of three byte kinds, and hashed single words and word pairs. phi is these, standardised, and the tanh of
HIDDEN fixed random mixtures of the counts. The model is a few hundred numbers, sent with the scoring tasks.

HIDDEN, RIDGE, HASHED and CUT were chosen among 48 settings by folds over the labels of rows that are not held out;
labels of held-out rows were not read for it.

Defined results: null or empty text has the features of no words and is scored as all others; without any trusted
positive or any text nothing can be learned and nothing is rejected: each score is THRESHOLD; labels with a null doc_id
or quality are not used; a doc_id labelled twice counts once if any row calls it good; rows that repeat a doc_id are
scored each; a very long text is read by one task, as numbers a byte; an empty table gives an empty table; further
columns are not read (`good_documents` passes them through, whatever their names).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, scratch, written
from .spotsigs import ANCHORS
from .suffix_dedup import Names, _mix

THRESHOLD = 0.7
#: Random mixtures; ridge times the root of the number of positives; scale of hashed features; the g that scores THRESHOLD.
HIDDEN, RIDGE, HASHED, CUT = 64, 0.3, 0.1, 0.2
SHAPES, GRAMS = 64, 128
BINS, REACH = 4000, 2.0

_COMMON = frozenset(ANCHORS)


def _set_of(chars: str) -> np.ndarray:
    found = np.zeros(256)
    found[list(chars.encode())] = 1
    return found


#: Rows: upper case, lower case, digits, marks of sentences, exclamation and question, bars, other symbols, line ends, beyond ASCII.
_KINDS = np.stack(
    [_set_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set_of("abcdefghijklmnopqrstuvwxyz"), _set_of("0123456789"), _set_of(".,;:'\"()-"), _set_of("!?"), _set_of("|"), _set_of("#$%&*+<=>@[\\]^_`{}~/"), _set_of("\n"), np.arange(256) >= 128]
)
COUNTS = len(_KINDS) + 11
FEATURES = COUNTS + SHAPES + GRAMS
WIDTH = 1 + FEATURES + HIDDEN

_rng = np.random.default_rng(20240701)
_KIND = np.where(_KINDS.any(0), _KINDS.argmax(0) + 1, 0)
_SHAPE = _rng.integers(0, SHAPES, 1000)
_PAIR = _rng.integers(0, 2**64, 2, dtype=np.uint64) | np.uint64(1)
_TURN, _SHIFT = _rng.normal(0, 1 / np.sqrt(COUNTS), (COUNTS, HIDDEN)), _rng.normal(0, 0.5, HIDDEN)
_IS_WHITE = _set_of(WHITE) > 0


def hashed(data: np.ndarray) -> np.ndarray:
    """Shares of hashed runs of three byte kinds, and signed counts of hashed words and word pairs."""
    out = np.zeros(SHAPES + GRAMS)
    kinds = _KIND[data]
    if len(kinds) > 2:
        runs = _SHAPE[kinds[:-2] * 100 + kinds[1:-1] * 10 + kinds[2:]]
        out[:SHAPES] = np.bincount(runs, minlength=SHAPES) / len(runs)
    white = np.concatenate(([True], _IS_WHITE[data], [True]))
    edges = np.flatnonzero(white[1:] != white[:-1])
    if len(edges):
        words = Names(data).of(edges[::2], edges[1::2])
        grams = np.concatenate((words, _mix(words[:-1] * _PAIR[0] + words[1:] * _PAIR[1])))
        sign = np.where(grams >> np.uint64(63), 1.0, -1.0)
        out[SHAPES:] = np.bincount((grams >> np.uint64(40)).astype(np.int64) % GRAMS, sign, GRAMS) / np.sqrt(len(grams))
    return out


def features(text: str) -> list[float]:
    data = np.frombuffer(text.encode(), np.uint8)
    n_bytes = max(1, len(data))
    shares = _KINDS @ np.bincount(data, minlength=256) / n_bytes
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = text.split("\n")
    return [
        *shares,
        np.log1p(len(words)),
        np.log1p(len(data)),
        len(text) / n,
        len(counts) / n,
        sum(map(eq, words, words[1:])) / n,
        max(counts.values(), default=0) / n,
        sum(counts.get(w, 0) for w in _COMMON) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
        1 - len(set(lines)) / len(lines),
        len(words) / len(lines) / 100,
        *hashed(data),
    ]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = np.array([features(t or "") for t in b.column("text").to_pylist()], np.float32).ravel()
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(made) + 1, FEATURES), pa.int32()), pa.array(made))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), rows], ["doc_id", "features"])


def feature_table(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_feature_rows, f"doc_id {kind}, features array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(float).reshape(-1, FEATURES)


@dataclass
class Basis:
    """phi: features standardised, hashed ones made small, and random mixtures of the counts."""

    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        counts = z[:, :COUNTS]
        return np.concatenate([np.ones((len(z), 1)), counts / 4, z[:, COUNTS:] * HASHED, np.tanh(counts @ _TURN + _SHIFT)], axis=1)


@dataclass
class Model:
    basis: Basis
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Rises with g; THRESHOLD at g = CUT."""
        z = 4 * (self.basis(x) @ self.weights - CUT) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def excess(weights: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The second part of the risk before it is cut at 0, from the moment matrices (row 0: means)."""
    one_sided = lambda m: (1 + 2 * weights @ m[0] + weights @ m @ weights) / 4
    return float(one_sided(unlabelled) - prior * one_sided(positive))


def least_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float) -> np.ndarray:
    """Weights of least non-negative risk, from the moment matrices E[phi phi'] of positives and unlabelled rows."""
    eye = ridge * np.eye(len(positive))

    def at(share: float) -> np.ndarray:
        """The least of the first part and `share` times the second."""
        both = prior * positive * (1 - share) + share * unlabelled
        return np.linalg.solve(both / 2 + eye, (prior * positive[0] * (1 + share) - share * unlabelled[0]) / 2)

    low, high = 0.0, 1.0
    if excess(at(1.0), positive, unlabelled, prior) >= 0:
        return at(1.0)
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(at(middle), positive, unlabelled, prior) >= 0 else (low, middle)
    return at(low)


def told_apart(positive: np.ndarray, unlabelled: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of least squared loss of positives (1) against unlabelled rows (-1), both kinds weighing the same."""
    return np.linalg.solve((positive + unlabelled) / 2 + ridge * np.eye(len(positive)), (positive[0] - unlabelled[0]) / 2)


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The smallest ratio of the unlabelled to the positive share above a score, over scores with half of the positives
    or more; positive, unlabelled: counts by ascending bin of score."""
    above = [np.cumsum(n[::-1])[::-1] / n.sum() for n in (positive, unlabelled)]
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(positive.sum()) + 1 / np.sqrt(unlabelled.sum()))
    of_p, of_u = (a[above[0] >= 0.5] for a in above)
    best = np.argmin((of_u + slack) / of_p)
    return float(np.clip(of_u[best] / of_p[best], 0.05, 0.98))


def _summed(rows: DataFrame, keys: list[str], n: int) -> dict[tuple, np.ndarray]:
    """The sums of the lists (n numbers each) of rows (keys, task, list) by key, added in the order of tasks."""

    def add(key, table):
        order = np.argsort(table["task"].to_numpy(), kind="stable")
        total = np.zeros(n)
        for x in table["list"].combine_chunks().flatten().to_numpy().reshape(-1, n)[order]:
            total += x
        return pa.table({**{k: pa.array([v.as_py()], pa.int32()) for k, v in zip(keys, key)}, "list": [total.tolist()]})

    schema = ", ".join(f"{k} int" for k in keys) + ", list array<double>"
    return {tuple(r[k] for k in keys): np.array(r["list"]) for r in rows.groupBy(*keys).applyInArrow(add, schema).collect()}


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1]), pa.int32()), pa.array(matrix.ravel()))


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def basis_of(table: DataFrame) -> Basis | None:
    """The means and deviations of the features over all rows; None if there is no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, FEATURES))
        for b in batches:
            x = _matrix(b.column("features"))
            sums += np.stack([np.full(FEATURES, len(x)), x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1, 2], pa.int32()), pa.array([_task()] * 3, pa.int64()), _lists(sums)], ["part", "task", "list"])

    found = _summed(table.mapInArrow(run, "part int, task long, list array<double>"), ["part"], FEATURES)
    if not found or not found[0,][0]:
        return None
    n, one, two = (found[k,] for k in range(3))
    return Basis(one / n, np.sqrt(np.maximum(two / n - (one / n) ** 2, 0)) + 1e-3)


def _moments(table: DataFrame, basis: Basis) -> np.ndarray:
    """Sums of phi phi' of (positives, all rows) by half: an array [2, 2, WIDTH, WIDTH]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2, WIDTH, WIDTH))
        for b in batches:
            trusted, half = (b.column(c).to_numpy(zero_copy_only=False) for c in ("trusted", "half"))
            phi = basis(_matrix(b.column("features")))
            for h in (0, 1):
                own = half == h
                sums[0, h] += phi[own & trusted].T @ phi[own & trusted]
                sums[1, h] += phi[own].T @ phi[own]
        part, row = np.divmod(np.arange(4 * WIDTH, dtype=np.int32), WIDTH)
        columns = [pa.array(part), pa.array(row), pa.array(np.full(len(row), _task())), _lists(sums.reshape(-1, WIDTH))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "row", "task", "list"])

    found = _summed(table.mapInArrow(run, "part int, row int, task long, list array<double>"), ["part", "row"], WIDTH)
    out = np.zeros((4, WIDTH, WIDTH))
    for (part, row), x in found.items():
        out[part, row] = x
    return out.reshape(2, 2, WIDTH, WIDTH)


def _score_counts(table: DataFrame, basis: Basis, weights: list[np.ndarray]) -> np.ndarray:
    """Counts of (positives, all rows) by bin of g, each half scored by its own weights: an array [2, BINS]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BINS))
        for b in batches:
            trusted, half = (b.column(c).to_numpy(zero_copy_only=False) for c in ("trusted", "half"))
            phi = basis(_matrix(b.column("features")))
            g = np.where(half == 0, phi @ weights[0], phi @ weights[1])
            bins = np.clip((g + REACH) / (2 * REACH) * BINS, 0, BINS - 1).astype(np.int64)
            sums += np.stack([np.bincount(bins[trusted], minlength=BINS), np.bincount(bins, minlength=BINS)])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([_task()] * 2, pa.int64()), _lists(sums)], ["part", "task", "list"])

    found = _summed(table.mapInArrow(run, "part int, task long, list array<double>"), ["part"], BINS)
    return np.stack([found[0,], found[1,]])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(table: DataFrame) -> Model | None:
    """The model of a table (features, trusted, half); None without positives."""
    basis = basis_of(table)
    if basis is None:
        return None
    sums = _moments(table, basis)
    n_positive, n_all = sums[:, :, 0, 0].sum(1)
    if not n_positive:
        return None
    ridge = RIDGE / np.sqrt(n_positive)
    mean = lambda m: m / max(1.0, m[0, 0])
    prior = 0.5
    if sums[:, :, 0, 0].min() >= 2:
        weights = [told_apart(mean(sums[0, 1 - h]), mean(sums[1, 1 - h]), ridge) for h in (0, 1)]
        prior = prior_of(*_score_counts(table, basis, weights))
    return Model(basis, least_risk(mean(sums[0].sum(0)), mean(sums[1].sum(0)), prior, ridge), prior)


def marked_table(docs: DataFrame, labels: DataFrame, keep: bool) -> DataFrame:
    """doc_id, features, trusted, half of each row of docs, written; labels of held-out rows are not read.

    Labels may be as many as documents, so neither side is broadcast: features (about 200 numbers a row) meet them once."""
    trusted = labels.where(~held_out(F.col("doc_id")) & (F.col("quality") == 1)).select("doc_id", F.lit(True).alias("trusted")).distinct()
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half")
    both = feature_table(docs).join(trusted.hint("merge"), "doc_id", "left")
    return written(both.select("doc_id", "features", F.coalesce("trusted", F.lit(False)).alias("trusted"), half), "features", keep)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    with scratch(docs.sparkSession):
        table = marked_table(docs, labels, keep=True)
        model = fit(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("features"))
            score = model.score(x) if model else np.full(len(x), THRESHOLD)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = table.select("doc_id", "features").mapInArrow(run, f"doc_id {kind}, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that `scored` predicts as good, unchanged."""
    with scratch(docs.sparkSession):
        model = fit(marked_table(docs, labels, keep=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t or "") for t in b.column("text").to_pylist()], np.float32).astype(float).reshape(-1, FEATURES)
            yield b.filter(pa.array(model.score(x) >= THRESHOLD)) if model else b

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
