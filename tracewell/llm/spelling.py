"""Spelling variant grouping: words at distance one by forward and backward minimal automata.

Words (runs of letters) are counted in one pass over the texts; a task adds up before anything moves. Two words are near
if one code point is inserted, deleted or replaced. Of two near words let w be the shorter (of equal lengths, each in
turn) and L its length. The place of the error is the length of their common prefix, so it is one place even where
letters repeat. If it is in the second half of w, both begin with the first half of w; if it is in the first half, both
end with the second. So a word is dealt by either half: as w, and as the longer word of a w one shorter.

Words of a key meet in one task. There a minimal acyclic automaton is built of the words dealt by their beginnings and
one of the words, reversed, dealt by their ends. Each w follows its exact half through the automaton and completes the
rest with one error. States count the words below them, which gives each accepted word its number, by which its count is
found (a minimal perfect hash). A pair whose place of error is not the key's own is left to the other direction, so no
pair is found twice and what leaves a task is a word's number of near words and the best of them, not its pairs.

A key that more than LIMIT words share is split: its window of places where the error may be is halved, and words are
dealt again by all that lies outside the narrower window. At a window of one place a key has at most as many words as
there are letters, plus their square (90 + 8,100 here), so all keys end under LIMIT, whatever the words.

Forms are chains, since a form occurs ten times as often as its word: 19 steps at most, so roots are found in five
rounds of pointer doubling.

Defined results: null texts have no words; a null doc_id is written as nothing before the colon; rows that repeat a
doc_id are counted each, with the same letters deleted; a text or a word of any length is handled in one task (a word
that has a near word, at some hundred bytes a letter); ties go to the word that is smaller by code points; an empty
table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, spread, written

SHORTEST, LEAST, TIMES, EVERY = 7, 2, 10, 31
LIMIT, DEALT = 16_384, 8_192  # words of a key at most; rows of a task's bucket, about
HELD = 400_000

_LOWER = bytes(b + 32 if chr(b) in string.ascii_uppercase else b for b in range(256))


def _counted(shortest: int):
    runs = re.compile(rf"[A-Za-zÀ-ÿ]{{{shortest},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial rows of (word, n)."""
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary())):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs((text.as_py() or b"").translate(_LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % EVERY == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    return run


def words_of(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, n: what counts as a word of these texts."""
    counted = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_counted(shortest), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Automaton:
    """A minimal acyclic automaton of sorted words. steps[state][letter] is the next state and how many words come before
    its own; number(...) adds those up."""

    def __init__(self, words: list[str]):
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.below: list[int] = []
        known: dict[tuple, int] = {}

        def settled(ends: bool, letters: dict[str, int]) -> int:
            key = (ends, *letters.items())
            state = known.get(key)
            if state is None:
                known[key] = state = len(self.steps)
                before, steps = int(ends), {}
                for letter, to in letters.items():
                    steps[letter] = (to, before)
                    before += self.below[to]
                self.steps.append(steps)
                self.final.append(ends)
                self.below.append(before)
            return state

        # the states of the last word that may still change: whether a word ends there, and the settled states after it
        open_: list[list] = [[False, {}]]
        last = ""
        for word in words:
            shared = _shared(last, word)
            for k in range(len(last), shared, -1):
                open_[k - 1][1][last[k - 1]] = settled(*open_.pop())
            open_ += [[False, {}] for _ in word[shared:]]
            open_[-1][0] = True
            last = word
        for k in range(len(last), 0, -1):
            open_[k - 1][1][last[k - 1]] = settled(*open_.pop())
        self.root = settled(*open_.pop())

    def number(self, state: int, before: int, rest: str) -> int | None:
        """The number of the word that goes on from a state with `rest`."""
        for letter in rest:
            step = self.steps[state].get(letter)
            if step is None:
                return None
            state, before = step[0], before + step[1]
        return before if self.final[state] else None

    def one_off(self, word: str, low: int, high: int) -> Iterator[tuple[int, int]]:
        """(number, place) of words that differ from `word` first at a place from low up to high, by one letter replaced
        or added there; high may be the word's length."""
        state, before = self.root, 0
        for at in range(high + 1):
            if at >= low:
                own = word[at] if at < len(word) else None
                for letter, (to, more) in self.steps[state].items():
                    if letter != own:
                        for rest in (word[at + 1 :], word[at:]) if own else ("",):
                            found = self.number(to, before + more, rest)
                            if found is not None:
                                yield found, at
            if at < len(word):
                step = self.steps[state].get(word[at])
                if step is None:
                    return
                state, before = step[0], before + step[1]


def _shared(a: str, b: str, at: int = 0) -> int:
    """The length of the common prefix."""
    end = min(len(a), len(b))
    while at < end and a[at] == b[at]:
        at += 1
    return at


def near_pairs(rows: list[tuple[str, int, int, int]]) -> Iterator[tuple[str, str]]:
    """(w, v) for rows (word, length of w, low, high): v as long as w or one longer, first different from low up to before
    high (or at the end, where high is w's length)."""
    ways: dict[bool, list] = {True: [], False: []}
    for row in rows:
        ways[row[2] == 0].append(row)
    forward = sorted({r[0] for r in ways[False]})
    automaton = Automaton(forward)
    for word, length, low, high in ways[False]:
        if len(word) == length:
            for number, _ in automaton.one_off(word, low, high if high == length else high - 1):
                yield word, forward[number]
    backward = sorted({r[0][::-1] for r in ways[True]})
    automaton = Automaton(backward)
    for word, length, _, high in ways[True]:
        if len(word) == length:
            for number, at in automaton.one_off(word[::-1], length - high, length):
                found = backward[number][::-1]
                if _shared(word, found, length - at - (len(found) == length)) < high:  # else the first half is the same: forward's
                    yield word, found


def _near(key: tuple, rows: pa.Table) -> pa.Table:
    """A bucket's rows (key, word, n, length, low, high) to (word, n_near, best: the most frequent near word)."""
    shared = Counter(rows.column("key").to_pylist())
    together = [r for r in rows.to_pylist() if shared[r["key"]] > 1]
    n = {r["word"]: r["n"] for r in together}
    counts: Counter[str] = Counter()
    best: dict[str, tuple[int, str]] = {}

    def met(word: str, near: str) -> None:
        counts[word] += 1
        rank = (-n[near], near)
        if word not in best or rank < best[word]:
            best[word] = rank

    for word, near in near_pairs([(r["word"], r["length"], r["low"], r["high"]) for r in together]):
        met(word, near)
        if len(near) > len(word):
            met(near, word)
    names, best_of = [*counts], [best[w] for w in counts]
    types = {"word": pa.string(), "n_near": pa.int64(), "minus_n": pa.int64(), "best": pa.string()}
    columns = (names, [counts[w] for w in names], [b[0] for b in best_of], [b[1] for b in best_of])
    return pa.table({c: pa.array(v, t) for (c, t), v in zip(types.items(), columns)})


def keyed(rows: DataFrame) -> DataFrame:
    """Adds key: all of the word outside its window."""
    size = F.char_length("word")
    left = F.expr("substring(word, 1, low)")
    right = F.when(F.col("high") == F.col("length"), "").otherwise(F.col("word").substr(size - F.col("length") + F.col("high") + 1, F.col("length")))
    return rows.withColumn("key", F.xxhash64("length", "low", "high", left, right))


def windows(words: DataFrame, shortest: int) -> DataFrame:
    """word, n and, for each w that it is or is one longer than, the two halves: length, low, high."""
    size = F.char_length("word")
    half = lambda length: (length / 2).cast("int")
    cut = lambda length: (F.struct(length.alias("length"), F.lit(0).alias("low"), half(length).alias("high")), F.struct(length.alias("length"), half(length).alias("low"), length.alias("high")))
    halves = F.array(*cut(size), *cut(size - 1))
    return words.select("word", "n", F.inline(halves)).where(F.col("length") >= shortest)


def variants(words: DataFrame, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root for words (word, n)."""
    with scratch(words.sparkSession):
        words = written(words, "words")
        found, rows = [], keyed(windows(words, shortest))
        while True:
            sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("__size"), F.max(F.col("high") - F.col("low")).alias("__wide"))
            wide = F.col("__wide") > 1  # a window of one place is not split
            hot = written(sizes.where((F.col("__size") > LIMIT) & wide).select("key"), "hot")
            many = hot.count()
            fixed = rows.join(spread(hot, "key"), "key", "left_anti") if many else rows
            buckets = max(1, (sizes.agg(F.sum("__size")).first()[0] or 0) // DEALT)
            dealt = fixed.withColumn("bucket", F.pmod("key", F.lit(buckets)))
            found.append(written(dealt.groupBy("bucket").applyInArrow(_near, "word string, n_near long, minus_n long, best string"), "near"))
            if not many:
                break
            middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
            parts = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))
            rows = rows.join(spread(hot, "key"), "key", "left_semi").select("word", "n", "length", F.inline(parts)).where(F.col("low") < F.col("high"))
            rows = written(keyed(rows), "split")

        near = found[0]
        for more in found[1:]:
            near = near.union(more)
        near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus_n", "best")).alias("best"))
        best_n = -F.col("best.minus_n")
        formed = best_n >= F.col("n") * times
        rows = words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.best")).alias("form"), F.when(formed, best_n).alias("form_n")
        )
        rows = written(rows, "forms")
        links = written(rows.where("form is not null").select("word", F.col("form").alias("root")), "links")
        while True:
            ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
            links = written(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "links")
            if not links.where("moved").count():
                break
            links = links.drop("moved")
        rows = rows.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
        return written(rows.select("word", "n", "n_near", "form", "form_n", "root"), "variants", keep=True)


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(words_of(docs))
