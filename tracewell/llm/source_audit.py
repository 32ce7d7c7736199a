"""Source divergence audit: how far each source of a language is from its other sources, and from the language as a whole.

Terms are counted by (lang, source) in one pass over the texts; a task adds up before anything moves. Kept terms (LEAST
documents of their language at least) are dealt to blocks of about BLOCK terms by hash and numbered inside the block, so
a group's vector is a row of at most some ten thousand numbers for each block, however large the vocabulary and however
many rows a source has.

Pairs are evaluated by systolic rotation. Each (lang, block, group) vector has a home partition, where it stays. The
groups of a language play a round-robin tournament by the circle method: in each round every group meets one other, and
of the two one stays at home while the other's compressed vector travels there. A meeting evaluates both directions, so
each pair meets once in each block. ROUNDS rounds are a job; what leaves is a partial sum for each direction, and those
are added up over blocks. A vector that travels moves once a round at most, and a task holds its own vectors and those of
ROUNDS peers. Terms are ranked where the vectors are: a heap of TERMS in each block, then the heaps of a group together.

All arithmetic is of whole numbers. Shares are found by long division, so they hold for up to 9e15 occurrences; a pair's
sum is below 1e9 * (2e9 + 2 V), thus a long's for up to 3e9 kept terms of a language.

Defined results: null text, lang and source are empty strings; a row is a document (rows that repeat a doc_id are
documents of their own); a language of one group has no pairs; one without kept terms has pairs of value 0; a text of
any length is counted in its row; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import heapq
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .common import scratch, written

LEAST, TERMS, UNIT = 3, 200, 1_000_000_000
BLOCK, ROUNDS = 32_768, 8
HELD = 250_000  # counts that a task holds before it sends them on

#: Bytes that are no part of a term to a blank, A-Z to a-z: a code point above 127 has bytes above 127 only.
_PLAIN = bytes(b + 32 if chr(b) in string.ascii_uppercase else b if chr(b) in string.ascii_lowercase or b > 127 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (lang, source, term, n, docs), partial; a group's row of an empty term says that it is there."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    told: set[tuple] = set()

    def out() -> pa.RecordBatch:
        rows = [(*group, t, n, of[1][t]) for group, of in held.items() for t, n in of[0].items()]
        rows += [(*group, b"", 0, 0) for group in held if group not in told]
        told.update(held)
        held.clear()
        types = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], ["lang", "source", "term", "n", "docs"])

    size = 0
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), texts):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            terms = text.as_py().translate(_PLAIN).split()
            n.update(terms)
            docs.update(set(terms))
            size += len(n)
            if size > HELD:
                yield out()
                size = 0
    yield out()


def share(counts: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / whole), for counts below whole: three digits of base 1000."""
    if whole >= 9 * 10**15:
        return np.array([1 + UNIT * (int(c) + 1) // whole for c in counts], np.int64)
    digits, rest = divmod(counts.astype(np.int64) + 1, whole)
    for _ in range(3):
        digit, rest = divmod(rest * 1000, whole)
        digits = digits * 1000 + digit
    return digits + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) ** 2 // q


def _squeezed(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<i8").tobytes(), 1)


def _opened(data: bytes | None) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i8") if data else np.zeros(0, np.int64)


CELL = "lang string, source string, block int, numbers binary, counts binary, totals binary, terms binary"


def _cell(key: tuple, rows: pa.Table) -> pa.Table:
    """A group's vector in a block: numbers as steps, counts of the group and of the language, terms parted by blanks."""
    rows = rows.sort_by("number")
    column = lambda c: rows.column(c).to_numpy()
    made = [_squeezed(np.diff(column("number"), prepend=0)), _squeezed(column("n")), _squeezed(column("total")), zlib.compress(b" ".join(rows.column("term").cast(pa.binary()).to_pylist()), 1)]
    types = (pa.string(), pa.string(), pa.int32(), *[pa.binary()] * 4)
    values = [*(k.as_py() for k in key), *made]
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [c.split()[0] for c in CELL.split(", ")])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells to (lang, source, term, value): the TERMS first of the block."""
    for b in batches:
        rows = []
        for c in b.to_pylist():
            if not c["counts"]:
                continue
            whole = c["n_terms"]
            p, q = share(_opened(c["counts"]), c["occurrences"] + whole), share(_opened(c["totals"]), c["all_occurrences"] + whole)
            value = divergence(p, q)
            terms = zlib.decompress(c["terms"]).split(b" ")
            first = heapq.nsmallest(TERMS, ((-int(value[i]), terms[i]) for i in np.flatnonzero(p > q)))
            rows += [(c["lang"], c["source"], t, -v) for v, t in first]
        types = (pa.string(), pa.string(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, types)], ["lang", "source", "term", "value"])


def _vector(c: dict) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers, shares, and the share of a term that the group doesn't have."""
    whole = max(1, c["occurrences"] + c["n_terms"])
    return np.cumsum(_opened(c["numbers"])), share(_opened(c["counts"]), whole), int(share(np.zeros(1, np.int64), whole)[0])


def both_ways(one: tuple, other: tuple, size: int) -> tuple[int, int]:
    """The divergence of one from the other and of the other from one, over a block of `size` terms."""
    at = np.union1d(one[0], other[0])
    p, q = np.full(len(at), one[2]), np.full(len(at), other[2])
    p[np.searchsorted(at, one[0])] = one[1]
    q[np.searchsorted(at, other[0])] = other[1]
    rest = size - len(at)
    ways = ((p, q, one[2], other[2]), (q, p, other[2], one[2]))
    return tuple(int(divergence(a, b).sum()) + rest * ((x - y) ** 2 // y) for a, b, x, y in ways)


def _meet(home: pa.Table, guests: pa.Table) -> pa.Table:
    """(lang, slot, other, value) of a resident vector's meetings with those that came, two rows each."""
    rows = []
    for c in home.to_pylist():
        own = _vector(c)
        for guest in guests.to_pylist():
            there, back = both_ways(own, _vector(guest), c["size"])
            rows += [(c["lang"], c["slot"], guest["slot"], there), (c["lang"], guest["slot"], c["slot"], back)]
    types = (pa.string(), pa.int32(), pa.int32(), pa.int64())
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, types)], ["lang", "slot", "other", "value"])


def partner(slot: Column, slots: Column, round_: Column) -> Column:
    """Whom a slot meets in a round (null: nobody): the circle method, the last slot of an even number stands still."""
    turn = slots + slots % 2 - 1
    across = F.pmod(round_ - slot, turn)
    met = F.when(slot == turn, (round_ * ((turn + 1) / 2).cast("long") % turn).cast("int")).when(across == slot, turn).otherwise(across)
    return F.when((round_ < turn) & (met < slots), met.cast("int"))


def vocabulary(counts: DataFrame, least: int) -> DataFrame:
    """lang, term, total, n_terms, all_occurrences, blocks, block, number, size of the kept terms."""
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = written(kept.drop("docs"), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total").alias("all_occurrences"))
    langs = langs.withColumn("blocks", F.ceil(F.col("n_terms") / BLOCK).cast("int"))
    dealt = kept.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    dealt = dealt.repartition("lang", "block")  # else the window below takes a language's terms as the join dealt them
    of_block = Window.partitionBy("lang", "block")
    return dealt.withColumns({"number": F.row_number().over(of_block.orderBy("term")).cast("long") - 1, "size": F.count(F.lit(1)).over(of_block)})


def audit(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, part, item, value, rank: pairs of sources by divergence, and the terms that set a source apart."""
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    with scratch(spark):
        found = docs.select(*map(text, ("lang", "source", "text"))).mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
        counts = written(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
        terms = written(vocabulary(counts.where(F.length("term") > 0), least), "vocabulary")
        matched = written(counts.drop("docs").join(terms.select("lang", "term", "total", "block", "number"), ["lang", "term"]), "matched")

        facts = terms.groupBy("lang").agg(*(F.first(c).alias(c) for c in ("n_terms", "all_occurrences", "blocks")))
        sizes = matched.groupBy("lang", "source").agg(F.sum("n").alias("occurrences"))
        of_lang = Window.partitionBy("lang")
        groups = counts.where(F.length("term") == 0).select("lang", "source").join(sizes, ["lang", "source"], "left").join(facts, "lang", "left")
        groups = groups.withColumns({"slot": F.row_number().over(of_lang.orderBy("source")) - 1, "slots": F.count(F.lit(1)).over(of_lang).cast("int")})
        groups = written(groups.fillna({"occurrences": 0, "n_terms": 0, "all_occurrences": 0, "blocks": 1}), "groups")

        vectors = matched.groupBy("lang", "source", "block").applyInArrow(_cell, CELL)
        in_block = terms.groupBy("lang", "block").agg(F.first("size").alias("size"))
        cells = groups.drop("blocks").join(groups.select("lang", "source", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), ["lang", "source"])
        cells = written(cells.join(in_block, ["lang", "block"], "left").fillna({"size": 0}).join(vectors, ["lang", "source", "block"], "left"), "cells")

        ranked = written(cells.where("counts is not null").mapInArrow(_ranked, "lang string, source string, term binary, value long"), "ranked")
        compressed = cells.select("lang", "block", "slot", "slots", "n_terms", "occurrences", "size", "numbers", "counts")
        homes = compressed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "block", "slot").persist(StorageLevel.MEMORY_AND_DISK)
        homes.count()  # the cached partitions are there before a round is planned, which then deals them no more
        most, met = groups.agg(F.max("slots")).first()[0] or 0, []
        for first in range(0, most + most % 2 - 1, ROUNDS):
            guests = compressed.withColumn("round", F.explode(F.sequence(F.lit(first), F.lit(first + ROUNDS - 1))))
            guests = guests.withColumn("home", partner(F.col("slot"), F.col("slots"), F.col("round"))).where("home is not null")
            guests = guests.where((F.col("slot") > F.col("home")) != ((F.col("slot") + F.col("home")) % 2 == 1)).drop("round", "slots")
            made = homes.groupBy("lang", "block", "slot").cogroup(guests.groupBy("lang", "block", "home")).applyInArrow(_meet, "lang string, slot int, other int, value long")
            met.append(written(made, "met"))
        homes.unpersist()

        if met:
            pairs = met[0]
            for m in met[1:]:
                pairs = pairs.union(m)
            pairs = pairs.groupBy("lang", "slot", "other").agg(F.sum("value").alias("value"))
            pairs = pairs.join(groups.select("lang", "slot", "source"), ["lang", "slot"])
            pairs = pairs.join(groups.select("lang", F.col("slot").alias("other"), F.col("source").alias("item")), ["lang", "other"])
            pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        else:
            pairs = spark.createDataFrame([], "lang string, source string, part string, item string, value long")
        order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
        pairs = pairs.withColumn("rank", F.row_number().over(order))
        first_terms = ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
        first_terms = first_terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TERMS)
        return written(pairs.union(first_terms), "audit", keep=True)


def op11_source_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


ORACLE = r"""
with doc as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
word as (select lang, source, id, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from doc),
cnt as (select lang, source, term, count(*) as c from word group by all),
kept as (select lang, term, count(*) as c from word group by lang, term having count(distinct id) >= 3),
grp as (select distinct lang, source from doc),
voc as (select lang, count(*) as v, sum(c) as n from kept group by lang),
dense as (
  select g.lang, g.source, k.term, coalesce(cnt.c, 0) as c, k.c as all_c from grp g join kept k using (lang) left join cnt using (lang, source, term)),
tot as (select lang, source, sum(c) as n from dense group by lang, source),
share as (
  select d.lang, d.source, d.term, d.c, (1 + (1000000000::hugeint * (d.c + 1)) // (tot.n + voc.v))::hugeint as p,
         (1 + (1000000000::hugeint * (d.all_c + 1)) // (voc.n + voc.v))::hugeint as q
  from dense d join tot using (lang, source) join voc using (lang)),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
  left join (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
             from share a join share b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) s
    on s.lang = a.lang and s.source = a.source and s.item = b.source),
term as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // q)::bigint as value from share where c > 0 and p > q)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from (select * from pair union all select * from term)
qualify part = 'pair' or rank <= 200
"""
