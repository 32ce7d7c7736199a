"""SpotSigs fingerprints: chains of content words that follow common words.

A spot is a common word (an anchor) with the next CHAIN content words after it, other anchors skipped; a fingerprint is
the set of its spots' 64-bit hashes. The start of a text is an anchor too, and where RUN content words stand without a
common word each further one is, so that lists and tables have spots as prose has. A text without a spot has one
signature, the hash of all its words (none if it has no word). Likeness is the Jaccard value of two sets, and is 0 without comparing them where their sizes alone put it below
the threshold asked for. Built-in functions only: a text is split once, bound to a lambda variable, and its spots are
made with array functions inside the row.

`likely_pairs` joins a table with itself: set lengths are partitioned so that two sets similar enough lie in the same or
in adjacent partitions; within these only the rarest signatures of a set are looked up (a set must share one of them
with any set similar enough), and the pairs found are compared once. Equal sets are folded to one representative first.

Defined results: null text counts as empty; two empty fingerprints are alike (1.0) and an empty and a non-empty one are
not (0.0); the successor of a document is the next row by doc_id, the last one's is the first (a single row follows
itself); rows that repeat a doc_id follow one another by the hash of their text; a text of any length is one row's
arrays; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

#: Common words of English, French, German and Spanish that open a spot and are skipped in chains.
ANCHORS = [
    "the", "a", "an", "of", "and", "to", "in", "is", "it", "that", "for", "on", "with", "as", "at", "by", "be", "was", "are", "this", "from", "or",
    "le", "la", "les", "de", "du", "des", "et", "en", "un", "une", "que", "qui", "dans", "pour", "sur", "au", "est", "par", "pas",
    "der", "die", "das", "den", "und", "ist", "von", "zu", "mit", "für", "auf", "ein", "eine", "nicht", "im", "dem",
    "el", "los", "las", "y", "con", "se", "del", "lo", "para", "es", "no", "su", "al",
]
CHAIN = 2
RUN = 8


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, digits and marks."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


def signatures(text: Column) -> Column:
    """The sorted set of spot hashes of a text."""

    def spots(words: Column, places: Column) -> Column:
        """words; places: 1-based positions of its content words."""

        def of_chain(j: Column) -> Column:
            start = F.when(j > 1, F.element_at(places, F.greatest(j - 1, F.lit(1)))).otherwise(F.lit(0))
            first = F.element_at(places, j)
            chain = [F.element_at(words, F.element_at(places, j + k)) for k in range(CHAIN)]
            common = F.transform(F.slice(words, start + 1, first - start - 1), lambda a: F.xxhash64(a, *chain))
            bare = F.when(j > RUN, F.element_at(places, F.greatest(j - 1, F.lit(1))) - F.element_at(places, F.greatest(j - RUN, F.lit(1))) == RUN - 1)
            more = F.when(j == 1, F.array(F.xxhash64(F.lit("^"), *chain))).when(bare, F.array(F.xxhash64(F.element_at(words, F.greatest(start, F.lit(1))), *chain)))
            return F.when(more.isNull(), common).otherwise(F.concat(common, more))

        found = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(places) - CHAIN + 1, F.lit(1))), of_chain)))
        some = F.when(F.size(places) >= CHAIN, found).otherwise(F.array().cast("array<bigint>"))
        whole = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
        return let(some, lambda s: F.when(F.size(s) > 0, s).otherwise(whole))

    def with_words(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(ANCHORS), F.lit(0)).otherwise(i + 1)), lambda p: p > 0)
        return let(places, lambda p: spots(words, p))

    return F.array_sort(let(words_of(F.coalesce(text, F.lit(""))), with_words))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s), 16, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard value of two sets; 0 if it must lie below `least` by their sizes."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    value = let(common, lambda c: c / (F.size(a) + F.size(b) - c).cast("double"))
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < large * F.lit(least)), F.lit(0.0)).otherwise(value)


def with_successor(docs: DataFrame) -> DataFrame:
    """doc_id, text and next: the text of the next row by doc_id (the first one's after the last).

    doc_ids are cut into about 4 sqrt(N) ranges (several for each task, so tasks are even): 64 by their quantiles, each
    of those evenly by value. Each range finds successors on its own, and its last row takes the first row of the next
    range. Those first rows are keys of 24 bytes (30 MB for 10^11 rows), sent to the scan that fetches their texts.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", [i / 64 for i in range(65)], 10_000).alias("q")).first()
    bounds = sorted(set(facts.q or [0]))
    fine = max(1, 4 * math.isqrt(facts.n) // max(1, len(bounds) - 1))
    edges = F.array(*[F.lit(int(b)) for b in bounds])
    coarse = F.greatest(F.size(F.filter(edges, lambda e: e <= F.col("doc_id"))), F.lit(1))
    low, high = F.element_at(edges, F.col("__c")), F.element_at(edges, F.least(F.col("__c") + 1, F.lit(len(bounds))))
    as_double = lambda c: c.cast("double")  # noqa: E731  differences of 64-bit numbers may not fit one
    inner = F.when(high > low, F.floor((as_double(F.col("doc_id")) - as_double(low)) / (as_double(high) - as_double(low)) * fine)).otherwise(F.lit(0))
    inner = F.least(F.greatest(F.coalesce(inner, F.lit(0)), F.lit(0)), F.lit(fine - 1)).cast("long")
    placed = rows.withColumn("__c", F.coalesce(coarse, F.lit(1))).withColumn("__r", F.col("__c") * F.lit(fine) + inner)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    inside = Window.partitionBy("__r").orderBy(*order)
    seen = placed.select("__r", "doc_id", "text", F.lead("text").over(inside).alias("next"))
    # each range's first row, by its key alone, and the range that comes before it
    heads = placed.groupBy("__r").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text").alias("hash"))).alias("h"))
    around = Window.orderBy("__r")  # a row for each range: 4 sqrt(N)
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("h").over(around), F.first("h").over(whole))
    firsts = heads.select("__r", after.alias("f")).select("__r", F.col("f.doc_id").alias("__id"), F.col("f.hash").alias("__hash"))
    found = rows.withColumn("__hash", F.xxhash64("text")).join(F.broadcast(firsts.withColumnRenamed("__hash", "__h")), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")))
    found = found.select("__r", F.col("text").alias("__first")).dropDuplicates(["__r"])
    return seen.join(found, "__r").select("doc_id", "text", F.coalesce("next", "__first").alias("next"))


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n/2) code points replaced by as many of the first of `following`."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.left(text, F.char_length(text) - half), F.left(following, half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row."""
    rows = with_successor(docs)
    changed = edited(F.col("text"), F.col("next"))
    made = rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(changed, 256).alias("edited_sha256"),
        signatures(F.col("text")).alias("__own"), signatures(changed).alias("__edited"), signatures(F.col("next")).alias("__next"),
    )
    return made.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("__own")).alias("fingerprint"), fingerprint(F.col("__edited")).alias("edited_fingerprint"),
        likeness(F.col("__own"), F.col("__edited")).alias("near_edited"), likeness(F.col("__own"), F.col("__next")).alias("near_next"),
    )


def likely_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(left_id, right_id, likeness): representatives of different fingerprints at least `least` alike, left_id < right_id.

    A document's representative is the smallest doc_id with the same fingerprint: see `fingerprints`.
    """
    sets = docs.select("doc_id", signatures(F.col("text")).alias("sigs")).where(F.size("sigs") > 0)
    sets = sets.groupBy("sigs").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("sigs"))
    sets = sets.withColumn("part", F.floor(F.log("n") / F.lit(-math.log(least))).cast("int"))
    counts = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = sets.select("doc_id", "n", "part", F.explode("sigs").alias("sig")).join(spread_counts(counts), "sig")
    rare = Window.partitionBy("doc_id").orderBy("df", "sig")
    prefix = ranked.withColumn("at", F.row_number().over(rare)).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    left = prefix.select("sig", F.col("doc_id").alias("left_id"), F.col("n").alias("left_n"), F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    right = prefix.select("sig", "part", F.col("doc_id").alias("right_id"), F.col("n").alias("right_n"))
    fits = (F.col("left_id") < F.col("right_id")) & (F.least("left_n", "right_n") >= F.greatest("left_n", "right_n") * least)
    found = left.join(right, ["sig", "part"]).where(fits).select("left_id", "right_id").distinct()
    a, b = sets.select(F.col("doc_id").alias("left_id"), F.col("sigs").alias("a")), sets.select(F.col("doc_id").alias("right_id"), F.col("sigs").alias("b"))
    compared = found.join(a, "left_id").join(b, "right_id").withColumn("likeness", likeness(F.col("a"), F.col("b"), least))
    return compared.where(F.col("likeness") >= least).select("left_id", "right_id", "likeness")


def spread_counts(counts: DataFrame) -> DataFrame:
    return counts.repartition(F.xxhash64("sig", "df"))


def op5_spotsigs(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
