"""Mixing sources to target weights.

Each row gets a hash-random key from its doc_id. Within a source rows are sorted by that key: the key's leading digits
name a range, sizes are summed by (source, range), those sums are summed along each source's ranges, and rows add their
running sum inside a range. A source's budget is cut exactly: whole epochs first, then the rows whose prefix sum lies
below the rest, the last of them in part. Built-in functions only.

With N rows there are about sqrt(N) ranges a source, so neither a range of a hot source nor the list of a source's
ranges grows faster than sqrt(N) rows. Sources are ranked by ranges as well; the share level is found by a few
aggregations that return two numbers each.

Defined results: size is the number of words (0 for null or empty text); a null source is a source of its own, ordered
last; rows of no words take nothing; if all sizes are 0 all targets are 0; rows that repeat a doc_id are rows of their
own (among equal rows the order is immaterial); a text of any length is counted and cut in its row; an empty table gives
an empty table; further columns pass through, whatever their names (one that has the name of a column added is replaced
by it).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_WORD, WORD, global_rank, guarded, written

WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, __source_size -> also __target: water filled by weight up to `most` times the size of each source."""
    ranked = written(global_rank(sources, ["source"], "sources"), "ranked")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("__weight", weight).withColumn("__most", F.col("__source_size") * F.lit(float(most)))
    total = ranked.agg(F.sum("__source_size")).first()[0] or 0
    level, full = 0.0, F.lit(False)
    while total:  # sources above the level are full; each round adds some until none is added
        row = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("__most"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("__weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if row.weight == 0:
            break
        new = (share * total - row.held) / row.weight
        if new <= level:
            break
        level, full = new, F.col("__weight") * F.lit(new) > F.col("__most")
    return ranked.withColumn("__target", F.least("__most", F.col("__weight") * F.lit(level))).select("source", "__source_size", "__target")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs with __size, __source_size, __target and __taken (words of this row in the mix, repeats counted)."""
    docs, back = guarded(docs.drop("__size", "__source_size", "__target", "__taken"))
    rows = docs.withColumns(
        {
            "__size": n_words(F.col("text")),
            "__key": F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
            "__none": F.col("source").isNull(),
            "__name": F.coalesce("source", F.lit("")),
        }
    )
    ranges = max(1, math.isqrt(docs.count()))
    in_range = F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32)).cast("int")
    rows = rows.withColumn("__range", in_range)
    sums = written(rows.groupBy("__none", "__name", "__range").agg(F.sum("__size").alias("__sum")), "range-sums")
    sources = sums.groupBy("__none", "__name").agg(F.sum("__sum").alias("__source_size"))
    sources = sources.select(F.when(~F.col("__none"), F.col("__name")).alias("source"), "__source_size")
    targets = source_targets(sources, weights, share, most).select(
        F.col("source").isNull().alias("__none"), F.coalesce("source", F.lit("")).alias("__name"), "__source_size", "__target"
    )
    before = Window.partitionBy("__none", "__name").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    starts = starts.join(targets, ["__none", "__name"])
    inside = Window.partitionBy("__none", "__name", "__range").orderBy("__key", "doc_id", "__size")
    ahead = F.coalesce(F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(starts, ["__none", "__name", "__range"]).withColumn("__ahead", F.col("__start") + ahead)
    budget = F.floor("__target").cast("long")
    epochs = F.when(F.col("__source_size") > 0, F.floor(budget / F.col("__source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("__source_size")
    part = F.greatest(F.lit(0), F.least(F.col("__size"), rest - F.col("__ahead")))
    kept = [F.col(c) for c in docs.columns]
    taken = (epochs * F.col("__size") + part).cast("long").alias("__taken")
    return rows.select(*kept, "__size", "__source_size", "__target", taken).withColumnsRenamed(back)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows repeated for whole epochs, and cut after the words that a partial epoch takes."""
    docs, back = guarded(docs)
    rows = mix(docs, **how)
    whole = F.when(F.col("__size") > 0, F.floor(F.col("__taken") / F.col("__size"))).otherwise(F.lit(0)).cast("int")
    part = (F.col("__taken") - whole * F.col("__size")).cast("int")
    words = F.regexp_extract_all("text", F.lit(f"({WORD}{NOT_WORD[:-1]}*)"), F.lit(1))  # each with the white space after it
    head = F.array_join(F.slice(words, 1, part), "")
    copies = F.concat(F.array_repeat(F.col("text"), whole), F.when(part > 0, F.array(head)).otherwise(F.array().cast("array<string>")))
    return rows.withColumn("__copy", F.explode(copies)).select(
        *[F.col("__copy").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    ).withColumnsRenamed(back)


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__taken").alias("taken"),
    )


ORACLE = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         md5('mix' || coalesce(doc_id::varchar, '')) as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight,
             2.0::double * source_size as most from s),
o as (select *, 1.5::double * sum(source_size) over () as budget,
             coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0) as held,
             sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) as left_weight from w),
l as (select max((budget - held) / left_weight) as level from o where most / weight >= (budget - held) / left_weight),
t as (select source, source_size, least(most, weight * coalesce((select level from l), 0.0)) as target from o),
r as (select d.*, t.source_size, t.target,
             coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as ahead
      from d join t on d.source is not distinct from t.source),
e as (select *, floor(target)::bigint as budget,
             case when source_size > 0 then floor(floor(target) / source_size)::bigint else 0 end as epochs from r)
select doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)))::bigint as taken from e
"""
