"""Line dedup: lines whose key stands in many documents are dropped from all of them.

Lines are exploded, normalised and hashed (two 64-bit hashes); distinct documents are counted for each hash; the
documents then drop the hashes over the threshold and are put together again in line order. All of it is built-in
functions. Only hashes travel for the count; a text travels once, to meet its document's list of dropped hashes, where its
lines are looked up by binary search.
A line that a third of all documents share is one row for each document, dealt by hash and document before it is
counted, and its join is left to adaptive skew splitting.

Defined results: a null text is one empty line; an empty key (white space only) is never dropped unless
min_chars is 0; rows that repeat a doc_id are one document when documents are counted, and each such row is still
returned; a null doc_id counts as one document; a text of any length is split in its row; an empty table gives an empty
table. Further columns pass through, whatever their names (n_lines and n_dropped are replaced by those counted).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, guarded, let, spread


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case (and no other letter changed)."""
    bare = F.btrim(line, F.lit(WHITE))
    plain = F.octet_length(bare) == F.char_length(bare)  # ASCII: lower() is the same and much faster
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _hashed(line: Column, min_chars: int) -> Column:
    key = line_key(line)
    return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b")))


def _steps(size: Column) -> Column:
    """The powers of two up to size, the largest first."""
    return F.transform(F.sequence(F.floor(F.log2(size)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))


def _among(dropped: Column, h: Column) -> Column:
    """Whether a hash is in a sorted list, by binary search: a step for each digit of the list's size."""
    last = F.aggregate(dropped.steps, F.lit(-1), lambda at, step: F.when(F.get(dropped.sorted, at + step) <= h, at + step).otherwise(at))
    return F.coalesce((last >= 0) & (F.get(dropped.sorted, last) == h), F.lit(False))


def dropped_lines(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(doc_id, __dropped): for each document with any, the hashes of its lines to drop."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    of_doc = docs.select("doc_id", F.explode(F.transform(lines, lambda x: _hashed(x, min_chars))).alias("h"))  # array_distinct of structs takes every pair
    pairs = of_doc.where("h is not null").select("doc_id", "h.a", "h.b").distinct()
    common = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("a", "b")
    return pairs.join(spread(common, "a", "b"), ["a", "b"]).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("__dropped"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with text replaced by the lines that stay, and n_lines, n_dropped of each document."""
    docs, back = guarded(docs)
    found = dropped_lines(docs.select("doc_id", "text"), min_docs, min_chars).withColumnRenamed("doc_id", "__id")
    both = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    out = F.col("__dropped")
    stay = let(F.struct(F.array_sort(out).alias("sorted"), _steps(F.size(out)).alias("steps")), lambda s: F.filter(lines, lambda x: ~let(_hashed(x, min_chars), lambda h: _among(s, h))))
    both = both.withColumn("__lines", F.size(lines).cast("long")).withColumn("__stay", F.when(out.isNotNull(), stay))
    kept = F.when(out.isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join("__stay", "\n"))
    return both.select(
        *[kept.alias("text") if c == "text" else F.col(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")],
        F.col("__lines").alias("n_lines"),
        F.when(out.isNull(), F.lit(0)).otherwise(F.col("__lines") - F.size("__stay")).cast("long").alias("n_dropped"),
    ).withColumnsRenamed(back)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
common as (select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10),
flagged as (select keyed.*, common.k is not null as gone from keyed left join common using (k))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from flagged group by doc_id
"""
