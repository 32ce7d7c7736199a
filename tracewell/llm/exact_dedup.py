"""Exact dedup by content-defined chunk recipes.

Each text, without its ASCII white space, is cut into chunks where a rolling hash of its last 32 bytes has its low bits
zero, so that equal stretches are cut alike wherever they stand. A document's recipe is the ordered list of its chunks'
identifiers. Chunks are deduplicated by identifier, and an identifier is verified when the smallest and the largest
chunk that carry it are the same bytes; if any is not, all are renamed under another salt. Documents are then equal
when their identifier lists are equal: about 16 bytes a kilobyte travel instead of the text, and chunk bytes move once,
each distinct one of a task at most once.

Groups are counted with map-side partial aggregation; the group's result is joined back to the recipes with the
group's side dealt anew, so that a group of a third of all rows is split by adaptive execution.

Defined results: null text counts as empty; all texts of no characters but white space are equal; of equal texts the
one with the most code points, then the smallest doc_id stays (a null doc_id sorts last); rows that repeat doc_id and
text are one document and all marked alike; a text of any length is one task's chunks; an empty table gives an empty
table; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, spread, written

LEAST, MOST, BITS = 512, 16384, 11
_WHITE = WHITE.encode()
#: A random 32-bit value for each byte: the rolling hash's table.
_GEAR = np.random.default_rng(20240601).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data: where the rolling hash of 32 bytes ends in BITS zeros, LEAST to MOST bytes apart."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # h covers 2k bytes after this
        h[k:] += h[:-k] << np.uint32(k)
    ends, last = [], 0
    for e in (np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1).tolist():
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST:
            ends.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunk_id(chunk: bytes, salt: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16, salt=salt.to_bytes(2, "big")).digest()


def _bare(texts: pa.Array) -> Iterator[bytes]:
    for t in texts.cast(pa.large_binary()):
        yield (t.as_py() or b"").translate(None, _WHITE)


def _recipes(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            recipes, digests = [], []
            for data in _bare(b.column("text")):
                ends = cuts(data)
                recipes.append(b"".join(chunk_id(data[s:e], salt) for s, e in zip([0, *ends], ends)))
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_points"), pa.array(recipes, pa.binary()), pa.array(digests)], ["doc_id", "n_points", "recipe", "text_sha256"])

    return run


def _chunks(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, bytes] = {}
            for data in _bare(b.column("text")):
                ends = cuts(data)
                for s, e in zip([0, *ends], ends):
                    chunk = data[s:e]
                    name = chunk_id(chunk, salt)
                    if seen.setdefault(name, chunk) != chunk:  # both go on: the check below finds them
                        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([chunk], pa.binary())], ["id", "chunk"])
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], ["id", "chunk"])

    return run


def verified_recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_points, recipe, text_sha256), each identifier in a recipe standing for one chunk only."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n_points", F.char_length("text").cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    for salt in range(256):
        chunks = rows.select("text").mapInArrow(_chunks(salt), "id binary, chunk binary")
        named = chunks.groupBy("id").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
        if not named.where("low != high").limit(1).count():
            made = rows.mapInArrow(_recipes(salt), f"doc_id {kind}, n_points long, recipe binary, text_sha256 string")
            return written(made, "recipes")
    raise RuntimeError("no salt gives each chunk an identifier of its own")


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs."""
    recipes = verified_recipes(docs)
    rank = F.struct(F.col("n_points"), F.col("doc_id").isNotNull(), F.bitwise_not("doc_id"))  # smaller doc_ids rank higher
    groups = recipes.groupBy("recipe").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(rank).alias("__best"), F.max_by("doc_id", rank).alias("keep_id")
    )
    both = recipes.join(spread(groups, "recipe"), "recipe")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("__best.n_points"))
    return both.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as bare from documents),
g as (select bare, count(*) as group_size,
             first(doc_id order by length(text) desc, doc_id) as keep_id, max(length(text)) as n from d group by bare)
select doc_id, keep_id, group_size, doc_id = keep_id and length(text) = n as kept, sha256(d.bare) as text_sha256
from d join g using (bare)
"""
