"""Packing: documents' token ids in sequences of 1024 with little padding, shortest pack first over the length histogram.

A document's ids, closed by the end id, are cut into pieces of 1024 and a rest. The histogram of piece lengths (1024
numbers at most, whatever the input) comes to the driver; lengths are placed longest first, each into the pack that is
shortest among those with room, which updates counts of packing patterns and never touches a document. Patterns are
then joined back by rank: pieces are ranked within their length, and a pattern's slot takes a range of ranks.

Ranks are counted by (length, hash bucket): about sqrt(N) buckets for N pieces, so a length that a third of all pieces
share is spread over them. Ids are made once; what is written is a row of numbers for each piece.

The ids are those of the vocabulary's tokenizers file without special tokens added: a special token's string in a text
is that token, as the file has it. tiktoken makes them from the ranks of the same vocabulary and the file's special
tokens (tests hold it against the tokenizers library, which is four times slower here). A text with BLANKS white-space
characters in a row goes through the tokenizers library, with the same ids: tiktoken's pattern overflows on such runs.

The table of slots goes to every task. Its size is bounded by `size` alone: a step of the packing fills packs up or
splits a pattern in two, and a length takes as many steps as there are patterns at most; at 1024 the tables measured
hold up to 15,000 rows of 32 bytes.

Defined results: null text is empty and its ids are the end id alone; sequences whose length is a power of two need no
padding, all others are padded to 1024; rows that repeat a doc_id are packed each, a null doc_id too; a text longer than
a sequence is cut into pieces, in one task; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, spread, written

SIZE = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k"
#: White space in a row from which on the tokenizers library makes the ids: tiktoken's pattern gives up on 1,000,000.
BLANKS = 100_000
_BLANK_RUN = re.compile(rf"\s{{{BLANKS}}}")


@cache
def encoder(ranks_file: str, tokenizer_file: str) -> Callable[[str], list[int]]:
    """Text to ids: ranks from one file, special tokens from the other."""
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(tokenizer_file, encoding="utf-8") as file:
        special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    made = tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if len(text) >= BLANKS and _BLANK_RUN.search(text):
            from tokenizers import Tokenizer

            return Tokenizer.from_file(tokenizer_file).encode(text, add_special_tokens=False).ids
        return made.encode(text, allowed_special="all")

    return encode


def _pieces(files: tuple[str, str], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files)
        for b in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                for s in range(0, len(ids), size):
                    part = ids[s : s + size]
                    row.append(i)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
            columns = [b.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packing patterns for `histogram` (length -> pieces)."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in by_room.items() if packs and r >= length), default=None)
            if room is None:  # new packs: each takes pieces of this length until it has no room for one
                most = size // length
                for count, held in ((left // most, most), (1, left % most)):
                    if count and held:
                        by_room.setdefault(size - held * length, []).append((count, (length,) * held))
                break
            count, lengths = by_room[room].pop()
            took = min(count, left)
            if count > took:
                by_room[room].append((count - took, lengths))
            by_room.setdefault(room - length, []).append((took, (*lengths, length)))
            left -= took
    return [pack for room in sorted(by_room) for pack in by_room[room]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) of the patterns' slots, sorted."""
    rows, used, sequence = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _placed(table: np.ndarray):
    keys = (table[:, 0] << 48) | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            slot = table[np.searchsorted(keys, (length << 48) | rank, "right") - 1]
            columns = [b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            columns += [pa.array(slot[:, 2] + rank - slot[:, 1]), pa.array(slot[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, size: int = SIZE, files: tuple[str, str] | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    files: the vocabulary's ranks and its tokenizers file."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    files = files or tuple(public_tokenizers.path(f"{VOCABULARY}.{end}") for end in ("tiktoken", "json"))
    columns = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    with scratch(docs.sparkSession):
        pieces = written(docs.select("doc_id", "text").mapInArrow(_pieces(files, size), columns), "pieces")
        histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
        buckets = max(1, math.isqrt(sum(histogram.values())))
        pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
        before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
        starts = starts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
        ranked = pieces.join(spread(starts, "length", "bucket"), ["length", "bucket"])
        ranked = written(ranked.withColumn("rank", F.col("base") + F.row_number().over(inside) - 1).drop("bucket", "base"), "ranked", keep=True)
    table = slots(shortest_pack_first(histogram, size))
    return ranked.mapInArrow(_placed(table), columns + ", sequence_id long, offset long")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
