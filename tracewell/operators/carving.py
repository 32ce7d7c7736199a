"""Signature scans over evidence bytes: windows with overlap, every occurrence, one hit an offset, grouped spans."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import staged
from .intervals import islands

CHUNK, OVERLAP = 64 * 1024 * 1024, 64 * 1024
#: Places that are sent to every task with windows, at most: some ten MB of numbers.
FEW = 200_000


def windows(content: Column, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Structs of offset and bytes: [k * chunk, k * chunk + chunk + overlap) for each chunk of a binary value."""
    size = F.octet_length(content)
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(chunk))
    piece = lambda s: F.struct(s.cast("long").alias("offset"), F.substring(content, s + 1, F.lit(chunk + overlap)).alias("bytes"))
    return F.when(size > 0, F.transform(starts, piece)).otherwise(F.array().cast("array<struct<offset:bigint,bytes:binary>>"))


def occurrences(content: Column, pattern: bytes | str) -> Column:
    """Every offset of a pattern in a value, overlapping ones included, by built-in functions only.

    The value is split at each byte's place where the pattern stands; for long binary values use scan."""
    size = len(pattern)
    places = F.sequence(F.lit(0), F.greatest(F.octet_length(content) - size, F.lit(0)))
    hit = lambda i: F.substring(content, i + 1, F.lit(size)) == F.lit(pattern)
    return F.when(F.octet_length(content) >= size, F.filter(places, hit)).otherwise(F.array().cast("array<int>"))


class Signature(NamedTuple):
    """A pattern; validate(data, at) -> the length of what starts there, or None; reach(data, at) -> the bytes from there
    on that validate needs to see (the header, at least, lies in a window's overlap)."""

    pattern: bytes
    validate: Callable[[bytes, int], int | None] | None = None
    reach: Callable[[bytes, int], int] | None = None


_HITS = ["evidence_id", "offset", "length", "signature"]


def _hit_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], _HITS)


def slices(chunks: DataFrame, places: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """places (evidence_id, offset, size, ...) with bytes: what the windows hold from offset on, size bytes or up to the
    image's end. Each place meets the windows that it touches, takes its part of each, and only the parts travel: up to FEW
    places go to the windows; more of them meet the windows by a shuffle of both. places are read twice: stage them."""
    cells = F.explode(F.sequence(F.floor(F.col("offset") / chunk), F.floor((F.col("offset") + F.greatest("size", F.lit(1)) - 1) / chunk)))
    asked = places.withColumns({"__at": F.col("offset"), "__cell": cells})
    own = chunks.select("evidence_id", F.floor(F.col("offset") / chunk).alias("__cell"), F.col("offset").alias("__base"), "bytes")
    if places.limit(FEW + 1).count() <= FEW:
        asked = F.broadcast(asked)
    met = own.join(asked, ["evidence_id", "__cell"])
    low = F.greatest(F.col("__at") - F.col("__base"), F.lit(0))
    high = F.least(F.col("__at") + F.col("size") - F.col("__base"), F.lit(chunk))
    part = F.substring(F.col("bytes"), (low + 1).cast("int"), (high - low).cast("int"))
    grouped = met.select(*places.columns, "__cell", part.alias("__part")).groupBy(*places.columns)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("__cell", "__part"))), lambda x: x["__part"])
    return grouped.agg(F.aggregate(parts, F.unhex(F.lit("")), lambda whole, x: F.concat(whole, x)).alias("bytes"))


def scan(chunks: DataFrame, signatures: dict[str, Signature | tuple], chunk: int = CHUNK) -> DataFrame:
    """evidence_id, offset, length, signature: validated hits, one an offset (the shortest, then by name).

    chunks: evidence_id, offset, bytes (a window with overlap). Hits in a window's overlap belong to the next window,
    which has them too. (Frames have a scan of their own, formats.frame_candidates, which reads no window twice.) A hit whose signature reaches beyond its window is read again, from all the windows that it
    touches, and validated there. A length of 0 or less is no hit."""
    known = {name: Signature(*s) for name, s in signatures.items()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for evidence, base, data in zip(b.column("evidence_id").to_pylist(), b.column("offset").to_pylist(), b.column("bytes").to_pylist()):
                for name, (pattern, validate, reach) in known.items():
                    at = data.find(pattern)
                    while 0 <= at < chunk:
                        needs = reach(data, at) if reach else 0
                        if at + needs > len(data):
                            rows.append((evidence, base + at, -needs, name))
                        else:
                            length = validate(data, at) if validate else len(pattern)
                            if length and length > 0:
                                rows.append((evidence, base + at, length, name))
                        at = data.find(pattern, at + 1)
            yield _hit_batch(rows, b.schema.field("evidence_id").type)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for evidence, offset, name, data in zip(*(b.column(c).to_pylist() for c in ("evidence_id", "offset", "signature", "bytes"))):
                length = known[name].validate(data, 0)
                if length and length > 0:
                    rows.append((evidence, offset, length, name))
            yield _hit_batch(rows, b.schema.field("evidence_id").type)

    schema = f"evidence_id {chunks.schema['evidence_id'].dataType.simpleString()}, offset long, length long, signature string"
    hits = chunks.select("evidence_id", "offset", "bytes").mapInArrow(find, schema)
    if any(s.reach for s in known.values()):
        hits = staged(hits, "marks")  # read twice
        far = slices(chunks, hits.where("length < 0").select("evidence_id", "offset", "signature", (-F.col("length")).alias("size")), chunk)
        hits = hits.where("length > 0").unionByName(far.mapInArrow(again, schema))
    return one_hit_an_offset(hits)


class BudgetExceeded(RuntimeError):
    """A job took longer than it was given. Nothing that it found is returned: a part would look like the whole."""


@contextmanager
def budget(spark: SparkSession, seconds: float) -> Iterator[None]:
    """The Spark jobs that this thread runs inside have so many seconds; then they are cancelled, and BudgetExceeded raised."""
    sc, tag, over = spark.sparkContext, f"budget-{uuid.uuid4().hex}", threading.Event()
    done, until = threading.Event(), time.monotonic() + seconds

    def watch() -> None:
        if not done.wait(max(0.0, until - time.monotonic())):
            over.set()
            while not done.wait(0.2):  # the job that runs now, and any that is started before the block ends
                sc.cancelJobsWithTag(tag)

    timer = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    timer.start()
    try:
        yield
        if over.is_set():
            raise BudgetExceeded(f"stopped after {seconds} s")
    except Exception as e:
        if over.is_set() and not isinstance(e, BudgetExceeded):
            raise BudgetExceeded(f"stopped after {seconds} s") from e
        raise
    finally:
        done.set()
        sc.removeJobTag(tag)
        timer.join()


def scan_within(chunks: DataFrame, signatures: dict[str, Signature | tuple], seconds: float, chunk: int = CHUNK) -> DataFrame:
    """The hits of scan, found and staged within a budget of time; BudgetExceeded and no rows if it does not suffice."""
    with budget(chunks.sparkSession, seconds):
        return staged(scan(chunks, signatures, chunk), "hits")


def one_hit_an_offset(hits: DataFrame) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("evidence_id", "offset").orderBy("length", "signature"))
    return hits.withColumn("__n", first).where("__n = 1").drop("__n")


def in_regions(chunks: DataFrame, regions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The windows that touch a region (evidence_id, offset, length); a window that does is scanned in full."""
    cells = F.explode(F.sequence(F.floor(F.col("offset") / chunk), F.floor((F.col("offset") + F.greatest("length", F.lit(1)) - 1) / chunk)))
    touched = regions.where("length > 0").select("evidence_id", cells.alias("__cell")).distinct()
    return chunks.withColumn("__cell", F.floor(F.col("offset") / chunk)).join(touched, ["evidence_id", "__cell"], "left_semi").drop("__cell")


def group_hits(hits: DataFrame, max_gap: int = 0, size: tuple[int, int] | None = None) -> DataFrame:
    """evidence_id, start, end, members: hits back to back, or within max_gap, as candidate spans. size: as sweeps.dealt has it."""
    spans = hits.select("evidence_id", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"))
    return islands(spans, ["evidence_id"], max_gap=max_gap, size=size).where("end > start")
