"""Evidence as tables: image windows, split images as one address space, file sets, read gaps, ingest.

Image windows come from a Python data source that reads mounted files (an evidence share that every executor mounts); a
partition is one window, so an image of any size is read in parallel and no value is larger than a window. Small members
and exports come from Spark's binaryFile source, which reads any store Spark reads.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.intervals import complement, islands

#: Bytes of a window, of its overlap and of a sector; retries of a read; bad sectors in a row that end it.
CHUNK, OVERLAP, SECTOR, RETRIES, ABORT_AFTER = 64 * 1024 * 1024, 64 * 1024, 512, 2, 2048


class Unreadable(Exception):
    """Too many bad sectors in a row, or a file that ends before its stated size."""


#: What the names of containers end with that need a decoder.
CONTAINERS = (".e01", ".ex01")


def open_source(spark: SparkSession, path: str, evidence_id: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[DataFrame, int]:
    """The windows and the size of what lies at a path, by its kind: a folder is a file set, a name that ends with a number
    part of a split image, any other file a raw image. What is not there, or a container, raises."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no evidence at {path}")
    if path.lower().endswith(CONTAINERS):
        raise NotImplementedError(f"{path} is a container that needs a decoder")
    return image_windows(spark, path, evidence_id, chunk, overlap), sum(size for _, size in members_of(path))


def members_of(path: str) -> list[tuple[str, int]]:
    """(file, size) of evidence, in the order in which its bytes follow one another: of an image the file itself; of a split
    image the part named and all later ones, .001, .002, ...; of a folder all files below it, by their relative path,
    which are one address space. A missing part raises."""
    if os.path.isdir(path):
        found = [f for top, _, names in os.walk(path) for name in names if not os.path.islink(f := os.path.join(top, name))]
        found.sort(key=lambda f: os.path.relpath(f, path).replace(os.sep, "/"))
        return [(f, os.path.getsize(f)) for f in found]
    m = re.fullmatch(r"(.*)\.(\d{3,})", path)
    if not m:
        return [(path, os.path.getsize(path))]
    folder, stem = os.path.split(m[1])
    numbers = {int(x[1]): x[0] for x in (re.fullmatch(rf"{re.escape(stem)}\.(\d{{{len(m[2])},}})", n) for n in os.listdir(folder or ".")) if x}
    first = int(m[2])
    numbers = {k: n for k, n in numbers.items() if k >= first}
    if first not in numbers or sorted(numbers) != list(range(first, first + len(numbers))):
        raise FileNotFoundError(f"a part of {m[1]} is missing: found {sorted(numbers)}")
    files = [os.path.join(folder, numbers[k]) for k in sorted(numbers)]
    return [(f, os.path.getsize(f)) for f in files]


def read_at(members: list[tuple[str, int]], offset: int, length: int, read=None) -> tuple[bytes, list[tuple[int, int]]]:
    """Bytes at an offset of the members' joined address space, cut at its end, and the sectors that could not be read.

    A failed read is tried RETRIES times more, then narrowed to sectors; a bad sector reads as zeros and is reported."""
    read = read or _read_file
    out, bad, base = bytearray(), [], 0
    for file, size in members:
        low, high = max(offset, base), min(offset + length, base + size)
        if low < high:
            try:
                out += _tried(read, file, low - base, high - low)
            except OSError:
                out += _by_sector(read, file, low - base, high - base, base, bad)
        base += size
    return bytes(out), bad


def _read_file(file: str, at: int, length: int) -> bytes:
    with open(file, "rb") as f:
        f.seek(at)
        return f.read(length)


def _tried(read, file: str, at: int, length: int) -> bytes:
    for k in range(RETRIES + 1):
        try:
            data = read(file, at, length)
            if len(data) != length:
                raise Unreadable(f"{file} ends before byte {at + length}")
            return data
        except OSError:
            if k == RETRIES:
                raise
    raise AssertionError


def _by_sector(read, file: str, low: int, high: int, base: int, bad: list) -> bytes:
    out, row, at = bytearray(), 0, low
    while at < high:
        stop = min(high, at - at % SECTOR + SECTOR)
        try:
            out += _tried(read, file, at, stop - at)
            row = 0
        except OSError:
            out += bytes(stop - at)
            bad.append((base + at, stop - at))
            row += 1
            if row >= ABORT_AFTER:
                raise Unreadable(f"{row} bad sectors in a row at byte {base + at} of {file}") from None
        at = stop
    return bytes(out)


class _Window(InputPartition):
    """members: those that the window touches, each with its place; so a partition of a set of a million files is small."""

    def __init__(self, evidence_id: str, members: list, offset: int, base: int):
        self.evidence_id, self.members, self.offset, self.base = evidence_id, members, offset, base


class _ImageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.evidence_id = options.get("evidence_id", self.path)
        self.chunk, self.overlap = int(options.get("chunk", CHUNK)), int(options.get("overlap", OVERLAP))
        regions = options.get("regions", "")  # "offset+length,..." : only windows that touch one are read
        self.regions = [tuple(map(int, r.split("+"))) for r in regions.split(",") if r]

    def partitions(self) -> list[InputPartition]:
        members = members_of(self.path)
        size = sum(n for _, n in members)
        touched = lambda at: not self.regions or any(o < at + self.chunk and at < o + n for o, n in self.regions)
        ends = list(accumulate(n for _, n in members))
        windows = []
        for at in range(0, size, self.chunk):
            if touched(at):
                first, last = bisect_right(ends, at), bisect_right(ends, min(at + self.chunk + self.overlap, size) - 1)
                windows.append(_Window(self.evidence_id, members[first : last + 1], at, ends[first] - members[first][1]))
        return windows

    def read(self, partition: _Window) -> Iterator[pa.RecordBatch]:
        data, bad = read_at(partition.members, partition.offset - partition.base, self.chunk + self.overlap)
        gaps = [{"offset": partition.base + o, "length": n} for o, n in bad]
        yield pa.RecordBatch.from_arrays(
            [pa.array([partition.evidence_id]), pa.array([partition.offset], pa.int64()), pa.array([data], pa.binary()), pa.array([gaps], pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))],
            ["evidence_id", "offset", "bytes", "gaps"],
        )


class EvidenceImage(DataSource):
    """spark.read.format("evidence_image").option("path", ...): evidence_id, offset, bytes, gaps of each window."""

    @classmethod
    def name(cls) -> str:
        return "evidence_image"

    def schema(self) -> str:
        return "evidence_id string, offset long, bytes binary, gaps array<struct<offset:bigint,length:bigint>>"

    def reader(self, schema) -> DataSourceReader:
        return _ImageReader(self.options)


def image_windows(spark: SparkSession, path: str, evidence_id: str, chunk: int = CHUNK, overlap: int = OVERLAP, regions: list[tuple[int, int]] | None = None) -> DataFrame:
    spark.dataSource.register(EvidenceImage)
    listed = ",".join(f"{o}+{n}" for o, n in regions or [])
    return spark.read.format("evidence_image").options(path=path, evidence_id=evidence_id, chunk=chunk, overlap=overlap, regions=listed).load()


def file_set(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, base: the files below a folder that executors mount, by relative path, each with its place in their
    joined address space. The bytes of the space are read by windows (image_windows of the folder)."""
    members = members_of(folder)
    bases = [0, *accumulate(n for _, n in members)]
    return spark.createDataFrame([(f, n, base) for (f, n), base in zip(members, bases)], "path string, length long, base long")


def missing_parts(parts: DataFrame) -> DataFrame:
    """stem, after: numbered parts of split images whose next number is missing. parts: path."""
    rows = parts.select(F.regexp_extract("path", r"^(.*)\.(\d{3,})$", 1).alias("stem"), F.regexp_extract("path", r"^(.*)\.(\d{3,})$", 2).cast("int").alias("number")).where("number is not null")
    order = Window.partitionBy("stem").orderBy("number")
    return rows.withColumn("next", F.lead("number").over(order)).where("next != number + 1").select("stem", F.col("number").alias("after"))


def merged_gaps(gaps: DataFrame) -> DataFrame:
    """evidence_id, offset, length: unreadable ranges with those that touch joined."""
    spans = gaps.select("evidence_id", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"))
    return islands(spans, ["evidence_id"]).select("evidence_id", F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"))


def readable_ranges(images: DataFrame, gaps: DataFrame) -> DataFrame:
    """evidence_id, offset, length: what the gaps leave of each image (evidence_id, size)."""
    spans = gaps.select("evidence_id", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"))
    bounds = images.select("evidence_id", F.lit(0).cast("long").alias("low"), F.col("size").alias("high"))
    left = complement(spans, ["evidence_id"], bounds)
    return left.select("evidence_id", F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"))


def image_digests(windows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """evidence_id, md5, sha1, sha256, size of whole images, read in order of offset as windows stream through the task
    that hashes the image: a digest of one byte string is sequential, and memory stays at one window."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashes, size, out = None, [], 0, []

        def end() -> None:
            if now is not None:
                out.append((now, *(h.hexdigest() for h in hashes), size))

        for b in batches:
            for evidence, data in zip(b.column("evidence_id").to_pylist(), b.column("bytes").to_pylist()):
                if evidence != now:
                    end()
                    now, hashes, size = evidence, [hashlib.md5(), hashlib.sha1(), hashlib.sha256()], 0
                for h in hashes:
                    h.update(data[:chunk])
                size += len(data[:chunk])
        end()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], ["evidence_id", "md5", "sha1", "sha256", "size"])

    rows = windows.select("evidence_id", "offset", "bytes").repartition("evidence_id").sortWithinPartitions("evidence_id", "offset")
    return rows.mapInArrow(run, "evidence_id string, md5 string, sha1 string, sha256 string, size long")


def new_evidence(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (source_path, size, provenance_class, stored_md5, md5) not yet known by path, with a note on the hash
    stored in the image: match, MISMATCH, or none stored. A provenance class outside A to D raises."""
    fresh = candidates.join(known.select("source_path"), "source_path", "left_anti")
    note = F.when(F.col("stored_md5").isNull(), "no stored hash").when(F.lower("stored_md5") == F.col("md5"), "stored hash matches").otherwise("stored hash MISMATCH")
    checked = F.when(F.col("provenance_class").isin("A", "B", "C", "D"), F.col("provenance_class")).otherwise(F.raise_error("unknown provenance class").cast("string"))
    return fresh.withColumns({"provenance_class": checked, "notes": note})


def size_changed(known: DataFrame, found: DataFrame) -> DataFrame:
    """evidence_id of items whose file no longer has the size they were taken in with."""
    return known.join(found.select("source_path", F.col("size").alias("now")), "source_path", "left").where("now is null or now != capacity_bytes").select("evidence_id")
