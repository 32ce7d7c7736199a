"""Fixtures: images of known content with their truth, made by Spark from (place, bytes) rows.

A fixture is a list of pieces: bytes at places of an image of a stated size, later pieces over earlier ones. Spark lays
them on blocks of the image and writes it as a stream, so an image of any size is built a block at a time."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats
from .streams import write_streams

BLOCK = 1024 * 1024


@dataclass
class Fixture:
    """name, size, pieces (place, bytes), and truth: recordings (channel, offset, length, frames) and what else holds."""

    name: str
    size: int
    pieces: list[tuple[int, bytes]]
    recordings: list[tuple[int, int, int, int]] = field(default_factory=list)
    truth: dict = field(default_factory=dict)


def packed_date(year: int, month: int, day: int, second: int) -> int:
    """The frame format's date for so many seconds after midnight."""
    hour, minute = divmod(second // 60, 60)
    return (year - 2000) << 26 | month << 22 | day << 17 | hour << 12 | minute << 6 | second % 60


def frame(kind: int, channel: int, sequence: int, date: int, payload: bytes, records: bytes = b"", tick: int = 0) -> bytes:
    """The bytes of one frame."""
    length = formats.HEADER.size + len(records) + len(payload) + formats.TRAILER
    head = formats.HEADER.pack(formats.MAGIC, kind, 0, channel, 0, sequence, length, date, tick & 0xFFFF, len(records), 0)
    return head + records + payload + formats.END_MAGIC + struct.pack("<I", length)


#: A record that states H.264 at 25 frames a second.
H264 = b"\x81\x00\x02\x19"


def recording(channel: int, frames: int, start: int = 36_000, every: int = 25, day: int = 5) -> bytes:
    """Frames of a channel: a keyframe of 241 bytes each `every`, others of 102; 25 a second from `start` seconds of the day."""
    made = []
    for k in range(frames):
        key = k % every == 0
        payload = bytes([channel]) * (205 if key else 70)
        made.append(frame(0xFD if key else 0xFC, channel, k, packed_date(2026, 3, day, start + k // 25), payload, H264 if key else b"", 40 * k))
    return b"".join(made)


def corpus() -> dict[str, Fixture]:
    """Four channels carved (S-01), one overwritten in part (S-03), bad sectors (S-06), a clock set back (S-08), an export cut
    short (S-09), nothing at all (S-11)."""
    one = recording(0, 50)
    places = [65536 + k * (len(one) + 32768) for k in range(4)]
    four = Fixture("S-01", 4 << 20, [(at, recording(k, 50)) for k, at in enumerate(places)], [(k, at, len(one), 50) for k, at in enumerate(places)])
    hit, lost = 67616, 16384
    over = Fixture("S-03", 1 << 20, [(65536, recording(1, 200)), (hit, b"\xee" * lost)], truth={"surviving": [(65536, hit - 65536)], "overwritten": (hit, lost)})
    bad = [100, 101, 102, 500, 501, 1200, 1201, 2048]
    sectors = Fixture("S-06", 2 << 20, [(512 * 90, recording(2, 400))], truth={"gaps": [(512 * s, 512) for s in bad]})
    first, back = recording(1, 25, 36_000), recording(1, 25, 36_000 - 7200)
    clock = Fixture("S-08", len(first) + len(back), [(0, first), (len(first), back)], [(1, 0, len(first), 25), (1, len(first), len(back), 25)], {"jump_s": -7200})
    whole = recording(3, 100)
    cut = len(whole) * 6 // 10
    short = Fixture("S-09", cut, [(0, whole[:cut])], truth={"whole": len(whole)})
    return {f.name: f for f in (four, over, sectors, clock, short, Fixture("S-11", 2 << 20, []))}


def build(spark: SparkSession, fixtures: list[Fixture], path: str) -> DataFrame:
    """The images, written below path, one task each: the manifest of sources.streams."""
    rows = [(f.name, rank, at, data) for f in fixtures for rank, (at, data) in enumerate(f.pieces)]
    pieces = spark.createDataFrame([(n, r, a, bytearray(d)) for n, r, a, d in rows], "name string, rank int, place long, bytes binary")
    sizes = spark.createDataFrame([(f.name, f.size) for f in fixtures], "name string, size long")
    blocks = sizes.select("name", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / BLOCK))).alias("n"))
    touched = F.explode(F.sequence(F.floor(F.col("place") / BLOCK), F.floor((F.col("place") + F.octet_length("bytes") - 1) / BLOCK)))
    low = F.greatest(F.col("place"), F.col("n") * BLOCK)
    cut = F.substring(F.col("bytes"), (low - F.col("place") + 1).cast("int"), F.lit(BLOCK))
    parts = pieces.withColumn("n", touched).select("name", "n", F.struct("rank", (low - F.col("n") * BLOCK).alias("at"), cut.alias("bytes")).alias("piece"))
    laid = blocks.join(parts.groupBy("name", "n").agg(F.array_sort(F.collect_list("piece")).alias("pieces")), ["name", "n"], "left")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, n, size, found = (b.column(c)[i].as_py() for c in ("name", "n", "size", "pieces"))
                data = bytearray(min(BLOCK, size - n * BLOCK))
                for p in found or []:
                    part = p["bytes"][: len(data) - p["at"]]
                    data[p["at"] : p["at"] + len(part)] = part
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([bytes(data)], pa.binary())], ["name", "n", "bytes"])

    return write_streams(laid.mapInArrow(lay, "name string, n long, bytes binary"), path)
