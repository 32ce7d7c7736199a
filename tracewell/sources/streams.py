"""Byte streams written out: elementary streams of recordings, clips, and artefacts under the digest of their bytes.

The writer is a Python data source. A task writes each stream whose rows it gets to a file of the job's own folder, a row
at a time, and hashes it as it goes; the digests are its commit message. Only when all tasks are done does the driver
give files their names and write the manifest. A name that exists is refused before anything is renamed. A task that
fails or is tried again leaves only files of its own, which go with the job's folder."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .evidence import members_of, read_at
from .export import frame_index

#: What a stream's file name ends with, by codec.
SUFFIXES = {"h264": ".h264", "h265": ".h265", "mpeg4": ".m4v", "mjpeg": ".mjpeg"}
STREAM = "name string, n long, bytes binary"


@dataclass
class Written(WriterCommitMessage):
    """Of each stream: its name, the task's file, size, rows and digests."""

    files: list[dict]


class _StreamWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.addressed = options["path"], options.get("addressed", "false").lower() == "true"
        self.job = options.get("job") or uuid.uuid4().hex
        self.work = os.path.join(self.path, "_temporary", self.job)

    def write(self, iterator: Iterator) -> Written:
        """Rows come by name and n."""
        os.makedirs(self.work, exist_ok=True)
        files: list[dict] = []
        out, hashes, last = None, (), None
        try:
            for row in iterator:
                if out is None or row["name"] != files[-1]["name"]:
                    if out is not None:
                        self._end(files[-1], out, hashes)
                    files.append({"name": row["name"], "file": os.path.join(self.work, uuid.uuid4().hex), "size": 0, "rows": 0})
                    out, hashes, last = open(files[-1]["file"], "xb"), (hashlib.sha256(), hashlib.md5()), None  # noqa: SIM115
                if last is not None and row["n"] <= last:
                    raise ValueError(f"rows of {row['name']} are not in order: {last}, {row['n']}")
                last = row["n"]
                out.write(row["bytes"])
                for h in hashes:
                    h.update(row["bytes"])
                files[-1]["size"] += len(row["bytes"])
                files[-1]["rows"] += 1
        finally:
            if out is not None:
                self._end(files[-1], out, hashes)
        return Written(files)

    @staticmethod
    def _end(file: dict, out, hashes: tuple) -> None:
        out.flush()
        os.fsync(out.fileno())
        out.close()
        file["sha256"], file["md5"] = (h.hexdigest() for h in hashes)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        names = [f["name"] for f in files]
        try:
            if len(set(names)) < len(names):
                raise ValueError("a stream's rows were in several tasks")
            for f in files:
                f["path"] = os.path.join(self.path, f["sha256"][:2], f["sha256"]) if self.addressed else os.path.join(self.path, f["name"])
                if not self.addressed and os.path.exists(f["path"]):
                    raise FileExistsError(f"refusing to overwrite {f['path']}")
            for f in files:
                os.makedirs(os.path.dirname(f["path"]), exist_ok=True)
                os.replace(f.pop("file"), f["path"])  # of equal bytes, under their digest, any is the one
            folder = os.path.join(self.path, "_manifests")
            os.makedirs(folder, exist_ok=True)
            part = os.path.join(self.work, "manifest")
            os.makedirs(self.work, exist_ok=True)
            with open(part, "w", encoding="utf-8") as out:
                out.writelines(json.dumps(f, sort_keys=True) + "\n" for f in sorted(files, key=lambda f: f["name"]))
            os.replace(part, os.path.join(folder, f"{self.job}.json"))
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.work, ignore_errors=True)
        if os.path.isdir(top := os.path.dirname(self.work)) and not os.listdir(top):
            os.rmdir(top)


class EvidenceStreams(DataSource):
    """df.write.format("evidence_streams").mode("append").option("path", ...): rows of name, n, bytes, in that order."""

    @classmethod
    def name(cls) -> str:
        return "evidence_streams"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _StreamWriter(self.options)


MANIFEST = "name string, path string, size long, rows long, sha256 string, md5 string"


def write_streams(rows: DataFrame, path: str, addressed: bool = False) -> DataFrame:
    """The manifest (MANIFEST) of the streams written: rows (name, n, bytes) joined by name in order of n. With `addressed`
    files are named by their digest, and bytes that are there already stay. A stream is one task's, a row at a time."""
    spark = rows.sparkSession
    spark.dataSource.register(EvidenceStreams)
    job = uuid.uuid4().hex
    ordered = rows.select("name", "n", "bytes").repartition("name").sortWithinPartitions("name", "n")
    ordered.write.format("evidence_streams").mode("append").options(addressed=str(addressed).lower(), job=job).save(path)
    return manifest(spark, path, job)


def manifest(spark: SparkSession, path: str, job: str | None = None) -> DataFrame:
    """What was written below a path, by all jobs or by one."""
    return spark.read.schema(MANIFEST).json(f"{path}/_manifests/{job}.json" if job else f"{path}/_manifests")


def payloads(frames: DataFrame, image: str) -> DataFrame:
    """frames (payload_offset, payload_length, ...) of an image that executors mount, with bytes: read at their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = members_of(image)
        for b in batches:
            read = [read_at(members, o, n)[0] for o, n in zip(b.column("payload_offset").to_pylist(), b.column("payload_length").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(read, pa.binary())], [*b.schema.names, "bytes"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema)
    return frames.mapInArrow(run, f"{schema}, bytes binary")


def export_recordings(recordings: DataFrame, frames: DataFrame, image: str, path: str) -> tuple[DataFrame, DataFrame]:
    """The elementary stream of each recording and its frame index, written below path: the manifest, and the index.

    recordings: recording_id, channel, codec, offset, length; frames (of the image's walk): offset, length, kind, channel,
    payload_offset, payload_length. A recording's stream has the payloads of the video frames of its channel that lie in
    its extent, in order. A recording without any is refused."""
    spans = recordings.select("recording_id", "codec", F.col("channel").alias("__channel"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"))
    at = frames.select("offset", "length", "kind", "channel", "payload_offset", "payload_length")
    # a frame lies in the cells of CELL bytes that its start has; a recording asks in all the cells it covers
    cells = F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL)))
    met = at.withColumn("__cell", F.floor(F.col("offset") / CELL)).join(spans.withColumn("__cell", cells), "__cell")
    own = met.where((F.col("offset") >= F.col("start")) & (F.col("offset") + F.col("length") <= F.col("end")) & F.col("channel").eqNullSafe(F.col("__channel")))
    index = frame_index(own.withColumn("pts_ms", F.lit(None).cast("long")), ["recording_id"]).drop("__cell", "__channel", "start", "end")
    none = spans.join(index.select("recording_id"), "recording_id", "left_anti").select("recording_id").take(1)
    if none:
        raise ValueError(f"{none[0].recording_id}: no video frames in its extent")
    suffix = F.coalesce(*[F.when(F.col("codec") == c, s) for c, s in SUFFIXES.items()], F.lit(".es"))
    rows = payloads(index, image).select(F.concat("recording_id", suffix).alias("name"), "n", "bytes")
    made = write_streams(rows, path)
    lines = index.withColumn("line", F.concat(F.to_json(F.struct("n", "es_offset", F.col("payload_length").alias("size"), "kind", (F.col("kind") == "I").alias("key"), F.col("offset").alias("source_offset"), F.col("length").alias("source_length"))), F.lit("\n")))
    told = write_streams(lines.select(F.concat("recording_id", F.lit(".frames.jsonl")).alias("name"), "n", F.encode("line", "UTF-8").alias("bytes")), path)
    return made.unionByName(told), index


#: Bytes of a cell in which frames meet the recordings that cover it.
CELL = 16 * 1024 * 1024


def keep_artefacts(artefacts: DataFrame, path: str, created: str) -> DataFrame:
    """Artefacts (kind, recording_id, content) written under the SHA-256 of their bytes: the rows of a case's artefact
    table. Equal bytes are one file."""
    rows = artefacts.select("kind", "recording_id", F.col("content").cast("binary").alias("bytes")).withColumn("sha256", F.sha2("bytes", 256))
    one = rows.groupBy("sha256").agg(F.first("bytes").alias("bytes"))
    made = write_streams(one.select(F.col("sha256").alias("name"), F.lit(0).cast("long").alias("n"), "bytes"), path, addressed=True)
    files = made.groupBy("sha256").agg(F.max("path").alias("path"), F.max("size").alias("size_bytes"))
    return rows.drop("bytes").distinct().join(files, "sha256").select("sha256", "kind", "recording_id", "path", "size_bytes", F.lit(created).alias("created"))
