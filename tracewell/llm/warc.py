"""WARC archives of pages, and their index by external merge.

Writing: equal payloads of at least 100 bytes are found by digest; the smallest page_id is written as a response, the
others as revisits that refer to it. A record is one value of Spark's text writer, whose line separator is the blank
lines that end a WARC record, so any file system Spark can write holds the archive.

Reading: Spark's text reader streams each archive in pieces between blank lines, and records are cut from the joined
pieces by the lengths they state, so a task holds a batch of pieces, one record and the index rows of its captures,
whatever the archive's size. Digests are checked, and the file's captures are sorted: a run. Runs are then cut by ranges of (URL key, time, page) and each range merges its slices of all runs
with a loser tree: concatenated ranges are the capture histories in global order. A range holds about a fixed number
of captures whatever their URL, since time and page break ties; files hold a bounded number of records.

Defined results: null html is an empty payload; a null url has no target header and reads back as null; control
characters in a url are percent-encoded in the archive and read back decoded; rows that repeat a page_id are written
and returned each, and a repeat of the smallest page_id of a group is a response as well; a page of any length is one
record; an empty table gives an empty index; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from itertools import groupby
from operator import itemgetter
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, spread, written

END = "\r\n\r\n"
LEAST_BYTES = 100
RECORDS_PER_FILE = 2000
CAPTURES_PER_RANGE = 20_000
#: Pages carry no capture time; they count as captured page_id seconds (modulo 10**9) from here on.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)

INDEX = "run long, seq long, url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, offset long, length long"


def record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, bytes, digest and first: the page that holds the payload's response."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    large = p.where(F.col("bytes") >= LEAST_BYTES)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return p.join(spread(first, "digest"), "digest", "left")  # short payloads have digests that `first` lacks


def write_warc(pages: DataFrame, path: str) -> None:
    """A WARC/1.1 record for each page, in files of at most RECORDS_PER_FILE, gzipped."""
    p = record_types(pages)
    revisit = F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    safe = F.regexp_replace("url", "%", "%25")
    for ch in ("\r", "\n", "\0"):
        safe = F.replace(safe, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    stamp = F.date_format(F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit("\r\nWARC-Date: "), stamp,
        F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit("\r\nWARC-Target-URI: "), safe)),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    out = p.select(F.concat(head, block).alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def url_key(url: str | None) -> str:
    """The host's labels reversed, then path and query: captures of a site sort together."""
    try:
        u = urlsplit(url or "")
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url or ""
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/").lower() + ("?" + u.query.lower() if u.query else "")


def records(chunks: Iterable[bytes]) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record, by the lengths stated. The chunks are an archive's bytes in order,
    cut anywhere; a blank line too many at its end is let pass, since a reader of lines can't tell it."""
    chunks, held, at, end = iter(chunks), bytearray(), 0, END.encode()

    def filled(size: int) -> bool:
        while len(held) < size:
            if (chunk := next(chunks, None)) is None:
                return False
            held.extend(chunk)
        return True

    while filled(1) and (filled(len(end) + 1) or held != end):
        while (stop := held.find(end)) < 0 and filled(len(held) + 1):
            pass
        lines = held[: max(stop, 0)].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        body, size = stop + len(end), int(headers["Content-Length"])
        length = body + size + len(end)
        if not filled(length) or held[body + size : length] != end:
            raise ValueError(f"the record at byte {at} does not end where it states")
        yield at, length, headers, bytes(held[body : body + size])
        del held[:length]
        at += length


def _page(name: str | None) -> int | None:
    digits = (name or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def _capture(path: str, offset: int, length: int, h: dict[str, str], block: bytes) -> tuple:
    """A record's index row, without run and seq. A response whose payload is not what its head states is refused."""
    head, _, payload = block.partition(END.encode())
    size = int(head.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{path}: the payload at byte {offset} is not what its header states")
    url = h.get("WARC-Target-URI")
    url = None if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%00", "\0").replace("%25", "%")
    return url_key(url), h["WARC-Date"], _page(h["WARC-Record-ID"]), url, h["WARC-Type"], _page(h.get("WARC-Refers-To")), size, digest, offset, length


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A run for each archive file: its captures, sorted. A file's pieces come in their order, file after file."""
    kinds = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in INDEX.split(", "))])
    pieces = ((path, piece.as_py()) for b in batches for path, piece in zip(b.column("path").to_pylist(), b.column("piece")))
    for path, of_file in groupby(pieces, itemgetter(0)):
        run = int.from_bytes(hashlib.blake2b(path.encode(), digest_size=7).digest(), "big")
        rows = sorted((_capture(path, *record) for record in records(piece + END.encode() for _, piece in of_file)), key=_order)
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(i).type) for i, c in enumerate([[run] * len(rows), range(len(rows)), *zip(*rows)])], schema=kinds)


def _order(row: tuple) -> tuple:
    """Sort key of a capture (url_key, captured, page_id, ...): a missing page sorts first."""
    return row[0], row[1], -1 if row[2] is None else row[2]


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, so a replaced winner replays one path."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.heads = [(0, key(r[0])) if r else (1,) for r in runs]  # (1,) sorts behind every key
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._enter(leaf)

    def _enter(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1 and not self.full:
                self.losers[node] = winner
                return
            if other != -1 and (self.heads[other], other) < (self.heads[winner], winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    @property
    def full(self) -> bool:
        return self.losers[0] != -1

    def __iter__(self) -> Iterator:
        while self.k and len(self.heads[w := self.losers[0]]) == 2:
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.heads[w] = (0, self.key(self.runs[w][self.at[w]])) if self.at[w] < len(self.runs[w]) else (1,)
            self._enter(w)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The range's slices of all runs, merged. The rows of a range come sorted by run and place in it."""
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    keys = list(zip(table["url_key"].to_pylist(), table["captured"].to_pylist(), table["page_id"].to_pylist(), range(table.num_rows)))
    slices: dict[int, list] = {}
    for run, key in zip(table["run"].to_pylist(), keys):
        slices.setdefault(run, []).append(key)
    order = pa.array([x[3] for x in LoserTree(list(slices.values()), _order)], pa.int64())
    yield from table.take(order).combine_chunks().to_batches()


def capture_index(spark, path: str) -> DataFrame:
    """The captures in the archives at path (gzipped, so that a file is read by one task), globally ordered by URL key,
    time and page."""
    text = spark.read.option("lineSep", END).option("recursiveFileLookup", "true").text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece"))
    runs = written(pieces.mapInArrow(_runs, INDEX), "runs")
    ranges = max(1, -(-runs.count() // CAPTURES_PER_RANGE))
    cut = runs.repartitionByRange(ranges, "url_key", "captured", "page_id")
    return cut.sortWithinPartitions("run", "seq").mapInArrow(_merge, INDEX)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return capture_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, n::bigint as payload_bytes, p.d as payload_digest,
       case when page_id != first then 'revisit' else 'response' end as record_type,
       case when page_id != first then first end as refers_to
from p left join f using (d)
"""
