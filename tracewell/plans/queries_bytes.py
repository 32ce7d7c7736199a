"""Queries over byte ranges and bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import carving, flows, intervals
from ..operators import reassembly as carved
from ..sources import evidence, formats
from . import tables as t
from .tables import CLAIMS_SQL, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Each byte range between neighbouring boundaries takes the strongest claim that covers it: a range join, unlike the sweep.
_TILES = f"""with {CLAIMS_SQL},
c as (select evidence_id, greatest(0, o) as lo, least(size, o + l) as hi, list_position(['unreadable', 'structural', 'parsed', 'carved'], b) as rank
      from claim join img using (evidence_id) where least(size, o + l) > greatest(0, o)),
p as (select evidence_id, lo as pos from c union select evidence_id, hi from c union select evidence_id, 0 from img union select evidence_id, size from img),
e as (select evidence_id, pos, lead(pos) over (partition by evidence_id order by pos) as nxt from p),
r as (select e.evidence_id, pos, nxt, coalesce(min(rank), 5) as rank from e left join c on c.evidence_id = e.evidence_id and lo <= pos and hi >= nxt where nxt is not null group by all),
m as (select *, nxt - sum(nxt - pos) over (partition by evidence_id, rank order by pos) as g from r),
tile as (select evidence_id, min(pos) as "offset", sum(nxt - pos)::bigint as length, ['unreadable', 'structural', 'parsed', 'carved', 'unaccounted'][rank] as bucket from m group by evidence_id, rank, g)"""


@query(_TILES + " select * from tile")
def coverage_map(spark, sf):
    return intervals.coverage_map(t.images(spark, sf), t.claims(spark, sf))


@query(_TILES + """, every as (select evidence_id, unnest(['unreadable', 'structural', 'parsed', 'carved', 'unaccounted']) as bucket from img)
select every.evidence_id, every.bucket, coalesce(sum(length), 0)::bigint as bytes from every left join tile using (evidence_id, bucket) group by all""")
def coverage_totals(spark, sf):
    return intervals.coverage_totals(t.images(spark, sf), coverage_map(spark, sf))


@query(_TILES + """ select img.evidence_id, size, coalesce(sum(length) filter (where bucket = 'unaccounted'), 0)::bigint as unaccounted_bytes,
  1 - coalesce(sum(length) filter (where bucket = 'unaccounted'), 0)::double / size as explained_fraction from img left join tile using (evidence_id) group by img.evidence_id, size""")
def coverage_explained(spark, sf):
    return intervals.explained(t.images(spark, sf), coverage_map(spark, sf))


_SPOILT = """select evidence_id, "offset", length - case when evidence_id % 10 = 3 and "offset" = 0 then 1 else 0 end as length, case when evidence_id % 10 = 4 then 'parsed' else bucket end as bucket from tile where not (evidence_id % 10 = 5 and "offset" > 90000)"""


@query(_TILES + f""", s as ({_SPOILT}),
n as (select *, lag("offset" + length) over w as prev, lag(bucket) over w as last from s window w as (partition by evidence_id order by "offset", length))
select distinct evidence_id, problem from (
  select evidence_id, 'gap' as problem from n where "offset" > coalesce(prev, 0) union all select evidence_id, 'overlap' from n where "offset" < coalesce(prev, 0)
  union all select evidence_id, 'empty run' from n where length <= 0 union all select evidence_id, 'split run' from n where last = bucket
  union all select img.evidence_id, 'wrong end' from img left join (select evidence_id, max("offset" + length) as reach from s group by 1) using (evidence_id) where coalesce(reach, 0) != size)""")
def coverage_check(spark, sf):
    spoilt = coverage_map(spark, sf).where("not (evidence_id % 10 = 5 and offset > 90000)").selectExpr(
        "evidence_id", "offset", "length - case when evidence_id % 10 = 3 and offset = 0 then 1 else 0 end as length", "case when evidence_id % 10 = 4 then 'parsed' else bucket end as bucket"
    )
    return intervals.coverage_problems(t.images(spark, sf), spoilt)


@query(_TILES + """ select evidence_id, bucket from tile where "offset" <= 50000 and "offset" + length > 50000""")
def bucket_at(spark, sf):
    return intervals.bucket_at(coverage_map(spark, sf), 50_000)


# Islands as the boundaries where no claim is open: a start before which all earlier claims have ended.
_ISLANDS = f"""with {CLAIMS_SQL}, c as (select evidence_id, o, o + l as e from claim where {{where}}),
starts as (select distinct evidence_id, o from c a where not exists (select 1 from c b where b.evidence_id = a.evidence_id and b.o < a.o and b.e + {{gap}} >= a.o)),
ends as (select distinct evidence_id, e from c a where not exists (select 1 from c b where b.evidence_id = a.evidence_id and b.o <= a.e + {{gap}} and b.e > a.e)),
isl as (select s.evidence_id, s.o as "start", min(x.e) as "end" from starts s join ends x on x.evidence_id = s.evidence_id and x.e >= s.o group by all),
full_isl as (select isl.*, count(*) as members from isl join c on c.evidence_id = isl.evidence_id and c.o >= isl."start" and c.o <= isl."end" and c.e <= isl."end" group by all)"""


def _spans(df):
    return df.selectExpr("evidence_id", "offset as start", "offset + length as end")


@query(_ISLANDS.format(where="b = 'unreadable'", gap=0) + " select * from full_isl")
def island_merge(spark, sf):
    return intervals.islands(_spans(t.claims(spark, sf).where("bucket = 'unreadable'")), ["evidence_id"])


@query(_ISLANDS.format(where="b = 'unreadable'", gap=0) + """ select evidence_id, "start" as "offset", "end" - "start" as length from full_isl""")
def gap_map(spark, sf):
    return evidence.merged_gaps(t.claims(spark, sf).where("bucket = 'unreadable'"))


@query(_ISLANDS.format(where="b = 'unreadable' and o < 100000", gap=0) + """, edge as (
  select evidence_id, 0 as lo, coalesce(min("start"), any_value(size)) as hi from img left join isl using (evidence_id) group by evidence_id
  union all select evidence_id, "end", coalesce(lead("start") over (partition by evidence_id order by "start"), 100000) from isl)
select evidence_id, lo as "offset", least(hi, 100000) - lo as length from edge where lo < least(hi, 100000)""")
def readable_ranges(spark, sf):
    return evidence.readable_ranges(t.images(spark, sf), t.claims(spark, sf).where("bucket = 'unreadable'"))


@query(_ISLANDS.format(where="b = 'carved'", gap=64) + " select * from full_isl")
def group_hits(spark, sf):
    return carving.group_hits(t.claims(spark, sf).where("bucket = 'carved'"), max_gap=64)


# Pieces of spans that no hole covers, from a range join of boundaries with spans and holes.
@query(f"""with {CLAIMS_SQL},
raw as (select evidence_id, o, o + l as e, b = 'unreadable' as hole from claim where b in ('unreadable', 'carved')),
st as (select distinct evidence_id, o, hole from raw a where not exists (select 1 from raw b where b.evidence_id = a.evidence_id and b.hole = a.hole and b.o < a.o and b.e >= a.o)),
en as (select distinct evidence_id, e, hole from raw a where not exists (select 1 from raw b where b.evidence_id = a.evidence_id and b.hole = a.hole and b.o <= a.e and b.e > a.e)),
isl as (select s.evidence_id, s.hole, s.o, min(x.e) as e from st s join en x on x.evidence_id = s.evidence_id and x.hole = s.hole and x.e >= s.o group by all),
cut as (select s.evidence_id, s.o, s.e, h.o as ho, h.e as he from isl s left join isl h on h.evidence_id = s.evidence_id and h.hole and h.o < s.e and h.e > s.o where not s.hole),
lo as (select evidence_id, o, e, o as p from cut where o not in (select c2.o from cut c2 where c2.evidence_id = cut.evidence_id and c2.ho <= c2.o) union select evidence_id, o, e, he from cut where he < e),
piece as (select evidence_id, p as "start", least(e, coalesce((select min(h.o) from isl h where h.hole and h.evidence_id = lo.evidence_id and h.o >= lo.p), e)) as "end" from lo)
select p.evidence_id, p."start", p."end", coalesce(string_agg(h.o || '+' || h.e, ',' order by h.o), '') as bounded_by
from (select distinct * from piece where "start" < "end") p left join isl h on h.hole and h.evidence_id = p.evidence_id and (h.o - p."end" between 0 and 512 or p."start" - h.e between 0 and 512)
group by all""")
def span_subtract(spark, sf):
    merged = lambda b: intervals.islands(_spans(t.claims(spark, sf).where(f"bucket = '{b}'")), ["evidence_id"]).drop("members")
    pieces = intervals.subtract(merged("carved"), merged("unreadable"), ["evidence_id"])
    return pieces.withColumn("bounded_by", F.array_join(F.transform("bounded_by", lambda h: F.concat_ws("+", h.start.cast("string"), h.end.cast("string"))), ","))


def _tiered(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_suppkey as evidence_id", "l_orderkey * 10 + l_linenumber as recording_id", "concat('T', 1 + l_partkey % 4) as tier", "l_returnflag as note",
        "array(named_struct('offset', (l_partkey * 37) % 100000, 'length', 1 + cast(floor(l_quantity) as bigint) / 10)) as extents",
    ).withColumn("extents", F.transform("extents", lambda e: F.struct(e.offset.alias("offset"), e.length.cast("long").alias("length"))))


@query()
def merge_tiers(spark, sf):
    return intervals.merge_tiers(_tiered(spark, sf))


@query()
def merge_stats(spark, sf):
    return intervals.merge_stats(merge_tiers(spark, sf))


@query()
def merge_notes(spark, sf):
    return intervals.merge_notes(merge_tiers(spark, sf))


def _recovery(spark, sf):
    """Line items as recordings of 1,000 items: returned ones are stored at T1, the others are what tiers found."""
    rows = _tiered(spark, sf).withColumns({"local_start_us": F.when(F.col("recording_id") % 3 != 0, F.lit(0)).cast("long"), "local_end_us": F.col("recording_id") % 7 * 60_000_000})
    stored = rows.where("note = 'R'").withColumn("tier", F.lit("T1"))
    none = spark.createDataFrame([], "evidence_id long, index_extents array<struct<offset:bigint,length:bigint>>")
    return flows.recovered(t.images(spark, sf), none, stored, rows.where("note != 'R'"), spark.createDataFrame([], "evidence_id long, offset long, length long"))


@query()
def recovery_summary(spark, sf):
    return _recovery(spark, sf)["summary"]


_CHUNK = 512


@query("""with w as (select page_id, html from pages), hit as (
  select page_id as evidence_id, i - 1 as "offset", case when substr(html, i, 4) = '</p>' then '</p>' else '<p>' end as signature
  from (select page_id, html, unnest(range(1, length(html) + 1)) as i from w) where substr(html, i, 3) = '<p>' or substr(html, i, 4) = '</p>')
select evidence_id, "offset", length(signature)::bigint as length, signature from hit where "offset" >= 0""")
def signature_scan(spark, sf):
    """Offsets in characters on the SQL side, in bytes here: pages of plain ASCII encoding are compared as code points."""
    pages = table(spark, sf, "pages")
    # one byte for each code point, so that both sides count alike
    flat = F.encode(F.regexp_replace("html", r"[^\x00-\x7F]", "?"), "UTF-8")
    chunks = pages.select(F.col("page_id").alias("evidence_id"), F.explode(carving.windows(flat, _CHUNK, 16)).alias("w")).select("evidence_id", "w.offset", "w.bytes")
    return carving.scan(chunks, {"<p>": (b"<p>", None), "</p>": (b"</p>", None)}, _CHUNK)


def _le32(n):
    number = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(number, k, 2) for k in (7, 5, 3, 1)]))


@query("""select page_id as evidence_id, page_id % 300 as "offset", 32 + strlen(coalesce(html, ''))::bigint as length, 'frame' as signature from pages where page_id % 3 != 1""")
def frame_scan(spark, sf):
    """Each page as an image: some filler, then a frame with the page's bytes as payload (its trailer spoilt in every
    third), scanned in windows smaller than most frames."""
    page = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    stated = _le32(F.octet_length(page) + 32)
    head = F.concat(F.lit(b"DHAV\xfd\0\1\0" + bytes(4)), stated, F.lit(bytes(8)))
    tail = F.concat(F.when(F.col("page_id") % 3 == 1, F.lit(b"dhaV")).otherwise(F.lit(b"dhav")), stated)
    filler = F.encode(F.expr("repeat('.', cast(page_id % 300 as int))"), "UTF-8")
    images = table(spark, sf, "pages").select(F.col("page_id").alias("evidence_id"), F.concat(filler, head, page, tail).alias("content"))
    chunks = images.select("evidence_id", F.explode(carving.windows(F.col("content"), _CHUNK, 24)).alias("w")).select("evidence_id", "w.offset", "w.bytes")
    return carving.scan(chunks, {"frame": formats.SIGNATURES["frame"]}, _CHUNK)


# Each document as a disk image: a frame for each line, with the line as payload, or with a frame of the line as payload.
_CHUNK_OF_DISK = 4096


def _disks(spark, sf):
    """Windows of the images, and their unreadable ranges."""
    texts = table(spark, sf, "documents").where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    lines = texts.select("doc_id", F.posexplode("lines").alias("k", "line"))
    i = F.col("k") + 1
    at = (5 << 17) + (3 << 22) + (26 << 26) + F.floor(i / 3600) % 24 * 4096 + F.floor(i / 60) % 60 * 64 + i % 60
    sequence = i - F.when(i % 64 == 0, 5).otherwise(0)

    def frame(kind, channel, records, payload):
        size = 32 + F.octet_length(records) + F.octet_length(payload)
        head = F.concat(F.lit(b"DHAV"), kind, F.lit(b"\0"), F.substring(_le32(channel), 1, 1), F.lit(b"\0"), _le32(sequence), _le32(size), _le32(at), F.lit(b"\0\0"), F.substring(_le32(F.octet_length(records)), 1, 1), F.lit(b"\0"))
        return F.concat(head, records, payload, F.lit(b"dhav"), _le32(size))

    none, payload, channel = F.lit(b""), F.encode("line", "UTF-8"), F.floor(i / 40) % 3
    payload = F.when(i % 3 == 0, frame(F.lit(b"\xfc"), F.lit(7), none, payload)).otherwise(payload)
    kind = F.when(i % 5 == 1, F.lit(b"\xfd")).when(i % 11 == 0, F.lit(b"\xf0")).otherwise(F.lit(b"\xfc"))
    records = F.when(i % 5 == 1, F.when(channel == 1, F.lit(b"\x81\0\x0c\x19")).otherwise(F.lit(b"\x81\0\x02\x19"))).otherwise(none)
    framed = lines.select(F.col("doc_id").alias("evidence_id"), F.struct("k", frame(kind, channel, records, payload).alias("bytes")).alias("f"))
    # joined as hex digits: in one step, where adding part to part copies the image for each
    parts = F.transform(F.array_sort(F.collect_list("f")), lambda f: F.hex(f.bytes))
    images = framed.groupBy("evidence_id").agg(F.unhex(F.array_join(parts, "")).alias("content"))
    chunks = images.select("evidence_id", F.explode(carving.windows(F.col("content"), _CHUNK_OF_DISK, 512)).alias("w")).select("evidence_id", "w.offset", "w.bytes")
    # of a size there is no need to build the image: each line has 32 bytes about it, every third 32 more, every fifth a record of 4
    n = F.size("lines")
    size = F.octet_length(F.array_join("lines", "")) + 32 * n + 32 * F.floor(n / 3) + 4 * F.floor((n + 4) / 5)
    sizes, size = texts.groupBy(F.col("doc_id").alias("evidence_id")).agg(F.sum(size).alias("size")), F.col("size")
    middle = F.when(F.col("evidence_id") % 4 < 2, 512 * F.floor(size / 1024))
    holes = F.array_compact(F.array(middle, F.when((F.col("evidence_id") % 4 == 1) & (size >= 4096), F.lit(0).cast("long"))))
    return chunks, sizes.select("evidence_id", F.explode(holes).alias("offset"), F.lit(512).cast("long").alias("length"))


_DISK_SQL = """with ln as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null),
f as (select doc_id, i, strlen(line) as n, case when i % 5 = 1 then 'I' when i % 11 = 0 then 'audio' else 'P' end as kind, ((i // 40) % 3)::int as channel, i - case when i % 64 = 0 then 5 else 0 end as sequence,
  epoch_us(timestamp '2026-03-05') + (i % 86400) * 1000000 as t from ln),
g as (select *, 24 + case when kind = 'I' then 4 else 0 end as head, 24 + case when kind = 'I' then 4 else 0 end + n + case when i % 3 = 0 then 32 else 0 end + 8 as l from f),
d as (select *, (sum(l) over (partition by doc_id order by i) - l)::bigint as o, (sum(l) over (partition by doc_id))::bigint as size from g),
disk as (select distinct doc_id, size from d),
hole as (select doc_id, 512 * (size // 1024) as a, 512 * (size // 1024) + 512 as b from disk where doc_id % 4 < 2 union all select doc_id, 0, 512 from disk where doc_id % 4 = 1 and size >= 4096),
cand as (select doc_id, o, l, kind, channel, sequence, t, case when kind = 'audio' then null when channel = 1 then 'h265' else 'h264' end as codec, o as oo, l as ol from d
  union all select doc_id, o + head, 32 + n, 'P', 7, sequence, t, null, o, l from d where i % 3 = 0)"""

_PIECE_SQL = _DISK_SQL + """, low as (select doc_id, 0 as a from disk union select doc_id, b from hole),
piece as (select low.doc_id, low.a, least(size, coalesce((select min(h.a) from hole h where h.doc_id = low.doc_id and h.a >= low.a), size)) as b from low join disk using (doc_id)),
walk as (select c.*, p.a as pa, p.b as pb from cand c join piece p on p.doc_id = c.doc_id and c.o >= p.a and c.o + c.l <= p.b where c.o = c.oo or not (c.oo >= p.a and c.oo + c.ol <= p.b))"""


@query(_DISK_SQL + """ select doc_id as evidence_id, o as "offset", l as length, kind, channel, sequence from cand where o = oo""")
def frame_walk(spark, sf):
    return formats.frames_of_windows(_disks(spark, sf)[0], chunk=_CHUNK_OF_DISK).select("evidence_id", "offset", "length", "kind", "channel", "sequence")


@query(_PIECE_SQL + """,
w as (select *, lag(channel) over w as pc, lag(t) over w as pt, lag(sequence) over w as ps, lag(o + l) over w as pe from walk window w as (partition by doc_id, pa order by o)),
y as (select *, case when channel != pc then 'channel changed ' || pc || ' -> ' || channel when t < pt then 'timestamp ran backwards' when sequence < ps then 'sequence number ran backwards' when o > pe then 'byte gap of ' || (o - pe) end as why from w),
r as (select *, sum(case when why is not null then 1 else 0 end) over (partition by doc_id, pa order by o) as run from y),
k as (select *, min(case when kind = 'I' then o end) over (partition by doc_id, pa, run) as key from r),
ended as (select doc_id, pa, run - 1 as run, why from r where why is not null),
x as (select doc_id, pa, any_value(pb) as pb, run, min(o) filter (where o >= key) as o, max(o + l) as e, max(channel) as channel, min(t) filter (where o >= key) as s, max(t) filter (where o >= key) as z,
  count(*) filter (where o >= key) as n, count(*) filter (where kind = 'I') as keys, coalesce(sum(l) filter (where o < key), 0)::bigint as trimmed from k where key is not null group by doc_id, pa, run)
select x.doc_id as evidence_id, row_number() over (partition by x.doc_id order by o) as position, case when x.doc_id % 4 < 2 then 'T4' else 'T3' end as tier, o as "offset", e - o as length, channel,
  case when channel = 1 then 'h265' else 'h264' end as codec, s as start_us, z as end_us, n as frame_count, keys as keyframes, (case when n <= 1 then 0.2 when keys >= 2 then 0.9 else 0.7 end)::double as confidence,
  trimmed as trimmed_bytes, coalesce(why, 'end of span') as ended,
  coalesce((select string_agg(h.a || '+' || (h.b - h.a), ', ' order by h.a) from hole h where h.doc_id = x.doc_id and (h.a - pb between 0 and 512 or pa - h.b between 0 and 512)), '') as bounded_by
from x left join ended using (doc_id, pa, run)""")
def reassembly(spark, sf):
    made = carved.reassembled(*_disks(spark, sf), _CHUNK_OF_DISK).drop("notes", "confidence_note")
    return made.withColumn("bounded_by", F.array_join(F.transform("bounded_by", lambda h: F.concat_ws("+", h.start.cast("string"), (h.end - h.start).cast("string"))), ", "))


@query("""select doc_id, md5(text) as md5, sha1(text) as sha1, sha256(text) as sha256 from documents""")
def triple_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scalars.digests(F.col("text")).alias("d")).select("doc_id", "d.*")


@query("""with h as (select *, sha256(text) as h from documents)
select h as sha256, first(source order by doc_id % 97, source, doc_id) as path, min(doc_id % 97) as created, count(*) as copies, max(strlen(text))::bigint as size_bytes from h group by h""")
def cas_dedup(spark, sf):
    from ..operators.integrity import content_addressed

    return content_addressed(table(spark, sf, "documents").selectExpr("source as path", "doc_id % 97 as created", "text as content"))


# Start codes are built from the text's line ends: each line is a unit, its first byte states its type.
@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null),
u as (select doc_id, i, line, case when ascii(line) > 127 then 63 else ascii(line) end & 31 as k from l where length(line) > 0)
select doc_id as stream_id, count(*) as units, count(*) filter (where k between 1 and 5) as pictures,
  sha256(unhex(coalesce(string_agg(printf('%08x', strlen(regexp_replace(line, '[^\x00-\x7F]', '?', 'g'))) || hex(encode(regexp_replace(line, '[^\x00-\x7F]', '?', 'g'))), '' order by i) filter (where k between 1 and 5), ''))) as picture_digest
from u group by doc_id""")
def nal_units(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null and text rlike '[^\\n]'")
    lines = F.split(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), "\n", -1)
    streams = docs.select(F.col("doc_id").alias("stream_id"), F.encode(F.concat(F.lit("\0\0\1"), F.array_join(lines, "\0\0\1")), "UTF-8").alias("content"))
    return formats.stream_summaries(streams)


@query("""select event_id, make_timestamp(2000 + y, mo, d, h, mi, s::double) as local from (select event_id, (event_id * 7919) % 60 as s, (event_id * 31) % 60 as mi, event_id % 24 as h, 1 + event_id % 31 as d, event_id % 14 as mo, event_id % 64 as y from events)
where mo between 1 and 12 and d <= day(last_day(make_date(2000 + y, mo, 1)))""")
def packed_datetime(spark, sf):
    raw = "((event_id * 7919) % 60) + ((event_id * 31) % 60) * 64 + (event_id % 24) * 4096 + (1 + event_id % 31) * 131072 + (event_id % 14) * 4194304 + (event_id % 64) * 67108864"
    rows = table(spark, sf, "events").selectExpr("event_id", f"cast({raw} as bigint) as raw")
    return rows.select("event_id", scalars.packed_datetime(F.col("raw")).alias("local")).where("local is not null")
