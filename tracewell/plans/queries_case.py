"""Queries over a case's records: integrity, identification, findings and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import findings, identify, integrity, report
from . import queries_bytes, queries_time
from . import tables as t
from .tables import DAY, FRAMES_SQL, MICROS, SEGMENTS_SQL, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- chains -----------------------------------------------------------------------------
#: Events of each user as a chain: content is the event's type and number.
_CHAIN_SQL = """ev as (select user_id, event_id, event_type || ':' || event_id as content, row_number() over (partition by user_id order by event_id) as i from events),
chain as (
  with recursive c(user_id, i, event_id, content, prev, digest) as (
    select user_id, i, event_id, content, repeat('0', 64), sha256(repeat('0', 64) || content) from ev where i = 1
    union all select ev.user_id, ev.i, ev.event_id, ev.content, c.digest, sha256(c.digest || ev.content) from c join ev on ev.user_id = c.user_id and ev.i = c.i + 1)
  select * from c)"""


def _contents(spark, sf):
    return table(spark, sf, "events").selectExpr("user_id", "event_id", "concat(event_type, ':', cast(event_id as string)) as content")


@query(f"with {_CHAIN_SQL} select user_id, arg_max(digest, i) as head, count(*) as records from chain group by user_id")
def audit_chain_head(spark, sf):
    return integrity.fold_chain(_contents(spark, sf), "user_id", "event_id", "content")


def _records(spark, sf):
    """Stored chains, some spoilt: a content changed in users 1 mod 4, a record missing in users 2 mod 4."""
    rows = integrity.stored_chain(_contents(spark, sf), "user_id", "event_id", "content")
    rows = rows.where("not (user_id % 4 = 2 and i = 11)").selectExpr(
        "user_id as case_id", "cast(i - 1 as bigint) as seq", "case when user_id % 4 = 1 and i = 7 then 'tampered' else content end as content", "prev_digest", "digest",
        "format_string('%06d', event_id - case when i = 5 then 3000 else 0 end) as ts_utc", "case when i = 3 and user_id % 8 = 0 then 'odd' else 'ok' end as result",
    )
    return rows


@query(f"""with {_CHAIN_SQL}, n as (select user_id, max(i) as n from chain group by user_id),
v as (select user_id, n, case when user_id % 4 = 1 and n >= 7 then 6 when user_id % 4 = 2 and n > 11 then 10 else n - case when user_id % 4 = 2 and n = 11 then 1 else 0 end end::bigint as checked,
  case when user_id % 4 = 1 and n >= 7 then 6 when user_id % 4 = 2 and n > 11 then 11 end::bigint as broken_at from n),
row as (select user_id, i, i - 1 as seq, printf('%06d', event_id - case when i = 5 then 3000 else 0 end) as ts, i = 3 and user_id % 8 = 0 as odd from chain where not (user_id % 4 = 2 and i = 11)),
w as (select r.user_id, string_agg(x, '; ' order by x) as warnings from (
    select user_id, seq, unnest([case when odd then 'record ' || seq || ': unexpected result' end, case when ts < lag(ts) over (partition by user_id order by seq) then 'record ' || seq || ': earlier than the record before it' end]) as x from row) r
  join v using (user_id) where x is not null and r.seq < v.checked group by r.user_id)
select v.user_id as case_id, broken_at is null as ok, checked as records_checked, broken_at,
  case when v.user_id % 4 = 1 and n >= 7 then 'record 6: the digest does not match the content' when v.user_id % 4 = 2 and n > 11 then 'sequence break: expected 10, found 11' end as reason,
  coalesce(warnings, '') as warnings from v left join w using (user_id)""")
def audit_verify(spark, sf):
    return integrity.verify_chain(_records(spark, sf)).withColumn("warnings", F.array_join("warnings", "; "))


@query("""with recursive ev as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_type != 'view', event_id) - 1 as seq from events),
body as (select user_id, seq, '{"action":"' || event_type || '","hash_after":null,"hash_before":null,"operator":"examiner","params":{"event":' || event_id || '},"prev_digest":"' as head,
  '","result":"ok","seq":' || seq || ',"target":"' || user_id || '","ts_utc":"' || printf('%06d', event_id) || '"}' as tail from ev),
c(user_id, seq, digest) as (select user_id, seq, sha256(head || repeat('0', 64) || tail) from body where seq = 0
  union all select b.user_id, b.seq, sha256(head || c.digest || tail) from c join body b on b.user_id = c.user_id and b.seq = c.seq + 1)
select user_id as case_id, seq, digest from c""")
def audit_append(spark, sf):
    """Views are appended to empty chains, all other events to what these then hold."""
    rows = table(spark, sf, "events").selectExpr(
        "user_id as case_id", "event_id as n", "format_string('%06d', event_id) as ts_utc", "'examiner' as operator", "event_type as action", "cast(user_id as string) as target",
        "concat('{\"event\": ', event_id, '}') as params", "'ok' as result", "cast(null as string) as hash_before", "cast(null as string) as hash_after",
    )
    none = spark.createDataFrame([], "case_id long, seq long, digest string")
    first = integrity.append_records(none, rows.where("action = 'view'"))
    return first.unionByName(integrity.append_records(first, rows.where("action != 'view'"))).select("case_id", "seq", "digest")


@query("""select (event_id % 50)::varchar as target, arg_max(event_type, event_id) as params from events where event_type != 'view' group by 1""")
def latest_params(spark, sf):
    rows = table(spark, sf, "events").where("event_type != 'view'").selectExpr("1 as case_id", "'x' as action", "cast(event_id % 50 as string) as target", "event_type as params", "event_id as seq")
    return integrity.latest(rows, "x").select("target", "params")


@query("""select doc_id, case when doc_id % 10 = 3 then 'missing' else 'changed' end as problem from documents where doc_id % 10 = 3 or (doc_id % 10 = 4 and text is not null)""")
def manifest_check(spark, sf):
    docs = table(spark, sf, "documents")
    manifest = docs.where("text is not null or doc_id % 10 = 3").select(F.col("doc_id").alias("path"), F.sha2(F.concat("text", F.when(F.col("doc_id") % 10 == 4, "x").otherwise("")), 256).alias("sha256"))
    files = docs.where("doc_id % 10 != 3 and text is not null").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return integrity.manifest_problems(manifest, files).select(F.col("path").alias("doc_id"), "problem")


@query("""select event_id, '{"id":' || event_id || ',"kind":"' || event_type || '","user":' || user_id || '}' as body, sha256('{"id":' || event_id || ',"kind":"' || event_type || '","user":' || user_id || '}') as digest from events""")
def canonical_records(spark, sf):
    text = F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind"), F.col("event_id").alias("id")))
    body = table(spark, sf, "events").select("event_id", integrity.canonical_json(text).alias("body"))
    return body.withColumn("digest", F.sha2("body", 256))


# --- identification ---------------------------------------------------------------------
@query("""with i as (select page_id, length(html) * 8192 as size from pages), h as (select page_id, size, least(1048576, size) as he, greatest(0, size - 1048576) as ts from i),
w as (select page_id, he + floor(k * ((ts - he) / 32.0::double))::bigint as s, he, ts, (ts - he) / 32.0::double as step, k from h, range(0, 32) r(k) where ts > he),
kept as (select * from w where step >= 1048576 or k % ceil(1048576 / step)::bigint = 0)
select page_id as evidence_id, 'lba0' as region, 0::bigint as "offset", least(512, size)::bigint as length from h where size > 0
union all select page_id, 'head', 0, he from h where he > 0 union all select page_id, 'tail', ts, size - ts from h where size > ts
union all select page_id, 'sweep', s, least(1048576, ts - s) from kept""")
def probe_plan(spark, sf):
    images = table(spark, sf, "pages").selectExpr("page_id as evidence_id", "cast(length(html) as bigint) * 8192 as size")
    return identify.probe_plan(images)


@query("""select page_id as evidence_id, 3::int as "offset", 'NTFS boot sector' as description from pages where page_id % 4 = 0
union all select page_id, 0, 'XFS superblock' from pages where page_id % 6 = 0 union all select page_id, 510, 'MBR / boot-sector signature' from pages where page_id % 5 = 0""")
def magic_table(spark, sf):
    put = "overlay(overlay(overlay(repeat('00', 1200) placing case when page_id % 4 = 0 then hex('NTFS    ') else '0000000000000000' end from 7) placing case when page_id % 6 = 0 then hex('XFSB') || substr(case when page_id % 4 = 0 then hex('NTFS    ') else '0000000000000000' end, 3) else '000000' || case when page_id % 4 = 0 then hex('NTFS    ') else '0000000000000000' end end from 1) placing case when page_id % 5 = 0 then '55AA' else '0000' end from 1021)"
    heads = table(spark, sf, "pages").where("page_id % 12 != 0").selectExpr("page_id as evidence_id", f"unhex({put}) as head")
    both = table(spark, sf, "pages").where("page_id % 12 = 0").selectExpr("page_id as evidence_id", "unhex(repeat('00', 3) || hex('NTFS    ') || repeat('00', 499) || case when page_id % 5 = 0 then '55AA' else '0000' end) as head")
    first = table(spark, sf, "pages").where("page_id % 12 = 0").selectExpr("page_id as evidence_id", "unhex(hex('XFSB') || repeat('00', 600)) as head")
    return identify.observations(heads.unionByName(both).unionByName(first))


_CANDIDATE = "(doc_id * 13) % 7 < 3"


@query("""with c as (select doc_id, f.fam, f.conf from documents, (values ('alpha', 0.9::double, 3), ('beta', 0.5::double, 2), ('gamma', 0.99::double, 5)) f(fam, conf, m) where doc_id % m = 0),
g as (select doc_id, count(*) as n, any_value(fam) as fam, string_agg(fam, ',' order by conf desc, fam) as listed from c group by doc_id)
select d.doc_id as evidence_id, case when n is null then 'unknown' when n = 1 then 'identified' else 'ambiguous' end as status, case when n = 1 then fam end as family,
  case when n is null then 'none' when n > 1 then 'pending_selection' when fam = 'beta' then 'carve_only' else 'parse' end as support, coalesce(listed, '') as candidates from documents d left join g using (doc_id)""")
def identify_policy(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("doc_id as evidence_id")
    families = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(c).alias("confidence"), F.lit(m).alias("m"), F.lit(f != "beta").alias("parses")) for f, c, m in (("alpha", 0.9, 3), ("beta", 0.5, 2), ("gamma", 0.99, 5))]))
    found = docs.select("evidence_id", families.alias("f")).where("evidence_id % f.m = 0").select("evidence_id", "f.family", "f.confidence", F.lit(None).cast("string").alias("layout"), "f.parses")
    made = identify.identify(docs, found)
    return made.withColumn("candidates", F.array_join("candidates.family", ","))


# --- case tables of the driver's tables --------------------------------------------------
def _case(spark, sf):
    """evidence and the rest as the findings rules read them: 50 items, from customers and orders.

    Every claim is folded onto 40 of the items and every conversation onto 45, so that some have none; a conversation's
    turns follow those of the conversations before it."""
    items = table(spark, sf, "customer").selectExpr("c_custkey % 50 as evidence_id").distinct()
    gap = "array(named_struct('offset', cast(0 as bigint), 'length', cast(512 as bigint)))"
    evidence = items.selectExpr("evidence_id", "substr('ABCDE', cast(evidence_id % 5 as int) + 1, 1) as provenance_class", f"case when evidence_id % 9 = 0 then {gap} end as gaps", "case when evidence_id % 11 = 0 then 'stored hash mismatch' end as notes")
    identification = items.where("evidence_id % 6 != 5").selectExpr("evidence_id", "case evidence_id % 4 when 0 then 'unknown' when 1 then 'identified' when 2 then 'ambiguous' else 'identified' end as status", "case when evidence_id % 4 in (1, 3) or evidence_id % 8 = 2 then 'f' end as family", "evidence_id % 4 = 1 as parse_supported")
    recording = t.segments(spark, sf).selectExpr(
        "evidence_id", "recording_id", "channel", "concat('T', 1 + recording_id % 4) as tier", "case when recording_id % 13 != 0 then start_us end as local_start_us", "end_us as local_end_us",
        "case when evidence_id % 2 = 0 then 'none' when recording_id % 2 = 0 then 'A_ntp' end as t_method", "case when evidence_id % 2 = 1 and recording_id % 2 = 0 then start_us end as ref_start_us",
    )
    coverage = t.claims(spark, sf).withColumn("evidence_id", F.expr("pmod(evidence_id, 40)")).selectExpr("evidence_id", "case when evidence_id % 3 = 0 and bucket = 'unreadable' then 'unaccounted' else bucket end as bucket", "length")
    custody = table(spark, sf, "conversations").selectExpr("pmod(conv_id, 45) as evidence_id", "conv_id * 3000000 + turn as seq", "concat(role, ' ') as to_holder", "case when turn % 3 = 0 then upper(role) else 'assistant' end as from_holder", "case when turn % 4 = 1 then 0 when turn % 4 = 2 then null else 1 end as seal_intact")
    attachment = table(spark, sf, "nation").selectExpr("case when n_nationkey = 7 then null else cast(n_nationkey as bigint) end as evidence_id", "case n_nationkey % 3 when 0 then 'panchnama' when 1 then 'authorisation' else 'seizure_video' end as kind")
    return evidence, identification, recording, coverage, custody, attachment


_CASE_SQL = f"""{SEGMENTS_SQL}, item as (select distinct c_custkey % 50 as evidence_id from customer),
evid as (select evidence_id, substr('ABCDE', (evidence_id % 5 + 1)::int, 1) as cls from item),
ident as (select evidence_id, case evidence_id % 4 when 0 then 'unknown' when 1 then 'identified' when 2 then 'ambiguous' else 'identified' end as status, case when evidence_id % 4 in (1, 3) or evidence_id % 8 = 2 then 'f' end as family, evidence_id % 4 = 1 as parses from item where evidence_id % 6 != 5),
rec as (select evidence_id, recording_id, channel, 'T' || (1 + recording_id % 4) as tier, case when recording_id % 13 != 0 then s end as ls, e as le, case when evidence_id % 2 = 0 then 'none' when recording_id % 2 = 0 then 'A_ntp' end as m, case when evidence_id % 2 = 1 and recording_id % 2 = 0 then s end as rs from seg),
cov as (select l_suppkey % 40 as evidence_id, case when l_returnflag = 'R' then case when l_suppkey % 40 % 3 = 0 then 'unaccounted' else 'unreadable' end else 'x' end as bucket, floor(l_quantity)::bigint * 10 as length from lineitem),
cust as (select conv_id % 45 as evidence_id, conv_id * 3000000 + turn as seq, role as holder, case when turn % 3 = 0 then role else 'assistant' end as giver, case when turn % 4 = 1 then 0 when turn % 4 = 2 then null else 1 end as seal from conversations),
att as (select case when n_nationkey = 7 then null else n_nationkey end as evidence_id, case n_nationkey % 3 when 0 then 'panchnama' when 1 then 'authorisation' else 'seizure_video' end as kind from nation),
brk as (select * from (select *, lag(holder) over (partition by evidence_id order by seq) as expected from cust) where expected != giver),
want as (select evidence_id, unnest(case when cls in ('A', 'B') then ['panchnama', 'seizure_video', 'authorisation'] when cls = 'C' then ['panchnama', 'authorisation'] when cls = 'D' then ['authorisation'] else [] end) as kind from evid),
miss as (select * from want where not exists (select 1 from att where att.kind = want.kind and (att.evidence_id is null or att.evidence_id = want.evidence_id)))"""


@query(f"with {_CASE_SQL} select evidence_id, seq from brk")
def custody_breaks(spark, sf):
    return findings.custody_breaks(_case(spark, sf)[4]).select("evidence_id", "seq")


@query(f"with {_CASE_SQL} select evidence_id, string_agg(kind, ',' order by kind) as missing from miss group by evidence_id")
def missing_documents(spark, sf):
    evidence, *_, attachment = _case(spark, sf)
    return findings.missing_documents(evidence, attachment).withColumn("missing", F.array_join("missing", ","))


_ANOMALIES = queries_time.ANOMALIES_SQL.replace("with ", "", 1).split(" select ", 1)
_RULES_SQL = f"""
select evidence_id, 'NF-COVERAGE-UNACCOUNTED' as code, case when sum(length) filter (where bucket = 'unaccounted') >= 0.25 * sum(length) then 'attention' else 'info' end as severity, sum(length) filter (where bucket = 'unaccounted')::bigint as n from cov group by 1 having sum(length) filter (where bucket = 'unaccounted') > 0
union all select evidence_id, 'NF-COVERAGE-UNREADABLE', 'serious', sum(length)::bigint from cov where bucket = 'unreadable' group by 1 having sum(length) > 0
union all select evidence_id, 'NF-PROVENANCE-' || cls, case when cls = 'D' then 'serious' else 'attention' end, 1 from evid where cls in ('B', 'C', 'D')
union all select evidence_id, 'NF-BAD-SECTORS', 'serious', 1 from item where evidence_id % 9 = 0
union all select evidence_id, 'NF-EMBEDDED-HASH', 'serious', 1 from item where evidence_id % 11 = 0
union all select evidence_id, 'NF-NOT-IDENTIFIED', 'attention', 1 from item where evidence_id % 6 = 5
union all select evidence_id, 'NF-UNKNOWN-FORMAT', 'attention', 1 from ident where status = 'unknown' or family is null
union all select evidence_id, 'NF-CARVE-ONLY', 'attention', 1 from ident where status != 'unknown' and family is not null and not parses
union all select evidence_id, 'NF-AMBIGUOUS', 'attention', 1 from ident where status = 'ambiguous'
union all select evidence_id, 'NF-TIME-UNKNOWN', 'attention', count(*) from rec where ls is null group by 1
union all select evidence_id, 'NF-CHANNEL-UNKNOWN', 'info', count(*) from rec where channel is null group by 1
union all select evidence_id, 'NF-NO-CLOCK-OFFSET', 'serious', count(*) from rec group by 1 having count(*) = count(*) filter (where coalesce(m, 'none') = 'none')
union all select distinct evidence_id, 'NF-NO-RECOVERY', 'attention', 1 from rec where evidence_id not in (select evidence_id from cov)
union all select evidence_id, 'NF-NO-CUSTODY', 'serious', 1 from item where evidence_id not in (select evidence_id from cust)
union all select evidence_id, 'NF-SEAL-BROKEN', 'serious', count(*) from cust where seal = 0 and evidence_id in (from item) group by 1
union all select evidence_id, 'NF-NO-SEAL', 'attention', count(*) from cust where seal is null and evidence_id in (from item) group by 1
union all select evidence_id, 'NF-CUSTODY-GAP', 'serious', count(*) from brk where evidence_id in (from item) group by 1
union all select evidence_id, 'NF-MISSING-DOCUMENTS', 'attention', count(*) from miss group by 1
union all select evidence_id, 'NF-TIME-' || upper(replace(kind, '_', '-')), 'attention', "count" from anom"""
_RULES_SQL = f"with {_CASE_SQL}, anom as ({queries_time.ANOMALIES_SQL}), rule as ({_RULES_SQL})"


def _negative(spark, sf):
    from ..operators import anomalies

    return findings.negative_findings(*_case(spark, sf), anomalies.detect(t.segments(spark, sf), t.volumes(spark, sf)))


@query(_RULES_SQL + " select * from rule")
def negative_findings(spark, sf):
    return _negative(spark, sf)


@query(_RULES_SQL + " select count(*) as total, count(*) filter (where severity = 'serious') as serious, count(*) filter (where severity = 'attention') as attention, count(*) filter (where severity = 'info') as info from rule")
def severity_summary(spark, sf):
    return findings.severity_summary(_negative(spark, sf))


@query(f"""with {_CASE_SQL}, r as (select evidence_id, count(*) as recordings, count(*) filter (where tier = 'T1') as t1, count(*) filter (where tier = 'T2') as t2, count(*) filter (where tier = 'T3') as t3, count(*) filter (where tier = 'T4') as t4, count(ls) as with_device_time, count(rs) as with_reference_time from rec group by 1),
cu as (select evidence_id, count(*) as c from cust group by 1), cv as (select distinct evidence_id from cov)
select item.evidence_id, status, family, case when status is null then null when family is null then case when status = 'ambiguous' then 'pending_selection' else 'none' end when parses then 'parse' else 'carve_only' end as support,
  coalesce(recordings, 0) as recordings, coalesce(t1, 0) as t1, coalesce(t2, 0) as t2, coalesce(t3, 0) as t3, coalesce(t4, 0) as t4, coalesce(with_device_time, 0) as with_device_time, coalesce(with_reference_time, 0) as with_reference_time,
  0::bigint as time_observations, coalesce(c, 0) as custody_entries, item.evidence_id % 6 != 5 as parsed, cv.evidence_id is not null as recovered
from item left join ident using (evidence_id) left join r using (evidence_id) left join cu using (evidence_id) left join cv using (evidence_id)""")
def case_progress(spark, sf):
    evidence, identification, recording, coverage, custody, _ = _case(spark, sf)
    return findings.case_progress(evidence, identification, recording, identification, custody.where("false"), custody, coverage)


@query(f"""with {_CASE_SQL} select evidence_id, coalesce(sum(case when tier = 'T1' and le > ls then le - ls end), 0)::double / 60000000 as t1_minutes, coalesce(sum(case when tier != 'T1' and le > ls then le - ls end), 0)::double / 60000000 as recovered_minutes, case when t1_minutes > 0 then round(100 * recovered_minutes / t1_minutes, 1) end as gain_pct from rec group by 1""")
def recovery_gain(spark, sf):
    return findings.recovery_gain(_case(spark, sf)[2])


@query(f"""with {_CASE_SQL}, anom as (select 1), b as (select evidence_id, string_agg('{{"expected":"' || expected || ' ","found":"' || case when seq % 3 = 0 then upper(giver) else giver end || '","seq":' || seq || '}}', ',' order by seq) as x from brk group by 1),
m as (select evidence_id, '{{"missing":["' || string_agg(kind, '","' order by kind) || '"]}}' as x from miss group by 1),
doc as (select evidence_id, '{{"documents":[' || coalesce(m.x, '') || '],"transfers":[' || coalesce(b.x, '') || ']}}' as document from b full join m using (evidence_id))
select evidence_id, length(document)::bigint as size from doc""")
def findings_document(spark, sf):
    """Its text is compared by size here (order of rows is by their text); tests compare it whole."""
    evidence, *_, custody, attachment = _case(spark, sf)
    made = findings.findings_document({"transfers": findings.custody_breaks(custody), "documents": findings.missing_documents(evidence, attachment)})
    return made.select("evidence_id", F.char_length("document").cast("long").alias("size"))


_REPORT_SQL = f"""{_CASE_SQL}, tot as (select evidence_id, bucket, sum(length)::bigint as bytes from cov_all group by all),
covering as (select evidence_id, '{{"' || string_agg(bucket || '":' || bytes, ',"' order by bucket) || '}}' as totals, sum(bytes)::bigint as covered from tot group by 1),
names as (select conv_id % 45 as evidence_id, conv_id * 3000000 + turn as seq, case when turn % 3 = 0 then upper(role) else 'assistant' end as giver, role || ' ' as holder, case when turn % 4 = 1 then '0' when turn % 4 = 2 then 'null' else '1' end as seal from conversations),
steps as (select *, lag(holder) over (partition by evidence_id order by seq) as expected from names),
said as (select evidence_id, string_agg('"entry ' || seq || ': given by ' || giver || ', last held by ' || expected || '"', ',' order by seq) as x from steps where lower(trim(expected)) != lower(trim(giver)) group by 1)"""


@query(f"""with {_REPORT_SQL.replace("cov_all", "(select l_suppkey % 40 as evidence_id, case when l_suppkey % 40 % 3 = 0 and l_returnflag = 'R' then 'unaccounted' when l_returnflag = 'R' then 'unreadable' when l_returnflag = 'A' then 'structural' when l_linestatus = 'O' then 'parsed' else 'carved' end as bucket, floor(l_quantity)::bigint * 10 as length from lineitem)")}
select 'coverage' as section, row_number() over (order by c.evidence_id) as position, c.evidence_id::varchar as evidence_id,
  '{{"covered_bytes":' || covered || ',"evidence_id":' || c.evidence_id || ',"image_size_bytes":' || size || ',"tiles_image":' || (covered = size)::varchar || ',"totals_bytes":' || totals || '}}' as body
from covering c join (select evidence_id, case when evidence_id % 2 = 0 then 100 else (select covered from covering v where v.evidence_id = item.evidence_id) end as size from item) i on i.evidence_id = c.evidence_id where size is not null
union all select 'custody', row_number() over (order by seq, n.evidence_id), n.evidence_id::varchar,
  '{{"chain_breaks":[' || coalesce(x, '') || '],"evidence_id":' || n.evidence_id || ',"from_holder":"' || giver || '","seal_intact":' || seal || ',"seq":' || seq || ',"to_holder":"' || holder || '"}}' from names n left join said using (evidence_id)
union all select 'time', 1, null, '{{"absolute_established":' || (count(rs) > 0)::varchar || ',"methods_used":["A_ntp"],"recordings_total":' || count(*) || ',"recordings_with_reference_time":' || count(rs) || '}}' from rec""")
def case_document(spark, sf):
    """Three of the document's sections, whole: the map's totals (half of the images are of another size), every transfer
    with the breaks of its chain, and what time was established."""
    evidence, _, recording, coverage, custody, _ = _case(spark, sf)
    sums = coverage.groupBy("evidence_id").agg(F.sum("length").alias("all"))
    sized = evidence.join(sums, "evidence_id").withColumn("capacity_bytes", F.when(F.col("evidence_id") % 2 == 0, 100).otherwise(F.col("all")))
    observed = spark.createDataFrame([("A_ntp",)], "method string")
    made = report.document({"coverage": report.coverage_section(sized, coverage), "custody": report.custody_section(custody), "time": report.time_section(recording, observed)})
    return made.drop("place")


@query(f"""select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as iso, case when o_orderkey < 1024 then o_orderkey || ' B' when o_orderkey < 1048576 then printf('%.1f KiB', o_orderkey / 1024.0::double) else printf('%.1f MiB', o_orderkey / 1048576.0::double) end as size from orders""")
def formatted(spark, sf):
    rows = table(spark, sf, "orders")
    return rows.select("o_orderkey", scalars.iso_local(F.col("o_orderdate")).alias("iso"), scalars.human_bytes(F.col("o_orderkey")).alias("size"))


@query("""select doc_id::varchar as artefact, case when doc_id % 4 = 3 or doc_id % 5 = 4 then 'WITHHELD - ' else '' end || case when doc_id % 2 = 0 then 'report' else 'findings' end as kind,
  case when doc_id % 4 = 3 or doc_id % 5 = 4 then '' else sha256(text) end as sha256, case when doc_id % 4 = 3 then 'gone' when doc_id % 5 = 4 then 'changed' else '' end as why from documents where text is not null and doc_id % 3 != 2""")
def tender_rows(spark, sf):
    from ..operators import certificate

    docs = table(spark, sf, "documents").where("text is not null")
    artefacts = docs.select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").cast("string").alias("path"), F.expr("case when doc_id % 3 = 2 then 'tool_log' when doc_id % 2 = 0 then 'report' else 'findings' end").alias("kind"), F.octet_length("text").cast("long").alias("size_bytes"))
    files = docs.where("doc_id % 4 != 3").select(F.col("doc_id").cast("string").alias("path"), F.concat("text", F.when(F.col("doc_id") % 5 == 4, "!").otherwise("")).alias("content"))
    made = certificate.tender_rows(artefacts, files)
    return made.select("artefact", "kind", "sha256", F.when(F.col("note").contains("not in"), "gone").when(F.col("note") != "", "changed").otherwise("").alias("why"))


@query(f"""with {_CASE_SQL}, p as (select item.evidence_id, status, case when family is not null and parses then 'parse' end as support, item.evidence_id in (select evidence_id from cov) as recovered,
  item.evidence_id in (select evidence_id from rec) as has, item.evidence_id in (select evidence_id from cust) as moved from item left join ident using (evidence_id))
select evidence_id, 'blocking' as weight, 'identify' as step from p where coalesce(status, '') != 'identified'
union all select evidence_id, 'serious', 'recover' from p where status = 'identified' and not recovered
union all select evidence_id, 'serious', 'time' from p where status = 'identified' and has
union all select evidence_id, 'serious', 'custody' from p where status = 'identified' and not moved""")
def open_steps(spark, sf):
    from ..operators import certificate

    return certificate.open_steps(case_progress(spark, sf))


@query(f"""with {SEGMENTS_SQL}, d as (select doc_id, doc_id % 50 as evidence_id, doc_id % 7 = 3 as gone from documents where text is not null),
n as (select count(*) filter (where not gone) as tendered, count(*) filter (where gone) as withheld from d), r as (select evidence_id, count(*) as recordings, count(distinct channel) as channels from seg group by 1)
select evidence_id, case when evidence_id % 3 = 0 then 'IEA_65B' else 'BSA_63' end as statute, case when evidence_id % 4 = 0 then 'SHA256' when evidence_id % 4 = 1 then 'MD5' when evidence_id % 4 = 2 then 'SHA256,MD5' else '' end as ticked,
  tendered + (select count(distinct c_custkey % 50) from customer where c_custkey % 50 % 2 = 0) as tendered, withheld + (select count(distinct c_custkey % 50) from customer where c_custkey % 50 % 2 != 0) as withheld,
  coalesce(recordings, 0) as recordings, coalesce(channels, 0) as channels, 'Disk make: M' || evidence_id || case when evidence_id % 5 != 0 then '; Disk serial: S' || evidence_id else '' end || '; Provenance class: A' as disk
from (select distinct c_custkey % 50 as evidence_id from customer) left join r using (evidence_id), n""")
def certificates(spark, sf):
    from ..operators import certificate

    evidence = table(spark, sf, "customer").selectExpr("c_custkey % 50 as evidence_id").distinct().selectExpr(
        "1 as case_id", "evidence_id", "cast(null as string) as source_path", "date'2024-06-30' + cast(case when evidence_id % 3 = 0 then 0 else 1 end as int) as instituted",
        "case when evidence_id % 4 in (1, 2) then 'm' end as md5", "case when evidence_id % 2 = 0 then 's' end as sha256", "concat('M', evidence_id) as disk_make", "'' as disk_model",
        "case when evidence_id % 5 != 0 then concat('S', evidence_id) end as disk_serial", "cast(0 as bigint) as capacity_bytes", "'A' as provenance_class",
    )
    docs = table(spark, sf, "documents").where("text is not null")
    artefacts = docs.select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").cast("string").alias("path"), F.lit("report").alias("kind"), F.octet_length("text").cast("long").alias("size_bytes"))
    files = docs.where("doc_id % 7 != 3").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    tenders = certificate.tender_rows(artefacts, files).withColumn("case_id", F.lit(1))
    images = evidence.withColumn("evidence_id", F.col("evidence_id").cast("string"))
    made = certificate.certificates(evidence, certificate.enclosures(images, tenders), t.segments(spark, sf).select("evidence_id", "channel"))
    return made.drop("case_id").withColumn("ticked", F.array_join("ticked", ","))


del _ANOMALIES, DAY, FRAMES_SQL, MICROS, queries_bytes, _CANDIDATE
