"""Queries over recordings, clocks, frames and motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomalies, flows, frames, motion, timeline
from ..sources import export
from . import tables as t
from .tables import DAY, FRAMES_SQL, MICROS, SEGMENTS_SQL, VOLUMES_SQL, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- gaps -------------------------------------------------------------------------------
_RANKED = f"with {SEGMENTS_SQL}, n as (select *, row_number() over (partition by evidence_id, channel order by s, e, recording_id) as i from seg)"


@query(_RANKED + """ select a.evidence_id, a.channel, a.e + a.u as gap_start_us, b.s - b.u as gap_end_us, a.u + b.u as uncertainty_us, a.recording_id as after_id, b.recording_id as before_id
from n a join n b on a.evidence_id = b.evidence_id and a.channel is not distinct from b.channel and b.i = a.i + 1 where (b.s - b.u) - (a.e + a.u) >= 1000000""")
def channel_gaps(spark, sf):
    return timeline.channel_gaps(t.segments(spark, sf))


@query(f"""with {SEGMENTS_SQL}, ok as (select * from seg where e >= s),
reach as (select *, max(e) over (partition by evidence_id order by s, e rows between unbounded preceding and 1 preceding) as r from ok)
select evidence_id, r as gap_start_us, s as gap_end_us from reach where s > r""")
def covered_gaps(spark, sf):
    return timeline.covered_gaps(t.segments(spark, sf).where("end_us >= start_us"), ["evidence_id"])


@query(f"""with {SEGMENTS_SQL}, few as (select * from seg where e >= s),
span as (select evidence_id, count(*) as n, max(a) as lo, min(z) as hi, max(u) as u from (select evidence_id, channel, min(s) as a, max(e) as z, max(u) as u from few group by all) group by evidence_id having count(*) >= 2 and min(z) > max(a)),
stop as (select evidence_id, s as b from few union select evidence_id, hi from span),
gap as (select span.evidence_id, u, greatest(lo, coalesce((select max(e) from few f where f.evidence_id = span.evidence_id and f.s < b), lo)) as x, least(b, hi) as y
        from span join stop using (evidence_id) where b > lo)
select distinct evidence_id, x + u as gap_start_us, y - u as gap_end_us, 2 * u as uncertainty_us from gap where (y - u) - (x + u) >= 1000000""")
def sync_gaps(spark, sf):
    return timeline.synchronised_gaps(t.segments(spark, sf).where("end_us >= start_us"))


@query(f"""with {SEGMENTS_SQL}, r as (select *, case when evidence_id % 3 = 0 and recording_id % 2 = 0 then s - 60000000 end as rs, case when evidence_id % 3 = 0 and recording_id % 2 = 0 then e - 60000000 end as re from seg),
b as (select *, case when bool_or(rs is not null) over (partition by evidence_id) then 'reference' else 'device' end as basis from r)
select recording_id, basis, case when basis = 'reference' then rs else s end as start_us, case when basis = 'reference' then re else e end as end_us,
       coalesce(case when basis = 'reference' then re >= rs else e >= s end, false) as placed from b""")
def gap_basis(spark, sf):
    known = "evidence_id % 3 = 0 and recording_id % 2 = 0"
    rows = t.segments(spark, sf).selectExpr("evidence_id", "recording_id", "start_us as local_start_us", "end_us as local_end_us", f"case when {known} then start_us - 60000000 end as ref_start_us", f"case when {known} then end_us - 60000000 end as ref_end_us")
    return timeline.gap_basis(rows).select("recording_id", "basis", "start_us", "end_us", "placed")


# --- anomalies --------------------------------------------------------------------------
def _flat(df):
    return df.withColumn("recording_ids", F.array_join(F.transform("recording_ids", lambda x: x.cast("string")), ","))


_PAIR = "a.evidence_id, '{kind}' as kind, a.channel, a.recording_id || ',' || b.recording_id as recording_ids, {seconds} / 1000000.0::double as seconds, 2::bigint as count"
_DUPLICATE = f"select {_PAIR.format(kind='duplicate_window', seconds='(least(a.e, b.e) - b.s)::double')} from d a join d b on a.evidence_id = b.evidence_id and a.channel is not distinct from b.channel and b.i = a.i + 1 where b.s < a.e and not (a.x = b.x and a.x != '')"
_BACKWARDS = f"select {_PAIR.format(kind='backwards_sequence', seconds='(a.s - b.s)::double')} from k a join k b on a.evidence_id = b.evidence_id and a.channel is not distinct from b.channel and b.i = a.i + 1 where b.s < a.s"
_MANY = """select evidence_id, '{kind}' as kind, null::int as channel, string_agg(recording_id, ',' order by {order}recording_id) filter (where i <= 20) as recording_ids, max({seconds})::double as seconds, count(*) as count
from (select *, row_number() over (partition by evidence_id order by {order}recording_id) as i from seg {join} where {where}) group by evidence_id"""
_BEFORE = _MANY.format(kind="before_volume_format", order="s, ", seconds="(f - s)::double / 1000000", join="join vol using (evidence_id)", where="s < f")
_FUTURE = _MANY.format(kind="future_dated", order="s, ", seconds="(s - a)::double / 1000000", join="join vol using (evidence_id)", where="s > a")
_ZERO = _MANY.format(kind="zero_length", order="", seconds="0.0", join="", where="s = e")
_ENDS = _MANY.format(kind="ends_before_start", order="", seconds="(s - e)::double / 1000000", join="", where="e < s")
_ORDERED = f"{_RANKED}, d as (select *, row_number() over (partition by evidence_id, channel order by s, e, recording_id) as i from seg where s <= e), k as (select *, row_number() over (partition by evidence_id, channel order by p, recording_id) as i from seg), {VOLUMES_SQL} "


@query(_ORDERED + _DUPLICATE)
def dup_windows(spark, sf):
    return _flat(anomalies.duplicate_windows(t.segments(spark, sf)))


@query(_ORDERED + _BACKWARDS)
def backwards_seq(spark, sf):
    return _flat(anomalies.backwards_sequence(t.segments(spark, sf)))


@query(_ORDERED + _BEFORE)
def before_format(spark, sf):
    return _flat(anomalies.before_volume_format(t.segments(spark, sf), t.volumes(spark, sf)))


@query(_ORDERED + _FUTURE)
def future_dated(spark, sf):
    return _flat(anomalies.future_dated(t.segments(spark, sf), t.volumes(spark, sf)))


@query(_ORDERED + _ZERO)
def zero_length(spark, sf):
    return _flat(anomalies.zero_length(t.segments(spark, sf)))


@query(_ORDERED + _ENDS)
def ends_before_start(spark, sf):
    return _flat(anomalies.ends_before_start(t.segments(spark, sf)))


ANOMALIES_SQL = _ORDERED + " union all ".join((_DUPLICATE, _BACKWARDS, _BEFORE, _FUTURE, _ZERO, _ENDS))


@query(ANOMALIES_SQL)
def anomalies_all(spark, sf):
    return _flat(anomalies.detect(t.segments(spark, sf), t.volumes(spark, sf)))


# --- clocks -----------------------------------------------------------------------------
#: Two offsets for each device: until the 12th day of the month of events, and from the 14th on; nothing in between.
_D0, _D1 = 19734 * DAY, 19736 * DAY
_CLOCK_SQL = f"""clock as (select distinct user_id % 8 as evidence_id from events),
cs as (select evidence_id, (evidence_id * 37 + 5) * 1000000 as off, 1.0::double + evidence_id % 3 as u, 'A_ntp' as m, null::bigint as f, {_D0}::bigint as z from clock
       union all select evidence_id, -(evidence_id * 11 + 1) * 1000000, 30.0::double, 'C_external_event', {_D1}, null from clock where evidence_id % 4 != 3)"""


def _observations(spark, sf):
    e = table(spark, sf, "events").selectExpr("user_id % 8 as evidence_id").distinct()
    first = e.selectExpr("evidence_id", "'A_ntp' as method", f"{_D0 - DAY} + (evidence_id * 37 + 5) * 1000000 as device_local_us", f"{_D0 - DAY} as true_utc_us", "cast(1.0 + evidence_id % 3 as double) as uncertainty_s", "cast(null as bigint) as valid_from_us", f"{_D0} as valid_to_us")
    second = e.where("evidence_id % 4 != 3").selectExpr("evidence_id", "'C_external_event' as method", f"{_D1 + DAY} - (evidence_id * 11 + 1) * 1000000 as device_local_us", f"{_D1 + DAY} as true_utc_us", "cast(30.0 as double) as uncertainty_s", f"{_D1} as valid_from_us", "cast(null as bigint) as valid_to_us")
    return timeline.clock_segments(timeline.observe(first.unionByName(second)))


_NORMAL_SQL = f"""{FRAMES_SQL}, {_CLOCK_SQL},
norm as (select event_id, frame.evidence_id, frame.channel, local_us, local_us - off as utc_us, u as uncertainty_s, coalesce(m, 'none') as method,
  case when local_us is null then 'no device time on this item' when m is null then 'no offset evidence covers this device time' end as reason
  from frame left join cs on cs.evidence_id = frame.evidence_id and local_us >= coalesce(f, local_us) and (z is null or local_us < z))"""


@query(f"with {_NORMAL_SQL} select event_id, utc_us, uncertainty_s, method, reason from norm")
def clock_normalise(spark, sf):
    rows = t.frames(spark, sf).select("event_id", "evidence_id", "local_us")
    return timeline.normalise(rows, _observations(spark, sf)).select("event_id", "utc_us", "uncertainty_s", "method", "reason")


@query(f"""with {_CLOCK_SQL} select evidence_id, case when off < 0 then '-' else '+' end || printf('%02d:%02d:%02d', (abs(off) // 3600000000)::bigint, (abs(off) // 60000000 % 60)::bigint, (abs(off) // 1000000 % 60)::bigint) as clock_error from cs""")
def clock_offsets(spark, sf):
    return _observations(spark, sf).select("evidence_id", timeline.format_offset(F.col("offset_us") / 1_000_000).alias("clock_error"))


@query(f"""with {_NORMAL_SQL}, o as (select event_id, evidence_id, utc_us, uncertainty_s, row_number() over (partition by evidence_id order by event_id) as i from norm)
select a.event_id, case when a.utc_us is null or b.utc_us is null then 'not_determinable' when abs(a.utc_us - b.utc_us) <= (a.uncertainty_s + b.uncertainty_s) * 1000000 then 'not_determinable'
  when a.utc_us < b.utc_us then 'before' else 'after' end as ordering from o a join o b on a.evidence_id = b.evidence_id and b.i = a.i + 1""")
def uncertain_ordering(spark, sf):
    from pyspark.sql import Window

    rows = timeline.normalise(t.frames(spark, sf).select("event_id", "evidence_id", "local_us"), _observations(spark, sf))
    rows = rows.withColumn("u", F.col("uncertainty_s") * 1_000_000)
    rows = rows.withColumn("b", F.lead(F.struct("utc_us", "u", F.lit(1).alias("there"))).over(Window.partitionBy("evidence_id").orderBy("event_id"))).where("b is not null")
    return rows.select("event_id", timeline.ordering(F.col("utc_us"), F.col("u"), F.col("b.utc_us"), F.col("b.u")).alias("ordering"))


#: A clock for two items of three, bounded for one of them: recordings that cross its bound lose one side.
_REC_SQL = f"""{SEGMENTS_SQL}, clk as (select distinct evidence_id, (evidence_id * 37 + 5) * 1000000 as off, 1.0::double + evidence_id % 5 as cu, case when evidence_id % 3 = 1 then {9500 * DAY}::bigint end as z from seg where evidence_id % 3 != 2),
rn as (select recording_id, seg.evidence_id, channel, case when recording_id % 7 = 0 then null else s end as ls, e as le, off, cu, z from seg left join clk using (evidence_id)),
ref as (select *, case when ls < coalesce(z, ls + 1) then ls - off end as rs, case when le < coalesce(z, le + 1) then le - off end as re from rn),
nm as (select *, rs is not null and re is not null as known from ref)"""


def _recordings(spark, sf):
    rows = t.segments(spark, sf).selectExpr("evidence_id", "recording_id", "channel", "case when recording_id % 7 = 0 then null else start_us end as local_start_us", "end_us as local_end_us")
    clocks = t.segments(spark, sf).select("evidence_id").distinct().where("evidence_id % 3 != 2").selectExpr(
        "evidence_id", "'A_ntp' as method", "(evidence_id * 37 + 5) * 1000000 as device_local_us", "cast(0 as bigint) as true_utc_us", "cast(1.0 + evidence_id % 5 as double) as uncertainty_s",
        "cast(null as bigint) as valid_from_us", f"case when evidence_id % 3 = 1 then cast({9500 * DAY} as bigint) end as valid_to_us",
    )
    return rows, clocks


@query(f"with {_REC_SQL} select recording_id, rs as ref_start_us, re as ref_end_us, case when known then cu end as uncertainty_s, case when known then 'A_ntp' else 'none' end as t_method from nm")
def renormalised(spark, sf):
    rows, clocks = _recordings(spark, sf)
    return flows.set_offset(clocks.where("false"), clocks, rows)[1].select("recording_id", "ref_start_us", "ref_end_us", "uncertainty_s", "t_method")


@query(f"with {_REC_SQL} select evidence_id, count(*) filter (where known) as normalised, count(*) filter (where not known) as refused from nm group by evidence_id")
def offset_summary(spark, sf):
    rows, clocks = _recordings(spark, sf)
    return flows.set_offset(clocks.where("false"), clocks, rows)[2]


@query(f"""with {_REC_SQL} select evidence_id, channel, row_number() over (partition by evidence_id, channel order by rs, re, recording_id) as position, recording_id, rs as start_us, re as end_us, cu as uncertainty_s
from nm where known and re >= rs""")
def correlate_lanes(spark, sf):
    rows, clocks = _recordings(spark, sf)
    return flows.timeline_data(rows, timeline.clock_segments(timeline.observe(clocks)))[0]


@query(f"""with {_REC_SQL} select evidence_id, channel, recording_id, case when ls is null then 'no device time on this item' when rs is null or re is null then 'no offset evidence covers this device time' else 'normalised end is before start' end as reason
from nm where not known or re < rs""")
def timeline_unplaced(spark, sf):
    rows, clocks = _recordings(spark, sf)
    return flows.timeline_data(rows, timeline.clock_segments(timeline.observe(clocks)))[1]


_BASIS_SQL = f"""{_REC_SQL}, bs as (select *, bool_or(rs is not null) over (partition by evidence_id) as has from nm),
ax as (select *, case when has then 'reference' else 'device' end as basis, case when has then rs else ls end as a, case when has then re else le end as b, case when known then cu * 1000000 else 0 end::bigint as u from bs)"""


@query(f"""with {_BASIS_SQL}, o as (select *, row_number() over (partition by evidence_id, channel order by a, b, recording_id) as i from ax where b >= a)
select p.evidence_id, p.basis, p.channel, p.b + p.u as gap_start_us, q.a - q.u as gap_end_us, p.u + q.u as uncertainty_us, p.recording_id as after_id, q.recording_id as before_id
from o p join o q on p.evidence_id = q.evidence_id and p.channel is not distinct from q.channel and q.i = p.i + 1 where (q.a - q.u) - (p.b + p.u) >= 1000000""")
def gap_report(spark, sf):
    rows, clocks = _recordings(spark, sf)
    gaps, _ = flows.gap_report(flows.set_offset(clocks.where("false"), clocks, rows)[1])
    return gaps.where("kind = 'channel'").drop("kind")


@query(f"""with {_BASIS_SQL} select evidence_id, recording_id, channel, case when a is null or b is null then 'no ' || basis || ' time on this recording' else 'end is before start' end as reason from ax where a is null or b is null or b < a""")
def gap_not_placed(spark, sf):
    rows, clocks = _recordings(spark, sf)
    return flows.gap_report(flows.set_offset(clocks.where("false"), clocks, rows)[1])[1]


@query(f"""with {SEGMENTS_SQL} select recording_id, case when s is null then 'x' when e < s then 'normalised end is before start' end as unplaced from seg where e < s""")
def unplaced_recordings(spark, sf):
    rows = t.segments(spark, sf).withColumns({"start_u": F.col("uncertainty_us"), "end_u": F.col("uncertainty_us"), "start_reason": F.lit(None).cast("string"), "end_reason": F.lit(None).cast("string")})
    return timeline.placements(rows.drop("uncertainty_us")).where("unplaced is not null").select("recording_id", "unplaced")


# --- frames -----------------------------------------------------------------------------
_RUNS_SQL = f"""with {FRAMES_SQL},
g as (select *, lag(channel) over w as pc, lag(local_us) over w as pt, lag(sequence) over w as ps, lag(o + l) over w as pe from frame window w as (partition by span_id order by o)),
b as (select *, case when channel != pc then 'channel changed ' || pc || ' -> ' || channel when local_us < pt then 'timestamp ran backwards' when sequence < ps then 'sequence number ran backwards' when o > pe then 'byte gap of ' || (o - pe) end as why from g),
r as (select *, 1 + sum(case when why is not null then 1 else 0 end) over (partition by span_id order by o)::bigint as run from b),
k as (select *, min(case when kind = 'I' then o end) over (partition by span_id, run) as key from r),
x as (select span_id, any_value(evidence_id) as evidence_id, run, min(o) filter (where o >= key) as o, max(o + l) as e, count(distinct channel) filter (where o >= key) as nc, max(channel) filter (where o >= key) as c,
      count(distinct codec) filter (where o >= key) as nd, max(codec) filter (where o >= key) as d, arg_min(local_us, o) filter (where o >= key and local_us is not null) as s, arg_max(local_us, o) filter (where o >= key and local_us is not null) as z,
      count(*) filter (where o >= key) as frame_count, count(*) filter (where kind = 'I') as keyframes, coalesce(sum(l) filter (where o < key), 0)::bigint as trimmed_bytes from k where key is not null group by span_id, run),
y as (select x.*, coalesce(nx.why, 'end of span') as ended from x left join r nx on nx.span_id = x.span_id and nx.run = x.run + 1 and nx.why is not null),
runs as (select evidence_id, span_id, run, o as "offset", e - o as length, case when nc = 1 then c end as channel, case when nd = 1 then d else 'unknown' end as codec, s as start_us, z as end_us, frame_count, keyframes, trimmed_bytes, ended from y)"""


@query(_RUNS_SQL + " select * from runs")
def frame_runs(spark, sf):
    return frames.runs(t.frames(spark, sf))


@query(_RUNS_SQL + """ select evidence_id, row_number() over (partition by evidence_id order by "offset", run, span_id) as position, 'T3' as tier, frame_count, keyframes,
  case when frame_count <= 1 then 0.2 when start_us is not null and channel is not null and keyframes >= 2 then 0.9 when start_us is not null then 0.7 else 0.4 end::double as confidence from runs""")
def carved_recordings(spark, sf):
    made = frames.carved_recordings(frames.runs(t.frames(spark, sf)))
    return made.select("evidence_id", F.col("position").cast("long").alias("position"), "tier", "frame_count", "keyframes", "confidence")


@query(f"""with {FRAMES_SQL}, q as (select event_id, span_id, o, tick, case when event_id % 9 = 0 then null else second end as sec from frame),
s as (select *, (tick - lag(tick) over w + 65536) % 65536 as step, last_value(sec ignore nulls) over (partition by span_id order by o rows between unbounded preceding and 1 preceding) as known from q window w as (partition by span_id order by o)),
d as (select *, case when step is null then tick else step + coalesce(round_even(((sec - known) * 1000 - step) / 65536.0, 0), 0)::bigint * 65536 end as delta from s)
select event_id, sum(delta) over (partition by span_id order by o)::bigint as pts_ms from d""")
def tick_unwrap(spark, sf):
    rows = t.frames(spark, sf).selectExpr("event_id", "span_id", "offset", "tick", "case when event_id % 9 = 0 then null else second end as seconds")
    return frames.unwrapped_ticks(rows, ["span_id"]).select("event_id", "pts_ms")


@query(f"""with {FRAMES_SQL}, g as (select *, sum(case when o != pe then 1 else 0 end) over (partition by span_id order by o) as gap from (select *, lag(o + l) over (partition by span_id order by o) as pe from frame)),
v as (select *, case when kind in ('I', 'P', 'B') then local_us end as vt from g),
b as (select *, last_value(vt ignore nulls) over (partition by span_id, gap, channel order by o rows between unbounded preceding and 1 preceding) as before from v),
s as (select *, sum(case when vt < before or vt > before + 7200000000 then 1 else 0 end) over (partition by span_id, gap, channel order by o) as part from b)
select span_id, channel, min(o) as "offset", sum(l)::bigint as size_bytes, count(*) filter (where kind in ('I', 'P', 'B')) as frame_count, arg_min(vt, o) filter (where vt is not null) as start_us, arg_max(vt, o) filter (where vt is not null) as end_us,
       arg_min(kind, o) filter (where kind in ('I', 'P', 'B')) as first_kind from s group by span_id, gap, channel, part having count(*) filter (where kind in ('I', 'P', 'B')) > 0""")
def channel_segments(spark, sf):
    return frames.channel_segments(t.frames(spark, sf), ["span_id"], 7_200_000_000)


_ENTRIES = f"case when c_custkey % 7 = 0 then null else cast(c_custkey % 3 as int) end as channel"


@query(f"""with {FRAMES_SQL}, ent as (select c_custkey as entry_id, c_custkey % 8 as evidence_id, case when c_custkey % 7 = 0 then null else (c_custkey % 3)::int end as ch,
  case when c_custkey % 5 != 0 then {19723 * DAY}::bigint end as lo, case when c_custkey % 5 in (1, 2) then ({19723 * DAY} + (c_custkey % 30) * {DAY})::bigint end as hi from customer),
h as (select *, row_number() over (partition by span_id order by o) as i from frame),
f as (select entry_id, count(*) as n, count(distinct channel) as nc, max(channel) as c, count(local_us) as nt, count(*) filter (where local_us < lo or local_us > hi) as bad from ent join h on h.span_id = ent.entry_id and h.i <= 8 group by entry_id),
c as (select ent.*, n, case when n is null then 'fail' else 'pass' end as structure_check,
  case when n is null then null when nc = 0 or ch is null then 'inapplicable' when nc = 1 and c = ch then 'pass' else 'fail' end as channel_check,
  case when n is null then null when nt = 0 or (lo is null and hi is null) then 'inapplicable' when bad = 0 then 'pass' else 'fail' end as time_check from ent left join f using (entry_id))
select entry_id, structure_check, channel_check, time_check, structure_check = 'pass' and coalesce(channel_check, '') != 'fail' and coalesce(time_check, '') != 'fail' as trusted,
  case when structure_check = 'pass' and channel_check != 'fail' and time_check != 'fail' then 'T2' else 'T3' end as tier from c""")
def orphan_checks(spark, sf):
    entries = table(spark, sf, "customer").selectExpr(
        "c_custkey as entry_id", "c_custkey % 8 as evidence_id", _ENTRIES, f"case when c_custkey % 5 != 0 then cast({19723 * DAY} as bigint) end as start_us",
        f"case when c_custkey % 5 in (1, 2) then {19723 * DAY} + (c_custkey % 30) * {DAY} end as end_us", "cast(0.6 as double) as confidence",
    )
    seen = t.frames(spark, sf).selectExpr("span_id % 8 as evidence_id", "span_id as entry_id", "offset", "channel", "local_us")
    return frames.orphan_checks(entries, seen).select("entry_id", "structure_check", "channel_check", "time_check", "trusted", "tier")


@query(f"""with {FRAMES_SQL}, v as (select * from frame where kind in ('I', 'P', 'B') and channel = 1)
select event_id, row_number() over w - 1 as n, coalesce(sum(payload_length) over (partition by span_id order by o rows between unbounded preceding and 1 preceding), 0)::bigint as es_offset from v window w as (partition by span_id order by o)""")
def frame_index(spark, sf):
    made = export.frame_index(t.frames(spark, sf), ["span_id"], channel=1)
    return made.select("event_id", F.col("n").cast("long").alias("n"), "es_offset")


@query(f"""with {FRAMES_SQL}, v as (select *, local_us // 1000 as pts, row_number() over (partition by span_id order by o) as n from frame where kind in ('I', 'P', 'B')),
b as (select *, lag(pts) over (partition by span_id order by n) as last from v)
select distinct span_id, 'presentation times do not rise' as problem from b where pts <= last
union all select span_id, 'payloads do not add up to the stream' from (select span_id, sum(payload_length) as total from v group by span_id) where span_id % 5 = 0""")
def remux_problems(spark, sf):
    index = export.frame_index(t.frames(spark, sf).withColumn("pts_ms", F.floor(F.col("local_us") / 1000)), ["span_id"])
    sizes = index.groupBy("span_id").agg(F.sum("payload_length").alias("total")).selectExpr("span_id", "total + case when span_id % 5 = 0 then 1 else 0 end as es_bytes")
    return export.remux_problems(index, ["span_id"], sizes)


# --- motion -----------------------------------------------------------------------------
_GRAY_SQL = """gray as (select label as recording_id, vec_id, list_transform(embedding, lambda x: floor((x::double + 1) * 100)::int) as px from embeddings),
adj as (select *, lag(px) over (partition by recording_id order by vec_id) as before from gray),
moved as (select recording_id, vec_id, list_filter(range(0, 64), lambda i: abs(px[i + 1] - before[i + 1]) >= 25) as m, before is not null as has from adj),
diff as (select recording_id, vec_id as frame_no, case when has then len(m) else 0 end as changed, case when has then m else [] end as m from moved)"""


def _gray(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("recording_id"), F.col("vec_id").alias("frame_no"), F.lit(8).alias("width"), F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 100).cast("int")).alias("pixels")
    )


@query(f"""with {_GRAY_SQL} select recording_id, frame_no, changed, list_min(list_transform(m, lambda i: i % 8))::int as x0, list_min(list_transform(m, lambda i: i // 8))::int as y0,
  list_max(list_transform(m, lambda i: i % 8))::int + 1 as x1, list_max(list_transform(m, lambda i: i // 8))::int + 1 as y1 from diff""")
def motion_diff(spark, sf):
    return motion.differences(_gray(spark, sf))


@query(f"""with {_GRAY_SQL}, f as (select *, changed >= 8 as motion, case when changed >= 8 then round(least(1.0, changed / (0.15::double * 64)), 4) else 0.0 end as score, row_number() over (partition by recording_id order by frame_no) as i from diff),
mo as (select *, case when i - lag(i) over (partition by recording_id order by i) - 1 <= 2 then 0 else 1 end as new from f where motion),
se as (select *, sum(new) over (partition by recording_id order by i) as s from mo)
select recording_id, min(frame_no) as first_frame, max(frame_no) as last_frame, count(*) as motion_frames, max(score)::double as peak from se group by recording_id, s having count(*) >= 2""")
def motion_segments(spark, sf):
    changes = motion.differences(_gray(spark, sf))
    return motion.motion_segments(motion.motion_frames(changes, 64, 8), 2, 2)


@query(f"""with {_GRAY_SQL} select recording_id, frame_no, 'motion' as label, [list_min(list_transform(m, lambda i: i % 8)), list_min(list_transform(m, lambda i: i // 8)), list_max(list_transform(m, lambda i: i % 8)) + 1 - list_min(list_transform(m, lambda i: i % 8)), list_max(list_transform(m, lambda i: i // 8)) + 1 - list_min(list_transform(m, lambda i: i // 8))]::varchar as bbox,
  round(least(1.0, changed / (0.15::double * 64)), 4) as score, 'changed_pixels=' || changed as note from diff where changed >= 8""")
def motion_annotations(spark, sf):
    changes = motion.motion_frames(motion.differences(_gray(spark, sf)), 64, 8)
    return motion.annotations(changes).drop("disclaimer").withColumn("bbox", F.concat(F.lit("["), F.array_join(F.transform("bbox", lambda x: x.cast("string")), ", "), F.lit("]")))
