"""The driver's tables seen as evidence: fixed projections that make claims, recordings and frames of them.

Each projection is given twice, as a DataFrame here and as SQL text for the oracle, in integers throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000
SIZE = 100_000
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {0})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as evidence_id", "(l_partkey * 37) % 100000 as offset", "cast(floor(l_quantity) as bigint) * 10 as length",
        "case when l_returnflag = 'R' then 'unreadable' when l_returnflag = 'A' then 'structural' when l_linestatus = 'O' then 'parsed' else 'carved' end as bucket",
    )


def images(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey as evidence_id", f"cast({SIZE} as bigint) as size")


CLAIMS_SQL = f"""claim as (
  select l_suppkey as evidence_id, (l_partkey * 37) % 100000 as o, cast(floor(l_quantity) as bigint) * 10 as l,
         case when l_returnflag = 'R' then 'unreadable' when l_returnflag = 'A' then 'structural' when l_linestatus = 'O' then 'parsed' else 'carved' end as b
  from lineitem),
img as (select s_suppkey as evidence_id, cast({SIZE} as bigint) as size from supplier)"""


def segments(spark, sf_dir) -> DataFrame:
    start = MICROS.format("o_orderdate")
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 50 as evidence_id", "o_orderkey as recording_id", "case when o_orderkey % 29 = 0 then null else cast(o_custkey % 4 as int) end as channel",
        f"{start} as start_us", f"{start} + case when o_orderkey % 17 = 0 then -(o_orderkey % 5) else o_orderkey % 20 end * {DAY} as end_us",
        "(o_orderkey % 3) * 1000000 as uncertainty_us", "(o_orderkey * 7919) % 15013 as index_position", "cast(o_orderkey % 3 as string) as extent_key",
    )


SEGMENTS_SQL = f"""seg as (
  select o_custkey % 50 as evidence_id, o_orderkey as recording_id, case when o_orderkey % 29 = 0 then null else (o_custkey % 4)::int end as channel,
         epoch_us(o_orderdate) as s,
         epoch_us(o_orderdate) + case when o_orderkey % 17 = 0 then -(o_orderkey % 5) else o_orderkey % 20 end * {DAY} as e,
         (o_orderkey % 3) * 1000000 as u, (o_orderkey * 7919) % 15013 as p, (o_orderkey % 3)::varchar as x
  from orders)"""


def volumes(spark, sf_dir) -> DataFrame:
    """When each evidence's volume was formatted, and acquired."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey % 50 as evidence_id"
    ).distinct().selectExpr("evidence_id", f"(9300 + evidence_id * 10) * {DAY} as formatted_us", f"(11000 + evidence_id * 10) * {DAY} as acquired_us")


VOLUMES_SQL = f"""vol as (select distinct c_custkey % 50 as evidence_id, (9300 + (c_custkey % 50) * 10) * {DAY} as f, (11000 + (c_custkey % 50) * 10) * {DAY} as a from customer)"""


def frames(spark, sf_dir) -> DataFrame:
    """A user's events as the frames of a span: 100 bytes each, 50 missing after every seventh."""
    rows = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    local = MICROS.format("ts")
    return rows.selectExpr(
        "user_id % 8 as evidence_id", "user_id as span_id", "n * 100 + cast(floor(n / 7) as bigint) * 50 as offset", "cast(100 as bigint) as length",
        "case when event_id % 5 = 0 then 'I' when event_id % 11 = 0 then 'audio' else 'P' end as kind",
        "case when event_id % 19 = 0 then null else cast(cast(floor(n / 9) as bigint) % 3 as int) end as channel",
        f"case when event_id % 37 = 0 then null else {local} - case when event_id % 31 = 0 then 3600000000 else 0 end end as local_us",
        "n - case when n % 16 = 0 then 5 else 0 end as sequence", "case when event_id % 3 = 0 then null when event_id % 47 = 0 then 'h265' else 'h264' end as codec",
        f"cast(({local} / 1000) % 65536 as int) as tick", f"cast(floor({local} / 1000000) as bigint) as second", "event_id", "50 + event_id % 40 as payload_length",
    )


FRAMES_SQL = """ev as (select *, row_number() over (partition by user_id order by event_id) as n, epoch_us(ts) as t from events),
frame as (
  select user_id % 8 as evidence_id, user_id as span_id, n * 100 + floor(n / 7)::bigint * 50 as o, 100::bigint as l,
         case when event_id % 5 = 0 then 'I' when event_id % 11 = 0 then 'audio' else 'P' end as kind,
         case when event_id % 19 = 0 then null else (floor(n / 9)::bigint % 3)::int end as channel,
         case when event_id % 37 = 0 then null else t - case when event_id % 31 = 0 then 3600000000 else 0 end end as local_us,
         n - case when n % 16 = 0 then 5 else 0 end as sequence,
         case when event_id % 3 = 0 then null when event_id % 47 = 0 then 'h265' else 'h264' end as codec,
         (t // 1000) % 65536 as tick, floor(t / 1000000)::bigint as second, event_id, 50 + event_id % 40 as payload_length
  from ev)"""
