"""Queries over case records held against their SQL at ten times the scale of the other tests, and edge cases of scale."""

from collections import Counter

import duckdb
import pytest

from tools.compare import TABLES, plain
from tracewell.plans import registry

SF = "/root/testdata/sf0.01"

NAMES = ["audit_chain_head", "audit_verify", "sync_gaps", "signature_scan", "frame_scan", "latest_params", "orphan_checks", "carved_recordings", "negative_findings", "severity_summary", "case_progress", "custody_breaks", "findings_document", "recovery_gain", "open_steps", "dup_windows", "motion_segments"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_reads_every_row(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_orders_of_any_number_are_formatted(spark, tmp_path):
    rows = spark.sql("select * from values (1023L, timestamp_ntz'2024-01-02 03:04:05'), (2000000L, timestamp_ntz'2024-01-02 03:04:05') as v(o_orderkey, o_orderdate)")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.QUERIES["formatted"](spark, str(tmp_path)).collect()
    assert {(r.o_orderkey, r.iso, r.size) for r in got} == {(1023, "2024-01-02T03:04:05", "1023 B"), (2000000, "2024-01-02T03:04:05", "1.9 MiB")}
