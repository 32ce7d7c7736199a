"""Every query by name, and the SQL that checks it."""

from __future__ import annotations

from . import queries_bytes, queries_case, queries_time

QUERIES = {**queries_bytes.QUERIES, **queries_time.QUERIES, **queries_case.QUERIES}
ORACLES = {**queries_bytes.ORACLES, **queries_time.ORACLES, **queries_case.ORACLES}
