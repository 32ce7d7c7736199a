"""Integrity: canonical JSON, hash chains and their verification, content-addressed artefacts, manifests."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
#: What a record may state as its result.
RESULTS = ("started", "ok", "error")


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces, text unescaped, -0.0 as 0.0; NaN, infinities and other types are refused."""

    def plain(x: Any) -> Any:
        if x is None or isinstance(x, (str, bool, int)):
            return x
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("a number that is not finite has no canonical form")
            return x + 0.0 if x else 0.0
        if isinstance(x, dict):
            if not all(isinstance(k, str) for k in x):
                raise ValueError("a key that is not text has no canonical form")
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        raise ValueError(f"{type(x).__name__} is not a JSON type")

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _canonical_text(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return canonical(json.loads(t))
        except ValueError:
            return canonical({"unparsable_json": t})

    return text.map(one)


def canonical_json(text: Column) -> Column:
    """The canonical form of JSON text; null for null, and an object naming the text where it does not parse."""
    return F.pandas_udf(_canonical_text, "string")(text)


def record_digest(body: Column) -> Column:
    """SHA-256 of a record's canonical body."""
    return F.sha2(canonical_json(body), 256)


BODY = ("seq", "ts_utc", "operator", "action", "target", "params", "result", "hash_before", "hash_after", "prev_digest")


def body_json(params: str = "params") -> Column:
    """A record's body as JSON text from its columns; params holds JSON text."""
    quoted = lambda c: F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6), F.lit("null"))
    value = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.col(params) if c == params else quoted(c))
    parts = [F.concat(F.lit(f'"{c}":'), value(c)) for c in BODY]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _in_turn(records: DataFrame, key: str, order: str) -> DataFrame:
    """records with `place`, from 1 in each chain, and each chain whole and in order in one task.

    The window is what keeps a chain whole: a repartition by the key of a join before it is dropped as done already, and
    adaptive execution may then read the join's shuffle piece by piece. A window's needs are kept."""
    return records.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))


def fold_chain(records: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """key, head, records: each key's contents folded in order, digest = sha256(previous digest + content).

    A fold is sequential within its key; a chain of any length is folded as its rows stream by, sorted, in one task for
    each key, and many chains in parallel."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, head, n = None, GENESIS, 0
        for pdf in batches:
            out = []
            for k, text, place in zip(pdf[key], pdf[content], pdf["place"]):
                if place == 1:
                    if n:
                        out.append((now, head, n))
                    now, head, n = k, GENESIS, 0
                head = hashlib.sha256((head + text).encode()).hexdigest()
                n += 1
            yield pd.DataFrame(out, columns=[key, "head", "records"])
        if n:
            yield pd.DataFrame([(now, head, n)], columns=[key, "head", "records"])

    kind = records.schema[key].dataType.simpleString()
    rows = _in_turn(records.select(key, order, content), key, order)
    return rows.mapInPandas(fold, f"{key} {kind}, head string, records long")


def stored_chain(records: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """key, order, content, i, prev_digest, digest: each record beside its link and digest, i counting from 1 in its chain.

    Rows stream by as in fold_chain, and no chain is ever held whole."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = GENESIS
        for pdf in batches:
            before, after = [], []
            for text, place in zip(pdf[content], pdf["place"]):
                head = GENESIS if place == 1 else head
                before.append(head)
                head = hashlib.sha256((head + text).encode()).hexdigest()
                after.append(head)
            yield pdf.rename(columns={"place": "i"}).assign(prev_digest=before, digest=after)

    records = records.select(key, order, content)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema.fields)
    rows = _in_turn(records, key, order)
    return rows.mapInPandas(link, f"{kinds}, i long, prev_digest string, digest string")


def verify_chain(records: DataFrame, key: str = "case_id", digest_of: Column | None = None) -> DataFrame:
    """key, ok, records_checked, broken_at, reason, warnings of stored chains.

    records: key, seq, prev_digest, digest, ts_utc, result, and content that digest_of recomputes the digest from. Each
    row is checked against the row before it, so a chain is verified in parallel but for its order; at a row the
    sequence number is looked at first, then the link, then the content."""
    order = Window.partitionBy(key).orderBy("seq", "digest")
    rows = records.withColumns(
        {
            "expected": F.row_number().over(order) - 1,
            "link": F.coalesce(F.lag("digest").over(order), F.lit(GENESIS)),
            "last_ts": F.lag("ts_utc").over(order),
            "found": digest_of if digest_of is not None else F.sha2(F.concat("prev_digest", "content"), 256),
        }
    )
    text = F.col("seq").cast("string")
    reason = (
        F.when(F.col("seq") != F.col("expected"), F.concat(F.lit("sequence break: expected "), F.col("expected").cast("string"), F.lit(", found "), text))
        .when(F.col("prev_digest") != F.col("link"), F.concat(F.lit("record "), text, F.lit(": the link to the record before it does not match")))
        .when(F.coalesce(F.col("found") != F.col("digest"), F.lit(True)), F.concat(F.lit("record "), text, F.lit(": the digest does not match the content")))
    )
    rows = rows.withColumn("reason", reason)
    broken = F.min(F.when(F.col("reason").isNotNull(), F.col("expected"))).over(Window.partitionBy(key))
    rows = rows.withColumn("stop", broken)
    reached = F.col("stop").isNull() | (F.col("expected") < F.col("stop"))
    odd = F.when(~F.col("result").isin(*RESULTS), F.concat(F.lit("record "), text, F.lit(": unexpected result")))
    back = F.when(F.col("ts_utc") < F.col("last_ts"), F.concat(F.lit("record "), text, F.lit(": earlier than the record before it")))
    warned = F.when(reached, F.array_compact(F.array(odd, back)))
    return rows.groupBy(key).agg(
        F.max("stop").isNull().alias("ok"), F.count_if(reached).alias("records_checked"),
        F.max(F.when(F.col("expected") == F.col("stop"), F.col("seq"))).alias("broken_at"),
        F.max(F.when(F.col("expected") == F.col("stop"), F.col("reason"))).alias("reason"),
        F.array_sort(F.flatten(F.collect_list(warned))).alias("warnings"),
    )


def operation_records(operations: DataFrame) -> DataFrame:
    """The two records of each operation for append_records: it started; then that it is complete, or its error.

    operations: case_id, n, ts_utc, ended_utc, operator, action, target, params, outcome, error_type (null: no error), error,
    hash_before, hash_after; params and outcome hold JSON text."""
    failed, none = F.col("error_type").isNotNull(), F.lit(None).cast("string")
    record = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, ("part", "ts_utc", "action", "result", "params", "extra", "hash_after"))])
    error = F.when(failed, F.to_json(F.struct("error_type", "error"), {"ignoreNullFields": "false"}))
    start = record(F.lit(0), F.col("ts_utc"), F.concat("action", F.lit(".start")), F.lit("started"), F.col("params"), none, none)
    end = record(
        F.lit(1), F.col("ended_utc"), F.concat("action", F.when(failed, ".error").otherwise(".complete")), F.when(failed, "error").otherwise("ok"),
        F.col("outcome"), error, F.when(~failed, F.col("hash_after")),
    )
    rows = operations.select("case_id", "n", "operator", "target", "hash_before", F.explode(F.array(start, end)).alias("r"))
    return rows.select("case_id", (F.col("n") * 2 + F.col("r.part")).alias("n"), "operator", "target", "hash_before", "r.*", (F.col("r.part") == 1).alias("ends"))


def append_records(stored: DataFrame, new: DataFrame, key: str = "case_id", order: str = "n") -> DataFrame:
    """The new records as they go to the end of their chains: with seq, prev_digest and digest, params in canonical form.

    stored: key, seq, digest. new: key, order, ts_utc, operator, action, target, params (JSON text), result, hash_before,
    hash_after; with `ends`, a record that ends the operation started by the record before it and says so by start_seq,
    and `extra`, more params. A result that no record may state, or params without a canonical form, raise and nothing
    is appended. Chains go on in parallel, each as its rows stream by; two appends to one chain must not overlap."""
    for name, absent in (("ends", F.lit(False)), ("extra", F.lit(None).cast("string"))):
        new = new if name in new.columns else new.withColumn(name, absent)
    told = F.when(F.col("result").isin(*RESULTS), F.col("result")).otherwise(F.raise_error("a record's result is one of " + ", ".join(RESULTS)).cast("string"))
    heads = chain_heads(stored, key).select(key, F.col("seq").alias("last_seq"), F.col("head").alias("last_digest"))
    rows = new.withColumn("result", told).join(heads, key, "left")
    rows = rows.withColumns({"last_seq": F.coalesce("last_seq", F.lit(-1).cast("long")), "last_digest": F.coalesce("last_digest", F.lit(GENESIS))})
    plain = [c for c in BODY if c not in ("seq", "params", "prev_digest")]

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, head = -1, GENESIS
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                if r["place"] == 1:
                    seq, head = r["last_seq"], r["last_digest"]
                started = {"start_seq": seq} if r["ends"] else {}
                params = started | json.loads(r["params"] or "{}") | json.loads(r["extra"] or "{}")
                seq += 1
                body = {c: r[c] for c in plain} | {"seq": seq, "params": params, "prev_digest": head}
                head = hashlib.sha256(canonical(body).encode()).hexdigest()
                out.append((r[key], *({**body, "params": canonical(params)}[c] for c in BODY), head))
            yield pd.DataFrame(out, columns=[key, *BODY, "digest"])

    kinds = ", ".join(f"{c} {'long' if c == 'seq' else 'string'}" for c in BODY)
    rows = _in_turn(rows.select(key, order, *plain, "params", "ends", "extra", "last_seq", "last_digest"), key, order)
    return rows.mapInPandas(link, f"{key} {new.schema[key].dataType.simpleString()}, {kinds}, digest string")


def chain_heads(records: DataFrame, key: str = "case_id") -> DataFrame:
    return records.groupBy(key).agg(F.max("seq").alias("seq"), F.max_by("digest", "seq").alias("head"))


def latest(records: DataFrame, action: str) -> DataFrame:
    """case_id, target, params of the last record of an action for each target."""
    return records.where(F.col("action") == action).groupBy("case_id", "target").agg(F.max_by("params", "seq").alias("params"))


def content_addressed(artefacts: DataFrame) -> DataFrame:
    """One row for each SHA-256: the first by (created, path), with how many there were. artefacts: path, created, content."""
    hashed = artefacts.withColumn("sha256", F.sha2("content", 256))
    grouped = hashed.groupBy("sha256").agg(F.min(F.struct("created", "path")).alias("f"), F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("content")).cast("long").alias("size_bytes"))
    return grouped.select("sha256", "f.path", "f.created", "copies", "size_bytes")


def manifest_problems(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, problem: files missing or changed since the manifest (path, sha256) was written. files: path, content."""
    found = files.select("path", F.sha2("content", 256).alias("found"))
    both = manifest.join(found, "path", "left")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


#: What is read back of a manifest.
MANIFEST = "case_id string, audit struct<head_seq:bigint,head_digest:string>"


def case_manifests(heads: DataFrame, evidence: DataFrame, artefacts: DataFrame, version: int) -> DataFrame:
    """case_id, manifest: each case's chain head, evidence with its digests, and number of artefacts, as canonical JSON.

    heads: case_id, seq, head; evidence: case_id, evidence_id, md5, sha256, capacity_bytes; artefacts: case_id."""
    item = F.struct(F.col("evidence_id").alias("id"), "md5", "sha256", F.col("capacity_bytes").alias("size"))
    items = evidence.groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    counts = artefacts.groupBy("case_id").agg(F.count(F.lit(1)).alias("artifact_count"))
    rows = heads.join(items, "case_id", "left").join(counts, "case_id", "left").withColumn("artifact_count", F.coalesce("artifact_count", F.lit(0)))
    audit = F.struct(F.col("seq").alias("head_seq"), F.col("head").alias("head_digest")).alias("audit")
    none = F.array().cast(items.schema["evidence"].dataType)
    body = F.struct("case_id", F.lit(version).alias("schema_version"), audit, F.coalesce("evidence", none).alias("evidence"), "artifact_count")
    return rows.select("case_id", canonical_json(F.to_json(body, {"ignoreNullFields": "false"})).alias("manifest"))


def manifest_heads(manifests: DataFrame, records: DataFrame) -> DataFrame:
    """case_id, problem, warning of manifests against the chains: one that cannot be read, a chain cut short, another digest;
    a manifest behind its chain is a warning. manifests: case_id, manifest; records: case_id, seq, digest."""
    stated = manifests.select("case_id", F.from_json("manifest", MANIFEST).alias("m")).select("case_id", F.col("m.audit.head_seq").alias("seq"), F.col("m.audit.head_digest").alias("stated"))
    heads = chain_heads(records).select("case_id", F.col("seq").alias("last"))
    both = stated.join(records.select("case_id", "seq", "digest"), ["case_id", "seq"], "left").join(heads, "case_id", "left")
    problem = (
        F.when(F.col("seq").isNull() | F.col("stated").isNull(), "the manifest states no head")
        .when(F.col("digest").isNull(), F.concat(F.lit("the manifest's head "), F.col("seq").cast("string"), F.lit(" is not in the chain")))
        .when(F.col("digest") != F.col("stated"), F.concat(F.lit("the digest of record "), F.col("seq").cast("string"), F.lit(" is not the manifest's")))
    )
    warning = F.when(problem.isNull() & (F.col("seq") < F.col("last")), F.concat(F.lit("the manifest is behind the chain, which ends at "), F.col("last").cast("string")))
    return both.select("case_id", problem.alias("problem"), warning.alias("warning"))


def case_verified(chains: DataFrame, problems: DataFrame, manifest_records: DataFrame) -> DataFrame:
    """case_id, ok, problems: the chain, the record count its manifest states, and its artefacts, together.

    problems: case_id, path, problem; manifest_records: case_id, audit_records (as stated)."""
    files = problems.groupBy("case_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "path", "problem"))).alias("files"))
    rows = chains.join(manifest_records, "case_id", "left").join(files, "case_id", "left")
    cut = F.when(F.col("records_checked") < F.col("audit_records"), "the chain is shorter than its manifest states")
    listed = F.concat(F.array_compact(F.array("reason", cut)), F.coalesce("files", F.array().cast("array<string>")))
    return rows.select("case_id", (F.size(listed) == 0).alias("ok"), listed.alias("problems"))
