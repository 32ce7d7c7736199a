"""What the corpus operators share: the shared folder, written tables, prefix sums and hashing."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x20\x09-\x0D]+"

_own_folder: dict[str, str] = {}
#: The open `scratch` blocks of this thread or task, each the paths of its tables.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())
_cleaning = {"lock": threading.Lock(), "open": 0, "before": None}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one if the
    session runs on this machine alone (tests); on a cluster it must be set."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_folder[app]


def session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tracewell-corpus-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{session_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all tables and archives that operators of this session have left for their results to read. Call it when the
    results are written or read; a result read after it fails."""
    drop_path(spark, session_folder(spark))


def written(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """The same rows, read from a table written to the shared folder: lineage ends there, so a lost executor
    costs no recomputation and nothing that depends on task order is evaluated twice. Inside `scratch` the table goes
    when the block ends; with `keep` it stays for the block around it, or for good."""
    path = new_path(df.sparkSession, tag)
    blocks = _scratch.get()
    blocks = blocks[: len(blocks) - keep]
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of this run from the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession):
    """Within it, shuffle files go when the query that made them ends, as its result is written, and at its end the
    tables written in it go too: a chain of written tables then needs the disk of what is still read."""
    made: list[str] = []
    token = _scratch.set((*_scratch.get(), made))
    try:
        with cleaned_shuffles(spark):
            yield
    finally:
        _scratch.reset(token)
        for path in made:
            drop_path(spark, path)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row: a lambda's variable is bound, not substituted."""
    return F.transform(F.array(value), body)[0]


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Deal the rows by another hash than a join's. A join on the key then adds an exchange of its own to this side,
    which lets adaptive execution split a hot key's partition on the other side."""
    return df.repartition(F.xxhash64(F.lit(17), *key))


def guarded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns that begin with __ under other names, and the names to give back: those that the operators
    add for themselves begin so."""
    names = {c: f"column {i}" for i, c in enumerate(docs.columns) if c.startswith("__")}
    while set(names.values()) & set(docs.columns):
        names = {c: f"{n} too" for c, n in names.items()}
    return docs.withColumnsRenamed(names), {n: c for c, n in names.items()}


def global_rank(df: DataFrame, order: list[str], tag: str) -> DataFrame:
    """Adds __rank, 0 upwards in the order given (null last): ranges are counted apart and the counts summed."""
    keys = [F.col(c).asc_nulls_last() for c in order]
    parts = max(1, -(-df.count() // 200_000))
    fixed = written(df.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()), tag)
    counts = fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(*keys)
    return (
        fixed.join(F.broadcast(starts), "__part")  # one row for each of the ranges counted above
        .withColumn("__rank", F.col("__start") + F.row_number().over(inside) - 1)
        .drop("__part", "__start")
    )


@contextmanager
def cleaned_shuffles(spark: SparkSession):
    """Within it, shuffle files go when the query that made them ends, as its result is written: a chain of written
    tables then needs the disk of its largest step, not of all its steps."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _cleaning["lock"]:  # the setting is the session's: the first block sets it, the last gives it back
        if not _cleaning["open"]:
            _cleaning["before"] = spark.conf.get(key, None)
            spark.conf.set(key, "true")
        _cleaning["open"] += 1
    try:
        yield
    finally:
        with _cleaning["lock"]:
            _cleaning["open"] -= 1
            before = _cleaning["before"]
            if not _cleaning["open"]:
                spark.conf.unset(key) if before is None else spark.conf.set(key, before)
