"""Sweeps: running values along each key's rows in order, also where one key has most of the rows.

A key of up to HOT rows is swept by a window of its own. If any key has more, rows are dealt to ranges of (key, order) of
about RANGE rows each instead, so that a key lies in many ranges. A window then sweeps each key inside a range, and what
the ranges before it add up to is carried in: only a key that begins in an earlier range has something to carry, one at
most for each range, so the carried rows are as few as the ranges. Both ways give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

HOT, RANGE = 2_000_000, 500_000
#: Rows of a task where no key is hot: the tasks grow with the rows, and what a task sorts and adds up does not.
SHARE = 125_000
#: Inputs that Catalyst takes to be smaller have no key counted: a job is saved, and one task can hold them.
SMALL_BYTES = 16 * 1024 * 1024
PART = "__part"


def counted(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """The rows of the largest key, and of all; not counted where Catalyst takes the input to be small (0, 0)."""
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SMALL_BYTES:
        return 0, 0
    return tuple(n or 0 for n in df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first())


def is_hot(df: DataFrame, keys: list[str]) -> bool:
    """Whether any key has more than HOT rows."""
    return counted(df, keys)[0] > HOT


def shared_out(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df dealt by its keys to as many tasks as its rows (0: not counted) make shares. Partitions of the session's number hold
    more the larger the input is, and adaptive execution joins small ones by the bytes shuffled, not by what they become."""
    return df.repartition(-(-rows // SHARE), *keys) if rows else df.repartition(*keys)


def ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df dealt to ranges, written once, with a column for the range. Rows of equal keys and order stay together."""
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    fixed = staged(df, "rows")
    parts = max(2, -(-fixed.count() // RANGE))
    return staged(fixed.repartitionByRange(parts, *by).withColumn(PART, F.spark_partition_id()), "ranges")


def dealt(df: DataFrame, keys: list[str], order: list[str], size: tuple[int, int] | None = None) -> DataFrame:
    """df, in ranges if a key is hot, else in shares of whole keys. size: the rows of the largest key and of all, where they
    are known; else df is counted, which evaluates it once more: stage what is dear."""
    if PART in df.columns:
        return df
    most, rows = size or counted(df, keys)
    if most > HOT:
        return ranges(df, keys, order)
    return shared_out(df, keys, rows) if rows else df


def _window(df: DataFrame, keys: list[str], order: list[str]):
    by = [*keys, PART] if PART in df.columns else keys
    return Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_first() for c in order])


def swept(df: DataFrame, keys: list[str], order: list[str], **specs: tuple[str, Column | str]) -> DataFrame:
    """df with a column for each spec (kind, value) along the order of each key:

    sum: of all rows up to this one; max_before: the largest of the rows before (null for none); last: the latest value
    that is not null, up to this row; last_before: before it; lag, lead: the value of the row before and after, which may
    be null. Rows that tie in the order must agree in what they add, or the order must be made total. df: as `dealt` or
    `ranges` gave it, or any rows whose keys are not hot."""
    w = _window(df, keys, order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    value = {name: F.col(v) if isinstance(v, str) else v for name, (_, v) in specs.items()}
    boxed = {name: F.struct(v.alias("v")) for name, v in value.items()}  # a null of a row there is, apart from no row
    inside = {
        "sum": lambda n: F.sum(value[n]).over(upto), "max_before": lambda n: F.max(value[n]).over(before), "last": lambda n: F.last(value[n], True).over(upto),
        "last_before": lambda n: F.last(value[n], True).over(before), "lag": lambda n: F.lag(at[n]).over(w), "lead": lambda n: F.lead(at[n]).over(w),
    }
    at = boxed if PART in df.columns else value
    rows = df.select("*", *[inside[kind](n).alias(n) for n, (kind, _) in specs.items()])
    if PART not in df.columns:
        return rows
    rows = _carried(df, rows, keys, order, {n: kind for n, (kind, _) in specs.items()}, value, boxed)
    return rows.withColumns({n: F.col(n)["v"] for n, (kind, _) in specs.items() if kind in ("lag", "lead")})


def _carried(df: DataFrame, rows: DataFrame, keys: list[str], order: list[str], kinds: dict[str, str], value: dict[str, Column], boxed: dict[str, Column]) -> DataFrame:
    """rows with what other ranges add. df: the rows as dealt, without the swept columns."""
    key = F.struct(*keys)
    ends = df.groupBy(PART).agg(F.min(key).alias("first"), F.max(key).alias("last"))  # a row for each range
    crossing = ends.select(PART, F.explode(F.array_distinct(F.array("first", "last"))).alias("__sweep_key"))
    place = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])  # nulls first
    total = {
        "sum": lambda n: F.sum(value[n]), "max_before": lambda n: F.max(value[n]), "last": lambda n: F.max_by(value[n], F.when(value[n].isNotNull(), place)),
        "last_before": lambda n: F.max_by(value[n], F.when(value[n].isNotNull(), place)), "lag": lambda n: F.max_by(boxed[n], place), "lead": lambda n: F.min_by(boxed[n], place),
    }
    held = df.withColumn("__sweep_key", key).join(F.broadcast(crossing), [PART, "__sweep_key"], "left_semi")  # two rows for each range
    sums = held.groupBy("__sweep_key", PART).agg(*[total[kind](n).alias(n) for n, kind in kinds.items()])
    w = Window.partitionBy("__sweep_key").orderBy(PART)  # of a hot key, a row for each of its ranges
    earlier, later = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    carry = {
        "sum": lambda n: F.sum(n).over(earlier), "max_before": lambda n: F.max(n).over(earlier), "last": lambda n: F.last(n, True).over(earlier),
        "last_before": lambda n: F.last(n, True).over(earlier), "lag": lambda n: F.last(n).over(earlier), "lead": lambda n: F.first(n).over(later),
    }
    carried = sums.select("__sweep_key", PART, *[carry[kind](n).alias(f"__carried_{n}") for n, kind in kinds.items()])
    both = {"sum": lambda a, b: F.when(a.isNull(), b).otherwise(a + F.coalesce(b, F.lit(0))), "max_before": F.greatest}
    rows = rows.withColumn("__sweep_key", key).join(F.broadcast(carried), [PART, "__sweep_key"], "left")
    made = {n: both.get(kind, lambda a, b: F.coalesce(a, b))(F.col(n), F.col(f"__carried_{n}")) for n, kind in kinds.items()}
    return rows.withColumns(made).drop("__sweep_key", *[f"__carried_{n}" for n in kinds])
