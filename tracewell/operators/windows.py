"""Windows, ranking and time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_average(df: DataFrame, key: str, ts_millis: str, value: str, window_ms: int) -> DataFrame:
    """Each row with `rolling`: the integer mean (truncated) of the key's values in the last window_ms, its own with it."""
    w = Window.partitionBy(key).orderBy(ts_millis).rangeBetween(-window_ms, 0)
    return df.withColumn("rolling", F.expr("0L") + F.floor(F.sum(value).over(w) / F.count(value).over(w)).cast("long"))


def top_by_window(df: DataFrame, ts: str, keys: list[str], minutes: int, n: int) -> DataFrame:
    """(window_start, keys, n, rank): the n most frequent keys of each reporting window of at least one minute; ties by key."""
    if minutes < 1:
        raise ValueError("a window has one minute at least")
    counted = df.groupBy(F.window(ts, f"{minutes} minutes").start.alias("window_start"), *keys).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("window_start").orderBy(F.desc("n"), *keys))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n)


def top_n(df: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    """The n largest; Spark keeps n rows for each task and n in the end."""
    return df.orderBy(F.desc(value), *ties).limit(n)


def changes(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before in the key's order; the first always does."""
    w = Window.partitionBy(key).orderBy(order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_new", first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).where("_new").drop("_new")


def latest(df: DataFrame, keys: list[str], ts: str, *ties: str) -> DataFrame:
    """The latest row of each key; of equal times the one with the greatest ties. A partial aggregate: no key is gathered or sorted."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(ts, *ties, *[c for c in rest if c != ts and c not in ties]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def unique_timestamps(df: DataFrame, ts_millis: str, app: str) -> DataFrame:
    """`cell_ts`: milliseconds times a million, plus the application's number modulo a million."""
    return df.withColumn("cell_ts", F.col(ts_millis) * 1_000_000 + F.pmod(F.col(app), F.lit(1_000_000)))


def allocation_steps(intervals: DataFrame, start: str, end: str, capacity: str, container: int, step: int) -> DataFrame:
    """(at, containers): at every step within an interval [start, end), how many containers its capacity holds, over all intervals."""
    points = intervals.select(F.explode(F.sequence(F.ceil(F.col(start) / step) * step, F.col(end) - 1, F.lit(step))).alias("at"), F.floor(F.col(capacity) / container).alias("c"))
    return points.groupBy("at").agg(F.sum("c").alias("containers"))


def sequence_in(df: DataFrame, key: str, *order: str) -> DataFrame:
    """`seq`, from 1, in the key's order."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
