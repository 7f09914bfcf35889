"""Metric and audit streams: filtered, windowed, deduplicated; batch DataFrames take the same functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def windowed_average(df: DataFrame, ts: str, key: str, value: str, window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, key, n, mean) in event time; rows later than the watermark are dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    return rows.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")


def windowed_counts(df: DataFrame, ts: str, keys: list[str], minutes: list[int], late: str = "10 minutes") -> dict[int, DataFrame]:
    """(start, keys, n) for several reporting windows of at least a minute at once."""
    if min(minutes) < 1:
        raise ValueError("a window has one minute at least")
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    return {m: rows.groupBy(F.window(ts, f"{m} minutes").alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n") for m in minutes}


def sessions(df: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of sessions that end after a gap."""
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def quantiles(df: DataFrame, value: str, wanted: dict[float, float], *keys: str) -> DataFrame:
    """Approximate quantiles, each with its error in rank, and the count."""
    cols = [F.percentile_approx(value, F.lit(q), F.lit(max(1, round(1 / e)))).alias(f"q{str(q).replace('.', '_')}") for q, e in wanted.items()]
    return df.groupBy(*keys).agg(F.count(value).alias("n"), *cols)


def changed_only(before: DataFrame, now: DataFrame, everything: bool = False) -> DataFrame:
    """The snapshot's rows that are new or differ from the one before; all of them if asked."""
    return now if everything else now.subtract(before)


def pipeline(source: DataFrame, keep, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, name: str = "metrics") -> StreamingQuery:
    """Records that a filter lets through go to every sink, a batch at a time; each sink gets the batch's number, by which it can leave a
    repeated batch out."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks.values():
                sink(batch, number)
        finally:
            batch.unpersist()

    return source.where(keep).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, exactly once by the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def compact(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """What a major compaction keeps: the latest cell of each key."""
    from ..operators.windows import latest

    return latest(df, keys, ts)


def replay(audit: DataFrame, relative_ms: str, start_ms: int, rate: float = 1.0) -> DataFrame:
    """`at_ms`: relative times mapped to absolute ones, faster by the rate."""
    return audit.withColumn("at_ms", (F.lit(start_ms) + F.col(relative_ms) / rate).cast("long"))
