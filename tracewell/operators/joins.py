"""Joins: n-way inner, full outer and override, tagged, lookup, semi and anti, prefix and ordered scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The distinct keys of df that the table has."""
    return df.select(key).join(table.select(key), key, "left_semi").distinct()


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't in `done`."""
    return df.join(done.select(key), key, "left_anti")


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join with a keyed table; Spark broadcasts a table under its size threshold and shuffles a larger one."""
    return df.join(table, key)


def inner_many(key: str, *sources: DataFrame) -> DataFrame:
    """The cross product, key by key, of keys that every source has."""
    return reduce(lambda a, b: a.join(b, key), sources)


def outer_many(key: str, *sources: DataFrame) -> DataFrame:
    """As `inner_many`, for keys that any source has; a source without the key gives nulls."""
    return reduce(lambda a, b: a.join(b, key, "full"), sources)


def override(key: str, *sources: DataFrame) -> DataFrame:
    """For each key all rows of the last source that has it. Sources have the same columns; the result has `source_id` too.

    The last source of a key is a partial aggregate, joined back: a key with very many rows is never gathered for a window.
    """
    tagged = reduce(lambda a, b: a.unionByName(b), [s.withColumn("source_id", F.lit(i)) for i, s in enumerate(sources)])
    last = tagged.groupBy(key).agg(F.max("source_id").alias("source_id"))
    return tagged.join(last, [key, "source_id"])


def tagged_join(key: str, sources: dict[str, DataFrame]) -> DataFrame:
    """Inner join of tagged sources on a key; null keys are dropped."""
    renamed = [s.where(F.col(key).isNotNull()).select(key, *[F.col(c).alias(f"{tag}_{c}") for c in s.columns if c != key]) for tag, s in sources.items()]
    return inner_many(key, *renamed)


def join_counters(key: str, sources: dict[str, DataFrame]) -> DataFrame:
    """(tag, total, null_keys, collected) of the sources of a tagged join."""
    count = lambda tag, s: s.agg(
        F.lit(tag).alias("tag"), F.count("*").alias("total"), F.count_if(F.col(key).isNull()).alias("null_keys"), F.count(key).alias("collected")
    )
    return reduce(lambda a, b: a.unionByName(b), [count(t, s) for t, s in sources.items()])


def prefix_scan(df: DataFrame, **prefix: object) -> DataFrame:
    """Rows whose leading key columns equal the prefix; filters that Parquet prunes by."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in prefix.items()], F.lit(True)))


def scan_from(df: DataFrame, least, *order: str) -> DataFrame:
    """Rows whose first order column is at least `least`, in order."""
    return df.where(F.col(order[0]) >= F.lit(least)).orderBy(*order)


def between_join(left: DataFrame, right: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Rows of left whose long `at` lies in [start, end) of a row of right with the same key, by an equi-join on cells of `width`."""
    cells = right.select("*", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))).alias("_cell"))
    return left.withColumn("_cell", F.floor(F.col(at) / width)).join(cells, [key, "_cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")
