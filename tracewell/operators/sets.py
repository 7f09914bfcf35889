"""Set operations and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import override


def keyed_union(key: str, *sources: DataFrame) -> DataFrame:
    """Union by key; of a key that several sources have, the last one's rows."""
    return override(key, *sources).drop("source_id")


def distinct_edges(edges: DataFrame, *columns: str) -> DataFrame:
    return edges.select(*columns).distinct()


def difference(df: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct rows that the other doesn't have."""
    return df.subtract(other)


def union_distinct(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sources).distinct()


def split_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first row of each key in the order, all further rows)."""
    from pyspark.sql import Window

    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where("_n = 1").drop("_n"), numbered.where("_n > 1").drop("_n")


def add_if_absent(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropDuplicates(list(columns))


def union_statistics(*sources: DataFrame) -> DataFrame:
    """All sources' rows, one after the other."""
    return reduce(lambda a, b: a.unionByName(b), sources)
