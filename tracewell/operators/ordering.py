"""Sorts by keys in fields, compound orders, limits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_order(spec: str, text: str, separator: str = "\t") -> list[Column]:
    """Sort columns for a key spec in the manner of sort(1): `-k2,2nr -k1,1`. A key is a range of fields from 1, with n for numeric, r for descending;
    an open range goes to the last field."""
    out = []
    for m in re.finditer(r"-k\s*(\d+)(?:,(\d+))?([nr]*)|(-[nr]+)", spec):
        if m[4]:
            continue
        fields = F.split(F.col(text), re.escape(separator))
        first, last = int(m[1]), int(m[2]) if m[2] else None
        part = F.array_join(F.slice(fields, first, F.lit(last - first + 1) if last else F.greatest(F.size(fields) - first + 1, F.lit(0))), separator)
        key = part.try_cast("double") if "n" in m[3] else part
        out.append(key.desc() if "r" in m[3] else key.asc())
    if not out:
        raise ValueError(f"no key in {spec!r}")
    return out


def sort_by_keys(df: DataFrame, spec: str, text: str, separator: str = "\t") -> DataFrame:
    return df.orderBy(*key_order(spec, text, separator))


def compound(df: DataFrame, *orders: Column) -> DataFrame:
    """By the first order that differs."""
    return df.orderBy(*orders)


def diff_order(df: DataFrame, source: str, target: str, by_source: bool) -> DataFrame:
    """Renames in the order they can be done: by source descending, or by target ascending with those that have none first."""
    return df.orderBy(F.col(source).desc()) if by_source else df.orderBy(F.col(target).asc_nulls_first())


def total_order(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Sorted in ranges that Spark samples: every row of a partition is at or before those of the next."""
    return df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)


def grouped(df: DataFrame, *keys: str, sort: bool = False) -> DataFrame:
    """Rows of a key together; sorted in each partition or not."""
    out = df.repartition(*keys)
    return out.sortWithinPartitions(*keys) if sort else out
