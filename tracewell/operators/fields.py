"""Projections of delimited fields, keys and values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _selected(fields: Column, spec: str, separator: str) -> Column | None:
    """The fields of a list like `1,3-5,7-`, joined; None for an empty list."""
    parts = []
    for item in filter(None, (x.strip() for x in spec.split(","))):
        if not (m := re.fullmatch(r"(\d+)(?:(-)(\d*))?", item)):
            raise ValueError(f"bad field {item!r}")
        first = int(m[1])
        if m[2] and not m[3]:
            parts.append(F.slice(fields, first + 1, F.greatest(F.size(fields) - first, F.lit(0))))
        else:
            parts.append(F.slice(fields, first + 1, (int(m[3]) if m[3] else first) - first + 1))
    return F.array_join(F.concat(*parts), separator) if parts else None


def select_fields(df: DataFrame, text: str, spec: str = "0-:", separator: str = "\t") -> DataFrame:
    """(key, value) by a spec `key fields:value fields` of fields from 0; `n-` is an open range; fields a row lacks are left out. No key is null."""
    keys, _, values = spec.partition(":")
    fields = F.split(F.col(text), re.escape(separator), -1)
    pick = lambda s: F.lit(None).cast("string") if (c := _selected(fields, s, separator)) is None else c
    return df.select(pick(keys).alias("key"), pick(values).alias("value"))


def inverse(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    return df.select(F.col(value).alias(key), F.col(key).alias(value))


def identity(df: DataFrame) -> DataFrame:
    return df.select("*")


def regex_extract(df: DataFrame, text: str, pattern: str, group: int = 0) -> DataFrame:
    """(match, one) for every match."""
    return df.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("match"), F.lit(1).cast("long").alias("one"))


def key_value(df: DataFrame, text: str, separator: str = "\t") -> DataFrame:
    """(key, value) at the first separator; without one the line is the key and the value empty."""
    at = F.instr(F.col(text), separator)
    return df.select(
        F.when(at > 0, F.expr(f"left({text}, instr({text}, '{separator}') - 1)")).otherwise(F.col(text)).alias("key"),
        F.when(at > 0, F.expr(f"substring({text}, instr({text}, '{separator}') + {len(separator)})")).otherwise(F.lit("")).alias("value"),
    )


#: Fixed value: the order of an audit table's columns, which U+0001 separates.
AUDIT_COLUMNS = ("relative_ts", "ugi", "command", "src", "dst", "source_ip")


def audit_columns(df: DataFrame, line: str) -> DataFrame:
    parts = F.split(F.col(line), "\u0001", -1)
    return df.select(*[(F.get(parts, i).try_cast("long") if c == "relative_ts" else F.get(parts, i)).alias(c) for i, c in enumerate(AUDIT_COLUMNS)])


def audit_direct(df: DataFrame, line: str) -> DataFrame:
    """Audit lines of tab-separated key=value pairs: (ts, allowed, ugi, cmd, src, dst)."""
    pairs = F.regexp_extract_all(F.col(line), F.lit(r"(\w+)=([^\t]*)"), F.lit(0))
    entries = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_replace(p, "^[^=]*=", ""))))
    return df.select(F.regexp_extract(line, r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3})", 1).alias("ts"), *[F.try_element_at(entries, F.lit(k)).alias(k) for k in ("allowed", "ugi", "cmd", "src", "dst")])
