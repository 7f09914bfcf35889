"""Routing and partitioning as columns: Spark's exchange does the moving, these say where to."""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the seed of the rehash.
REHASH_SEED = 1591267453
VIRTUAL_NODES = 100


def java_hash(text: str) -> Column:
    """The 32-bit hash of a string as Java makes it, sum of code units times powers of 31; for characters of the basic plane."""
    return F.aggregate(F.split(F.col(text), ""), F.lit(0).cast("long"), lambda h, c: F.when(c == "", h).otherwise(F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32)))).alias("hash")


def _signed(h: Column) -> Column:
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def hash_partition(text: str, n: int) -> Column:
    """The hash's lower 31 bits modulo n."""
    return java_hash(text).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")) % n


def rehash(code: Column, n: int) -> Column:
    """A 32-bit code, mixed by shifts, modulo n; spreads codes that follow a pattern."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    h = code.cast("long").bitwiseXOR(F.lit(REHASH_SEED).cast("long")).bitwiseAND(mask)
    h = h.bitwiseXOR(F.shiftright(h, 20)).bitwiseXOR(F.shiftright(h, 12))
    h = h.bitwiseXOR(F.shiftright(h, 7)).bitwiseXOR(F.shiftright(h, 4))
    return h.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")) % n


def range_partition(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Contiguous key ranges, from a sample that Spark draws."""
    return df.repartitionByRange(n, *keys)


def field_partition(df: DataFrame, n: int, text: str, first: int, last: int, separator: str = "\t") -> DataFrame:
    """Rows with equal fields first..last (from 1) together."""
    return df.repartition(n, F.slice(F.split(text, separator), first, last - first + 1))


def byte_partition(key: str, left: int, right: int, n: int) -> Column:
    """By the bytes left..right of a binary key, negative offsets from the end, both ends included; in the manner of a Java array hash."""
    size = F.octet_length(F.col(key))
    at = lambda i: F.lit(i) if i >= 0 else size + i
    hexed = F.hex(F.substring(F.col(key), at(left) + 1, at(right) - at(left) + 1))
    values = F.transform(F.sequence(F.lit(1), F.greatest(F.length(hexed), F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))
    signed = F.transform(values, lambda v: F.when(v > 127, v - 256).otherwise(v))
    code = F.aggregate(signed, F.lit(1).cast("long"), lambda h, v: F.pmod(h * 31 + v, F.lit(1 << 32)))
    return code.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")) % n


def given_partition(df: DataFrame, number: str, n: int) -> DataFrame:
    """By a number that some process gave; it must be in 0 .. n - 1, and rows without one go by their hash."""
    checked = F.when(F.col(number).between(0, n - 1), F.col(number)).when(F.col(number).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(n))).otherwise(F.raise_error(F.lit("partition out of range")))
    return df.withColumn("partition", checked.cast("int"))


def ring(locations: list[str], virtual: int = VIRTUAL_NODES) -> list[tuple[str, str]]:
    """(hash, location), sorted: every location at `virtual` places of a ring of MD5 values."""
    return sorted((hashlib.md5(f"{name}/{i}".encode()).hexdigest(), name) for name in locations for i in range(virtual))


def ring_route(df: DataFrame, item: str, places: DataFrame) -> DataFrame:
    """`location` of each item: that of the first place at or after its MD5, else of the first place.

    places: the columns (place, location), a million at most. They become one sorted literal, and each row looks into the part of it that its first
    byte says: no join.
    """
    rows = sorted((r.place, r.location) for r in places.select("place", "location").limit(1_000_001).collect())
    if not 0 < len(rows) <= 1_000_000:
        raise ValueError("no place, or over a million")
    literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), f"array<{kind}>")
    starts = [bisect.bisect_left(rows, (f"{b:02x}",)) for b in range(256)] + [len(rows)]
    hashed = F.md5(F.col(item).cast("string"))
    first = F.conv(F.substring(hashed, 1, 2), 16, 10).cast("int")
    begin = F.get(literal(starts, "int"), first)
    near = F.slice(literal([p for p, _ in rows], "string"), begin + 1, F.get(literal(starts, "int"), first + 1) - begin)
    index = F.pmod(begin + F.size(F.filter(near, lambda p: p < hashed)), F.lit(len(rows)))
    return df.withColumn("location", F.get(literal([n for _, n in rows], "string"), index))


def destination(order: str, path: str, n: int, local: int = 0, spaces: list[int] = (), seed: int = 0) -> Column:
    """The cluster, 0 .. n - 1, that a path is created in: HASH and HASH_ALL by the path (or its parent for HASH), LOCAL the given one, RANDOM seeded, SPACE that
    with most room."""
    if order in ("HASH", "HASH_ALL"):
        what = F.regexp_replace(path, "/[^/]*$", "") if order == "HASH" else F.col(path)
        return F.pmod(F.xxhash64(what), F.lit(n)).cast("int")
    if order == "LOCAL":
        return F.lit(local)
    if order == "RANDOM":
        return F.floor(F.rand(seed) * n).cast("int")
    if order == "SPACE":
        return F.lit(max(range(len(spaces)), key=lambda i: spaces[i]))
    raise ValueError(f"no destination order {order!r}")


def replicas(df: DataFrame, index: str, replication: int, nodes: int) -> DataFrame:
    """A row for each replica: `node` is (index + i) modulo the number of nodes."""
    return df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(replication - 1)))).withColumn("node", F.pmod(F.col(index) + F.col("i"), F.lit(nodes)).cast("int")).drop("i")


def balanced(spark: SparkSession, target_bytes: int, target_records: int) -> DataFrame:
    """(record, bytes): the bytes spread over the records; the first ones take the remainder."""
    size, more = divmod(target_bytes, target_records) if target_records else (0, 0)
    return spark.range(target_records).select(F.col("id").alias("record"), (F.lit(size) + F.when(F.col("id") < more, 1).otherwise(0)).cast("long").alias("bytes"))
