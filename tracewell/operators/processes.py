"""User code: external processes over pipes, wire formats, user aggregators, line parsers."""

from __future__ import annotations

import struct
import subprocess
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_rows(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's mapper over Arrow batches."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(f, batches)

    return df.mapInPandas(each, schema)


def reduce_groups(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's reducer. A group is in one task's memory: pre-aggregate keys that may be very large with Spark's own sums."""
    return df.groupBy(*keys).applyInPandas(f, schema)


def aggregate(df: DataFrame, keys: list[str], column: str, f: Callable[[pd.Series], float], name: str = "report") -> DataFrame:
    """A user's aggregator as a grouped Arrow function."""
    from pyspark.sql.types import DoubleType

    def wrapped(v: pd.Series) -> float:
        return float(f(v))

    return df.groupBy(*keys).agg(F.pandas_udf(wrapped, DoubleType(), F.PandasUDFType.GROUPED_AGG)(column).alias(name))


def pipe(df: DataFrame, command: list[str], key: str = "key", value: str = "value", separator: str = "\t", grouped: bool = False) -> DataFrame:
    """(key, value) lines that a process prints, which gets the rows as lines `key TAB value`; a process for each partition.

    A line without a separator is a key with an empty value. grouped: rows of a key come together and sorted, as a reducer wants them. A process that
    ends with an error fails its task, which Spark tries again; lines are fed while output is read, so neither side waits for ever.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    if grouped:
        rows = rows.repartition("key").sortWithinPartitions("key", "value")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8")
        failed: list[BaseException] = []

        def feed() -> None:
            try:
                for b in batches:
                    p.stdin.write("".join(f"{k}{separator}{v}\n" for k, v in zip(b["key"].fillna(""), b["value"].fillna(""))))
            except BrokenPipeError:
                pass
            except BaseException as e:  # told to the task after the output has been read
                failed.append(e)
            finally:
                try:
                    p.stdin.close()
                except BrokenPipeError:
                    pass

        thread = threading.Thread(target=feed, daemon=True)
        thread.start()
        out: list[tuple[str, str]] = []
        for line in p.stdout:
            k, _, v = line.rstrip("\n").partition(separator)
            out.append((k, v))
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=["key", "value"])
                out = []
        thread.join()
        if failed:
            raise failed[0]
        if p.wait():
            raise RuntimeError(f"{command[0]} ended with {p.returncode}")
        yield pd.DataFrame(out, columns=["key", "value"])

    return rows.mapInPandas(each, "key string, value string")


#: Codes of typed bytes.
BYTES, BYTE, BOOL, INT, LONG, FLOAT, DOUBLE, STRING, VECTOR, LIST, MAP, MARKER = 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 255


def to_typed_bytes(x: object) -> bytes:
    """A value with its type's code before it, big-endian; lists end with a marker, tuples are vectors with their length."""
    if isinstance(x, bool):
        return struct.pack(">BB", BOOL, x)
    if isinstance(x, int):
        return struct.pack(">Bi", INT, x) if -(1 << 31) <= x < 1 << 31 else struct.pack(">Bq", LONG, x)
    if isinstance(x, float):
        return struct.pack(">Bd", DOUBLE, x)
    if isinstance(x, str):
        raw = x.encode("utf-8")
        return struct.pack(">Bi", STRING, len(raw)) + raw
    if isinstance(x, (bytes, bytearray)):
        return struct.pack(">Bi", BYTES, len(x)) + bytes(x)
    if isinstance(x, tuple):
        return struct.pack(">Bi", VECTOR, len(x)) + b"".join(map(to_typed_bytes, x))
    if isinstance(x, list):
        return bytes([LIST]) + b"".join(map(to_typed_bytes, x)) + bytes([MARKER])
    if isinstance(x, dict):
        return struct.pack(">Bi", MAP, len(x)) + b"".join(to_typed_bytes(k) + to_typed_bytes(v) for k, v in x.items())
    raise TypeError(f"no typed bytes for {type(x).__name__}")


def from_typed_bytes(raw: bytes) -> list:
    """The values of a run of typed bytes; codes from 50 to 200 are an application's own, and come back as bytes."""
    at, end = 0, object()

    def take(form: str):
        nonlocal at
        out = struct.unpack_from(">" + form, raw, at)[0]
        at += struct.calcsize(">" + form)
        return out

    def slice_(n: int) -> bytes:
        nonlocal at
        at += n
        return raw[at - n : at]

    def value():
        code = take("B")
        if code == BYTES or 50 <= code <= 200:
            return slice_(take("i"))
        if code == STRING:
            return slice_(take("i")).decode("utf-8")
        if code in (BYTE, INT, LONG, FLOAT, DOUBLE):
            return take({BYTE: "b", INT: "i", LONG: "q", FLOAT: "f", DOUBLE: "d"}[code])
        if code == BOOL:
            return bool(take("B"))
        if code == VECTOR:
            return tuple(value() for _ in range(take("i")))
        if code == MAP:
            return {value(): value() for _ in range(take("i"))}
        if code == LIST:
            out = []
            while (x := value()) is not end:
                out.append(x)
            return out
        if code == MARKER:
            return end
        raise ValueError(f"no type {code}")

    out = []
    while at < len(raw):
        out.append(value())
    return out


def parse_lines(df: DataFrame, line: str, parser: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """The rows that a user's parser makes of each line, none or several."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for x in b[line] if x is not None for r in parser(x)], columns=names)

    return df.select(line).mapInPandas(each, schema)


def property_values(df: DataFrame, name: str, value: str) -> DataFrame:
    """`typed`: a job property's value as a variant of the type it reads as (long, double, boolean), else its text."""
    v = F.col(value)
    text = F.to_json(F.struct(v.alias("x")))
    plain = F.concat(F.lit('{"x":'), F.trim(v), F.lit("}"))
    typed = F.trim(v).rlike(r"^(-?(0|[1-9]\d{0,17})(\.\d+)?|true|false)$")
    return df.withColumn("typed", F.variant_get(F.parse_json(F.when(typed, plain).otherwise(text)), "$.x", "variant"))


def equivalent(calls: DataFrame, table: DataFrame) -> DataFrame:
    """Calls of methods whose result is one of their arguments, with its number: a lookup join on `method`."""
    return calls.join(table, "method")


def counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row of counts of rows for which each condition holds."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
