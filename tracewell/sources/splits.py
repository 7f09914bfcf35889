"""Planning the predicates of parallel scans: each row of the table is in exactly one split."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def points(n: int, low: int, high: int) -> list[int]:
    """Boundaries from low to high with steps of max(1, (high - low) / n), truncated: n is a hint."""
    step = max(1, int((high - low) / max(1, n)))
    out = list(range(low, high + 1, step))
    if out[-1] != high or len(out) == 1:
        out.append(high)
    return out


def _ranges(column: str, bounds: list, literal=str) -> list[str]:
    last = len(bounds) - 2
    return [f"{column} >= {literal(a)} AND {column} {'<=' if i == last else '<'} {literal(z)}" for i, (a, z) in enumerate(zip(bounds, bounds[1:]))]


def integers(column: str, low: int | None, high: int | None, n: int, nullable: bool = False) -> list[str]:
    """Ranges `>= and <`, the last one `<=`; a table of nulls only, and nulls beside values, get an IS NULL split."""
    if low is None or high is None:
        return [f"{column} IS NULL"]
    return _ranges(column, points(n, low, high)) + [f"{column} IS NULL"] * nullable


def floats(column: str, low: float | None, high: float | None, n: int, nullable: bool = False) -> list[str]:
    """As `integers`, for floating point; boundaries in full precision, and none closer than ten thousand times the least double."""
    if low is None or high is None:
        return [f"{column} IS NULL"]
    step = max((high - low) / max(1, n), 10_000 * 5e-324)
    bounds, at = [], low
    while at < high and len(bounds) < n:
        bounds.append(at)
        at += step
    return _ranges(column, [*(bounds or [low]), high], lambda x: f"CAST('{Decimal(x)!s}' AS DOUBLE)") + [f"{column} IS NULL"] * nullable


def booleans(column: str, low: bool | None, high: bool | None, nullable: bool = False) -> list[str]:
    """One split for each value there is."""
    if low is None or high is None:
        return [f"{column} IS NULL"]
    return [f"{column} = FALSE"] * (not low) + [f"{column} = TRUE"] * bool(high) + [f"{column} IS NULL"] * nullable


def timestamps(column: str, low: str, high: str, n: int, nullable: bool = False) -> list[str]:
    """Ranges of TIMESTAMP literals, `yyyy-MM-dd HH:mm:ss[.f]`."""
    from datetime import datetime, timedelta

    a, z = datetime.fromisoformat(low), datetime.fromisoformat(high)
    micros = points(n, 0, (z - a) // timedelta(microseconds=1))
    return _ranges(column, [a + timedelta(microseconds=m) for m in micros], lambda t: f"TIMESTAMP '{t:%Y-%m-%d %H:%M:%S.%f}'") + [f"{column} IS NULL"] * nullable


def oracle_date(value: str) -> str:
    """A literal for stores that want a format."""
    return f"TO_TIMESTAMP('{value}', 'YYYY-MM-DD HH24:MI:SS.FF')"


def bounds(df: DataFrame, column: str) -> tuple:
    """(least, greatest, whether there are nulls), from one aggregate that Parquet statistics can serve."""
    r = df.agg(F.min(column), F.max(column), F.count("*") - F.count(column)).head()
    return r[0], r[1], bool(r[2])


def scan(df: DataFrame, predicates: list[str]) -> DataFrame:
    """The table as the union of its splits, each with `split`, its number. Predicates reach the scan."""
    out = None
    for i, p in enumerate(predicates):
        part = df.where(p).withColumn("split", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def jdbc(spark: SparkSession, url: str, table: str, predicates: list[str], properties: dict[str, str] | None = None, fetch: int = 1000) -> DataFrame:
    """A task for each predicate over JDBC; needs a driver on the class path."""
    return spark.read.jdbc(url, table, predicates=predicates, properties={"fetchsize": str(fetch)} | (properties or {}))
