"""Hashes, encodings, distributions and seeded generators, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LONG_MAX = (1 << 63) - 1


def invert(value: Column) -> Column:
    """Long.MAX - x: ascending in it is descending in x."""
    return F.lit(LONG_MAX) - value


def reversed_bytes(value: Column) -> Column:
    """8 bytes whose unsigned order is the descending order of signed longs."""
    flipped = F.bitwise_not(value.bitwiseXOR(F.lit(-(1 << 63))))
    return F.unhex(F.lpad(F.hex(flipped), 16, "0"))


def supplement(ts: Column, app: Column) -> Column:
    """Milliseconds made unique: times a million, plus the application's number modulo a million."""
    return ts * 1_000_000 + F.pmod(app, F.lit(1_000_000))


def truncate_supplement(cell_ts: Column) -> Column:
    return F.floor(cell_ts / 1_000_000).cast("long")


#: Fixed values of MurmurHash 2.
_M, _R = 0x5BD1E995, 24


def murmur2(binary: Column, seed: int = 0) -> Column:
    """The 32-bit MurmurHash 2 of a binary column, as an unsigned long, by a fold over its 4-byte words."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    size, hexed = F.octet_length(binary), F.hex(binary)
    byte = lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    times = lambda a: (a * F.lit(_M).cast("long")).bitwiseAND(mask)

    def word(i):
        at = i * 4
        return byte(at).bitwiseOR(F.shiftleft(byte(at + 1), 8)).bitwiseOR(F.shiftleft(byte(at + 2), 16)).bitwiseOR(F.shiftleft(byte(at + 3), 24))

    words = F.when(size >= 4, F.transform(F.sequence(F.lit(0), F.floor(size / 4).cast("int") - 1), word)).otherwise(F.array().cast("array<long>"))

    def step(h, k):
        k = times(k)
        return times(h).bitwiseXOR(times(k.bitwiseXOR(F.shiftright(k, _R))))

    start = size.cast("long").bitwiseXOR(F.lit(seed).cast("long"))
    at, left = (F.floor(size / 4) * 4).cast("int"), size % 4

    def finish(h):
        tail = F.when(left >= 3, F.shiftleft(byte(at + 2), 16)).otherwise(F.lit(0).cast("long"))
        tail = tail.bitwiseXOR(F.when(left >= 2, F.shiftleft(byte(at + 1), 8)).otherwise(F.lit(0).cast("long")))
        h = F.when(left >= 1, times(h.bitwiseXOR(tail).bitwiseXOR(byte(at)))).otherwise(h)
        h = times(h.bitwiseXOR(F.shiftright(h, 13)))
        return h.bitwiseXOR(F.shiftright(h, 15))

    return F.aggregate(words, start, step, finish)


def file_checksums(df: DataFrame, file: str, block: str, data: str) -> DataFrame:
    """(file, blocks, md5): the MD5 of the MD5s of a file's blocks, in the order of the blocks."""
    hashed = df.select(file, block, F.md5(data).alias("m"))
    listed = hashed.groupBy(file).agg(F.count("*").alias("blocks"), F.sort_array(F.collect_list(F.struct(block, "m"))).alias("ms"))
    return listed.select(file, "blocks", F.md5(F.unhex(F.array_join(F.transform("ms", lambda m: m["m"]), ""))).alias("md5"))


#: Ranges that `cdf` puts the values of a key in.
RANGES = 32


def cdf(df: DataFrame, value: str, steps: int, modulus: int, *keys: str) -> DataFrame:
    """least, greatest and the discrete quantiles at steps[i] / modulus for i = 1 .. steps, exact, of a numeric column; null values don't count.

    Each distinct value is counted. Sketched quantiles cut a key's values into ranges, and only ranges that hold a wanted rank are summed up
    value by value. The sketch decides how even the ranges are, never the result.
    """
    key = F.struct(F.lit(0).alias("_"), *keys).alias("_k")
    counted = df.select(key, F.col(value).alias("_v")).groupBy("_k", "_v").agg(F.count("_v").alias("_n"))
    cuts = F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], F.lit(1000)).alias("_cuts")
    ends = counted.groupBy("_k").agg(cuts, F.sum("_n").alias("_total"), F.min("_v").alias("least"), F.max("_v").alias("greatest"))
    placed = counted.where("_v is not null").join(ends.select("_k", "_cuts", "_total"), "_k")
    placed = placed.select("_k", "_v", "_n", "_total", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_r"))
    sums = placed.groupBy("_k", "_r").agg(F.sum("_n").alias("_in"), F.max("_total").alias("_all"))
    upto = F.sum("_in").over(Window.partitionBy("_k").orderBy("_r"))
    sums = sums.withColumn("_before", upto - F.col("_in"))
    ranks = F.array(*[F.lit(i) for i in range(1, steps + 1)])
    holds = lambda i: (F.col("_before") * modulus < i * F.col("_all")) & ((F.col("_before") + F.col("_in")) * modulus >= i * F.col("_all"))
    wanted = sums.where(F.exists(ranks, holds))
    near = placed.join(wanted.select("_k", "_r", "_before"), ["_k", "_r"])
    rank = F.col("_before") + F.sum("_n").over(Window.partitionBy("_k", "_r").orderBy("_v"))
    found = near.select("_k", "_v", "_total", rank.alias("_rank")).groupBy("_k")
    found = found.agg(*[F.min(F.when(F.col("_rank") * modulus >= F.col("_total") * i, F.col("_v"))).alias(f"p{i}") for i in range(1, steps + 1)])
    return ends.join(found, "_k", "left").select(*[F.col("_k")[c].alias(c) for c in keys], "least", "greatest", *[f"p{i}" for i in range(1, steps + 1)])


def piecewise_quantile(rank: Column, points: list[tuple[float, float]]) -> Column:
    """The value at a rank, linear between (rank, value) points in ascending order; the first one is the least, the last the greatest."""
    out = F.lit(points[-1][1])
    for (r0, v0), (r1, v1) in reversed(list(zip(points, points[1:]))):
        out = F.when(rank < r1, F.lit(v0) + (rank - r0) / (r1 - r0) * (v1 - v0)).otherwise(out)
    return out.cast("double")


def inverse_cdf_sample(df: DataFrame, points: list[tuple[float, float]], seed: int, name: str = "sample") -> DataFrame:
    """A draw from the distribution for every row."""
    return df.withColumn(name, piecewise_quantile(F.rand(seed), points))


def weighted_choice(df: DataFrame, draw: str, weights: dict[str, float]) -> DataFrame:
    """`choice`: the first name whose cumulative weight exceeds draw (0 to 1) times the total."""
    total, at, out = sum(weights.values()), 0.0, F.lit(None).cast("string")
    steps = []
    for name, w in weights.items():
        at += w
        steps.append((name, at))
    for name, upto in reversed(steps):
        out = F.when(F.col(draw) * total < upto, name).otherwise(out)
    return df.withColumn("choice", out)


def normal(mean: float, deviation: float | None, seed: int) -> Column:
    """A normal draw; null for a mean of 0 or less; a deviation of 0 is a sixth of the mean."""
    if mean <= 0:
        return F.lit(None).cast("double")
    return F.lit(mean) + F.randn(seed) * F.lit(deviation or mean / 6)


def log_normal(mean: float, deviation: float | None, seed: int) -> Column:
    """A log-normal draw with the given mean and deviation of the values themselves."""
    import math

    if mean <= 0:
        return F.lit(None).cast("double")
    spread = math.log(1 + ((deviation or mean / 6) / mean) ** 2)
    return F.exp(F.lit(math.log(mean) - spread / 2) + F.randn(seed) * math.sqrt(spread))


def sub_seed(stream: Column, master: int) -> Column:
    """The first 8 bytes of the MD5 of `stream/master`, as a signed long."""
    digits = F.substring(F.md5(F.concat_ws("/", stream, F.lit(str(master)))), 1, 16)
    unsigned = F.conv(digits, 16, 10).cast("decimal(20,0)")
    return F.when(unsigned > LONG_MAX, unsigned - F.lit(1 << 64).cast("decimal(21,0)")).otherwise(unsigned).cast("long")


def mod_pow(base: Column, exponent: Column, modulus: Column) -> Column:
    """base ^ exponent modulo a modulus under 2^63, by squaring over the exponent's bits in decimals of 38 digits."""
    wide = lambda x: x.cast("decimal(38,0)")
    bits = F.filter(F.split(F.bin(exponent), ""), lambda c: c != "")
    by = lambda a, b: F.pmod(wide(a.cast("decimal(19,0)") * b.cast("decimal(19,0)")), wide(modulus)).cast("decimal(38,0)")
    return F.aggregate(bits, wide(F.lit(1)), lambda r, bit: F.when(bit == "1", by(by(r, r), base)).otherwise(by(r, r)), lambda r: F.pmod(r, wide(modulus)).cast("long"))


def progression(df: DataFrame, start: str, stop: str, step: str) -> DataFrame:
    """`term` for every member of an arithmetic progression, the stop not with it."""
    return df.withColumn("term", F.explode(F.sequence(F.col(start), F.col(stop) - F.sign(F.col(step)).cast("long"), F.col(step))))


#: Fixed value: kinds of arithmetic in the provenance of a value.
ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.when(b != 0, a / b)}


def arithmetic(kind: str, a: Column, b: Column) -> Column:
    return ARITHMETIC[kind](a, b)


def anonymise(df: DataFrame, column: str, known: list[str], suffixes: list[str], prefix: str = "word") -> DataFrame:
    """`anonymous`: known words and numbers stay, a known suffix stays behind the rest, all else is a number by its order among the distinct words.

    Words are numbered within their first character, so no task sorts all of them.
    """
    suffix = F.regexp_extract(column, "(" + "|".join(_quote(s) for s in sorted(suffixes, key=len, reverse=True)) + ")$", 1) if suffixes else F.lit("")
    stem = F.expr(f"substring({column}, 1, length({column}) - length(_suffix))")
    rows = df.withColumn("_suffix", suffix).withColumn("_stem", stem)
    keep = F.col("_stem").isin(*known) | F.col("_stem").rlike(r"^-?\d+(\.\d+)?$") | (F.col("_stem") == "")
    words = rows.where(~keep).select("_stem").distinct()
    numbered = words.select("_stem", F.dense_rank().over(Window.partitionBy(F.substring("_stem", 1, 1)).orderBy("_stem")).alias("_n"), F.hex(F.substring("_stem", 1, 1)).alias("_p"))
    joined = rows.join(numbered, "_stem", "left")
    name = F.when(F.col("_n").isNull(), F.col("_stem")).otherwise(F.concat(F.lit(prefix), F.col("_p"), F.lit("_"), F.col("_n").cast("string")))
    return joined.withColumn("anonymous", F.concat(name, "_suffix")).select(*df.columns, "anonymous")


def _quote(text: str) -> str:
    import re

    return re.escape(text)


def records(spark: SparkSession, n: int, size: int, seed: int = 0) -> DataFrame:
    """(record, key, value): n generated records of about `size` bytes."""
    key = F.lpad(F.hex(F.xxhash64("id", F.lit(seed))), 16, "0")
    return spark.range(n).select(F.col("id").alias("record"), key.alias("key"), F.repeat(F.lit("x"), max(0, size - 16)).alias("value"))


def deep_equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
