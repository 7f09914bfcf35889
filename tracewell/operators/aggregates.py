"""Aggregations: word counts, the value aggregators and their dispatch, running statistics, roll-ups, metric calculus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words.
SPACES = "[ \\t\\n\\r\\f]+"


def word_count(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): words between white space."""
    words = df.select(F.explode(F.split(text, SPACES)).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def grep_count(df: DataFrame, text: str, pattern: str, group: int = 0) -> DataFrame:
    """(match, n) in order of n, most first, then match."""
    found = df.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("match"))
    return found.groupBy("match").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "match")


def word_histogram(df: DataFrame, text: str = "text") -> DataFrame:
    """One row on how often the words occur, split at each single space or tab, empty words with them: number of words, least, most, median
    (lower), mean and population deviation of their counts."""
    counts = df.select(F.explode(F.split(text, "[ \\t]")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("words"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("long").alias("median"),
        F.avg("n").alias("mean"),
        F.stddev_pop("n").alias("deviation"),
    )


#: The reports of a greatest and a least integer that no value went into.
LEAST_LONG, GREATEST_LONG = -(1 << 63), (1 << 63) - 1

#: Aggregators by upper-case name: from the string column of values to the string column of a report. Text that a numeric type can't read is left out.
AGGREGATORS: dict[str, Callable[[Column], Column]] = {
    "LONGVALUESUM": lambda v: F.sum(v.try_cast("long")).cast("string"),
    "DOUBLEVALUESUM": lambda v: F.sum(v.try_cast("double")).cast("string"),
    "LONGVALUEMAX": lambda v: F.coalesce(F.max(v.try_cast("long")), F.lit(LEAST_LONG)).cast("string"),
    "LONGVALUEMIN": lambda v: F.coalesce(F.min(v.try_cast("long")), F.lit(GREATEST_LONG)).cast("string"),
    "STRINGVALUEMAX": lambda v: F.max(v),
    "STRINGVALUEMIN": lambda v: F.min(v),
}

#: Aggregators of how often each distinct value occurs: from the column of these counts, null for a null value, to the report. A histogram's
#: report is the number of values, then the least, median (upper), greatest, mean and population deviation of their counts, tabs between.
COUNTED: dict[str, Callable[[str], Column]] = {
    "UNIQVALUECOUNT": lambda n: F.count(n).cast("string"),
    "VALUEHISTOGRAM": lambda n: F.concat_ws(
        "\t",
        F.count(n),
        F.min(n),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {n} DESC)").cast("long"),
        F.max(n),
        F.avg(n),
        F.stddev_pop(n),
    ),
}


def register(name: str, report: Callable[[Column], Column]) -> None:
    """Adds an aggregator under a name, in any case, for `dispatch`."""
    AGGREGATORS[name.upper()] = report


def _by_type(reports: dict[str, Column]) -> Column:
    """The report of the row's own type; null for any other type."""
    out = F.lit(None).cast("string")
    for name, report in reports.items():
        out = F.when(F.col("type") == name, report).otherwise(out)
    return out.alias("report")


def dispatch(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(id, type, report): rows with keys `TYPE:id` go to the aggregator of that type, in any case; other types give null.

    Two passes whatever the number of types: one for the aggregators of values, one for those of distinct values' counts. Partial results are made
    before each shuffle.
    """
    kind = F.upper(F.substring_index(key, ":", 1))
    typed = df.select(kind.alias("type"), F.expr(f"substring({key}, instr({key}, ':') + 1)").alias("id"), F.col(value).cast("string").alias("v"))
    counting = F.col("type").isin(*COUNTED)
    own = {name: report(F.when(F.col("type") == name, F.col("v"))) for name, report in AGGREGATORS.items()}
    plain = typed.where(~counting | F.col("type").isNull()).groupBy("id", "type").agg(_by_type(own))
    counts = typed.where(counting).groupBy("id", "type", "v").agg(F.count("v").alias("n")).withColumn("n", F.when(F.col("v").isNotNull(), F.col("n")))
    return plain.unionByName(counts.groupBy("id", "type").agg(_by_type({name: report("n") for name, report in COUNTED.items()})))


def int_sum(value: Column) -> Column:
    """A sum of 32-bit integers that wraps around as they do."""
    low = F.pmod(F.sum(value.cast("long")), F.lit(1 << 32))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def unique_count(df: DataFrame, key: str, value: str, most: int | None = None) -> DataFrame:
    """(key, n): distinct values, exact; with a limit, counting ends at the first value beyond it, so n is at most most + 1."""
    n = F.count_distinct(value)
    return df.groupBy(key).agg((n if most is None else F.least(n, F.lit(most + 1).cast("long"))).alias("n"))


def value_histogram(df: DataFrame, value: str) -> DataFrame:
    """(value, n): how often each value occurs."""
    return df.groupBy(value).agg(F.count("*").alias("n"))


def value_count(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def count_and_time(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Counts and summed times by keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(time).alias("time"))


def checksum(df: DataFrame, *columns: str) -> DataFrame:
    """The sum of the CRC-32 of each row's columns: rows in any order have the same."""
    row = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.crc32(row).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("checksum"))


def code_counts(df: DataFrame, code: str, codes: list[str]) -> DataFrame:
    """(code, n) for every code of the list, 0 where none occurs; other codes are left out."""
    spark = df.sparkSession
    listed = spark.createDataFrame([(c,) for c in codes], "code string")
    counted = df.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n"))
    return listed.join(counted, "code", "left").select("code", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


#: Lower bounds of the buckets of a name's frequency, and the bytes an array costs beside its characters.
NAME_BUCKETS, ARRAY_OVERHEAD = (100000, 10000, 1000, 100, 10, 5, 4, 3, 2), 24


def name_distribution(df: DataFrame, path: str) -> DataFrame:
    """(bucket, names, files, savings) of base names: a name is in the first bucket whose bound its frequency reaches; savings are the bytes that one
    shared copy of each name would save."""
    counted = df.groupBy(F.substring_index(path, "/", -1).alias("name")).agg(F.count("*").alias("n"))
    bucket = F.coalesce(*[F.when(F.col("n") >= b, b) for b in NAME_BUCKETS]).cast("long")
    saved = (F.length("name") + ARRAY_OVERHEAD) * (F.col("n") - 1)
    rows = counted.select(bucket.alias("bucket"), "n", saved.alias("s")).where("bucket is not null")
    return rows.groupBy("bucket").agg(F.count("*").alias("names"), F.sum("n").alias("files"), F.sum("s").alias("savings"))


def running_statistics(df: DataFrame, value: str, *keys: str, sigmas: float = 1.0) -> DataFrame:
    """count, mean, population variance (not under 0) and deviation, the outlier bound mean + sigmas deviations, and the upper end of the
    95 % interval of the mean."""
    v = F.col(value).cast("double")
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.greatest(F.var_pop(v), F.lit(0.0)).alias("variance"))
    out = out.withColumn("deviation", F.sqrt("variance"))
    return out.withColumn("outlier", F.col("mean") + F.col("deviation") * sigmas).withColumn("upper95", F.col("mean") + F.col("deviation") * 1.96 / F.sqrt("n"))


def aggregation_ops(df: DataFrame, keys: list[str], value: str, ts: str) -> DataFrame:
    """The flow-run operations on cells: global minimum and maximum, sum, and the least and greatest of the latest cells."""
    latest = df.groupBy(*keys).agg(F.max(ts).alias("_ts"))
    last = df.withColumnRenamed(ts, "_ts").join(latest, [*keys, "_ts"]).groupBy(*keys).agg(F.min(value).alias("latest_min"), F.max(value).alias("latest_max"))
    return df.groupBy(*keys).agg(F.min(value).alias("global_min"), F.max(value).alias("global_max"), F.sum(value).alias("sum")).join(last, keys)


def flow_runs(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """First start and last end of every run."""
    return df.groupBy(*keys).agg(F.min(start).alias("started"), F.max(end).alias("ended"))


def tracks(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Sums for each prefix of the levels (application, flow, user, queue ...): one pass over grouping sets; `track` is the number of
    levels that a row keeps."""
    kept = len(levels) - sum((F.grouping(c).cast("int") for c in levels), F.lit(0))
    return df.rollup(*levels).agg(F.sum(value).alias("total"), F.count("*").alias("n"), kept.cast("int").alias("track"))


def metric_sum(a: Column, b: Column) -> Column:
    """Null is no value: the sum of one is that one."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def metric_sub(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), -b).when(b.isNull(), a).otherwise(a - b)


def metric_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null is less than all."""
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).when(a > b, 1).otherwise(0)


def metric_kinds(df: DataFrame, name: str, value: str, ts: str) -> DataFrame:
    """By metric: counter (sum), gauge (last value; of equal times the greatest), rate (count and mean)."""
    v = F.col(value)
    return df.groupBy(name).agg(F.sum(v).alias("counter"), F.max_by(v, F.struct(F.col(ts), v)).alias("gauge"), F.count(v).alias("samples"), F.avg(v).alias("rate"))


def merge_statistics(df: DataFrame, entries: str) -> DataFrame:
    """(key, total): sums of maps, key by key."""
    return df.select(F.explode(entries).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def progress_buckets(df: DataFrame, key: str, progress: str, value: str, buckets: int) -> DataFrame:
    """(key, bucket, cumulative, state): a sample's growth since the one before goes to its bucket of progress [0, 1]; state is the mean of the
    two, weighted by the progress between them, over the bucket's share."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(progress, value)
    p, v = F.col(progress), F.col(value)
    before, was = F.coalesce(F.lag(v).over(w), F.lit(0.0)), F.coalesce(F.lag(p).over(w), F.lit(0.0))
    rows = df.select(key, F.least(F.floor(p * buckets), F.lit(buckets - 1)).cast("int").alias("bucket"), (v - before).alias("growth"), ((v + before) / 2 * (p - was)).alias("area"))
    return rows.groupBy(key, "bucket").agg(F.sum("growth").alias("cumulative"), (F.sum("area") * buckets).alias("state"))


def row_hashes(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, n, hash): an order-free digest of each key's rows."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.crc32(F.concat_ws("\t", *columns)).cast("decimal(38,0)")).alias("hash"))
