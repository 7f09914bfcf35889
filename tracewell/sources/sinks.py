"""Sinks. Spark's commit protocol makes a task's files appear once; a failed task leaves none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jdbc(df: DataFrame, url: str, table: str, batch: int = 1000, properties: dict[str, str] | None = None) -> None:
    df.write.mode("append").option("batchsize", batch).jdbc(url, table, properties=properties or {})


def edge_lists(df: DataFrame, path: str, seed: str = "seed") -> None:
    """Lines `caller->callee`, a folder for each seed, named by the first 8 hex digits of its SHA-256."""
    rows = df.select(F.left(F.sha2(seed, 256), F.lit(8)).alias("key"), F.concat_ws("->", "caller", "callee").alias("value"))
    rows.repartition("key").write.partitionBy("key").text(path)


def append_json(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key isn't there yet; how many those were."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    new = df.join(spark.read.schema(df.schema).json(path).select(key), key, "left_anti") if there else df
    new = new.persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").json(path)
        return n
    finally:
        new.unpersist()


def line_list(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.text(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def record_csv(df: DataFrame, path: str) -> None:
    """Booleans as T and F, comma-separated, no header."""
    cols = [F.when(F.col(c), "T").when(~F.col(c), "F").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.csv(path)


def skip_empty(df: DataFrame, path: str) -> bool:
    """Writes nothing, not even a folder, if there are no rows."""
    if df.isEmpty():
        return False
    df.write.parquet(path)
    return True


def sequence_file(df: DataFrame, path: str, codec: str | None = None) -> None:
    """(key, value) as a sequence file; the path must not exist."""
    df.select("key", "value").rdd.map(tuple).saveAsSequenceFile(path, codec)


def sorted_file(df: DataFrame, path: str, *keys: str, partitions: int = 8) -> None:
    """Sorted ranges, whose Parquet statistics are the index."""
    df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).write.parquet(path)


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def by_key(df: DataFrame, path: str, key: str, form: str = "parquet") -> None:
    """A folder for each key."""
    df.write.partitionBy(key).format(form).save(path)


def metric_lines(df: DataFrame) -> DataFrame:
    """(value) `ts context.name: tag=v, metric=v` of the columns ts, context, name, tags and metrics (maps, by key)."""
    pair = lambda m: F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    head = F.concat(F.col("ts").cast("string"), F.lit(" "), F.col("context"), F.lit("."), F.col("name"), F.lit(": "))
    return df.select(F.concat(head, F.array_join(F.concat(pair("tags"), pair("metrics")), ", ")).alias("value"))


def gauge_messages(df: DataFrame) -> DataFrame:
    """(name, type, units, value) messages of metrics; those without a name, type or value are left out."""
    return df.where("name is not null and type is not null and value is not null").select("name", "type", F.coalesce("units", F.lit("")).alias("units"), F.col("value").cast("string").alias("value"))


def xml(df: DataFrame, path: str, row: str = "record", root: str = "records") -> None:
    df.write.format("xml").option("rowTag", row).option("rootTag", root).save(path)


def indented(df: DataFrame) -> DataFrame:
    """(value): each row as indented JSON."""
    return df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))


def compressed(df: DataFrame, path: str, codec: str, form: str = "json") -> None:
    """With one of Spark's codecs: none, deflate, gzip, bzip2, lz4, snappy, zstd."""
    df.write.option("compression", codec).format(form).save(path)


