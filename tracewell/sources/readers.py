"""Readers: text in its variants, key/value lines, JSON, XML properties, binary records, sequence files, listings."""

from __future__ import annotations

import configparser
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.fields import key_value

#: Fixed value: the columns of the call table.
CALL_SCHEMA = T.StructType(
    [
        T.StructField("call_seq", T.IntegerType()),
        T.StructField("enabled", T.IntegerType()),
        T.StructField("caller", T.StringType()),
        T.StructField("callee", T.StringType()),
        T.StructField("call_line_no", T.IntegerType()),
        T.StructField("call_return_type", T.StringType()),
        T.StructField("log_propagation", T.IntegerType()),
    ]
)


def bytecode_directories(spark: SparkSession, root: str, excluded: str = "target/test-classes") -> DataFrame:
    """(directory), sorted and distinct: those that hold a .class file and whose path hasn't the excluded part."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.class").load(root).select("path")
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("directory")).where(~F.contains("directory", F.lit(excluded))).distinct().orderBy("directory")


def count_files(spark: SparkSession, root: str) -> int:
    """Files under a folder, 0 where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getFileCount() if fs.exists(p) and fs.getFileStatus(p).isDirectory() else 0


def call_facts(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated call facts as the call table: blank lines and lines under six fields dropped (trailing blanks are trimmed first), the callee's
    `(TYPE)` prefix taken off, numbers that can't be read null, log_propagation 1."""
    return parse_call_facts(spark.read.text(path))


def parse_call_facts(lines: DataFrame, line: str = "value") -> DataFrame:
    f = F.split(F.trim(F.regexp_replace(line, r"^\s+|\s+$", "")), "\t")
    rows = lines.select(f.alias("f")).where(F.size("f") >= 6)
    number = lambda i: F.trim(F.get("f", i)).try_cast("int")
    return rows.select(
        number(0).alias("call_seq"),
        number(1).alias("enabled"),
        F.get("f", 2).alias("caller"),
        F.regexp_replace(F.get("f", 3), r"^\([^)]+\)", "").alias("callee"),
        number(4).alias("call_line_no"),
        F.get("f", 5).alias("call_return_type"),
        F.lit(1).alias("log_propagation"),
    )


def lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(value): lines, or records with another separator."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path)


def signatures(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.trim("value").alias("signature"))


def key_value_lines(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    return key_value(lines(spark, path), "value", separator)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of files that are one JSON object of strings; a file that can't be read gives no rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def json_rows(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = True) -> DataFrame:
    """JSON objects; those that can't be read are in `_corrupt_record` if the schema has it, else null."""
    reader = spark.read.option("multiLine", multiline).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def fixed_records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(record binary): records of a fixed length, which must be over 0. Spark's DataFrame readers have no such format."""
    if size <= 0:
        raise ValueError("records have one byte at least")
    return spark.sparkContext.binaryRecords(path, size).map(lambda r: (bytearray(r),)).toDF("record binary")


def sequence_file(spark: SparkSession, path: str, as_text: bool = False) -> DataFrame:
    """(key, value) of a sequence file."""
    df = spark.sparkContext.sequenceFile(path).toDF(["key", "value"])
    return df.select(F.col("key").cast("string"), F.col("value").cast("string")) if as_text else df


def read_by_path(spark: SparkSession, readers: dict[str, Callable[[SparkSession, str], DataFrame]]) -> DataFrame:
    """The union of paths, each with its own reader, and `input`, the path."""
    out = None
    for path, reader in readers.items():
        part = reader(spark, path).withColumn("input", F.lit(path))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def detect(spark: SparkSession, path: str) -> DataFrame:
    """A sequence file if it begins with SEQ, else lines."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 3).alias("h")).limit(1).head()
    return sequence_file(spark, path, as_text=True) if head and bytes(head.h) == b"SEQ" else lines(spark, path)


def xml_properties(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a job configuration in XML."""
    return spark.read.format("xml").option("rowTag", "property").schema("name string, value string").load(path)


def topology(spark: SparkSession, path: str, most: int = 16) -> DataFrame:
    """(name, parent, depth) of a JSON network tree of objects with `name` and `children`."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    out, level = None, whole
    for depth in range(most):
        rows = level.select(F.variant_get("node", "$.name", "string").alias("name"), "parent", "depth")
        out = rows if out is None else out.unionByName(rows)
        kids = F.explode(F.coalesce(F.variant_get("node", "$.children", "array<variant>"), F.array().cast("array<variant>")))
        level = level.select(kids.alias("node"), F.variant_get("node", "$.name", "string").alias("parent"), F.lit(depth + 1).alias("depth"))
        if level.isEmpty():
            break
    return out


def listed_paths(spark: SparkSession, listing: str) -> list[str]:
    """The paths of a file that lists them, one on a line."""
    return [r.value for r in lines(spark, listing).where("trim(value) <> ''").collect()]


def globbed(spark: SparkSession, *patterns: str) -> list[str]:
    """The paths that globs match; no pattern, and a pattern without a match, are errors."""
    if not patterns:
        raise ValueError("no source")
    out = []
    for pattern in patterns:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
        found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
        if not len(found):
            raise FileNotFoundError(pattern)
        out += [f.getPath().toString() for f in found]
    return out


def virtual(spark: SparkSession, mappers: int | None) -> DataFrame:
    """(mapper): one empty split for each mapper; their number must be given."""
    if not mappers:
        raise ValueError("the number of mappers is not set")
    return spark.range(0, mappers, 1, mappers).select(F.col("id").alias("mapper"))


def settings(path: str) -> dict[str, object]:
    """Host, port, user, password, database and charset of an INI file's first section."""
    ini = configparser.ConfigParser()
    ini.read(path)
    section = ini[ini.sections()[0]]
    return {**section, "port": int(section.get("port", "3306")), "charset": section.get("charset", "utf8mb4")}


def select_csv(spark: SparkSession, path: str, sql: str, header: bool = True, delimiter: str = ",", quote: str = '"') -> DataFrame:
    """SQL over one CSV object, named `s3object`; projections and filters go to the scan."""
    spark.read.options(header=header, sep=delimiter, quote=quote, inferSchema=True).csv(path).createOrReplaceTempView("s3object")
    return spark.sql(sql)




def lines_per_split(spark: SparkSession, path: str, n: int = 1) -> DataFrame:
    """(split, value): n lines in a split, by their order in the input."""
    numbered = lines(spark, path).select("value", F.monotonically_increasing_id().alias("at"))
    base = numbered.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("c"))
    from pyspark.sql import Window

    before = base.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("before"))  # a row for each input partition
    joined = numbered.withColumn("p", F.shiftright("at", 33)).join(F.broadcast(before), "p")
    return joined.select(F.floor((F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))) / n).alias("split"), "value")


def typed_bytes(spark: SparkSession, raw: bytes, path: str) -> int:
    """Pairs of typed bytes into a sequence file of binary keys and values; -1 if the path is there already."""
    from ..operators.processes import from_typed_bytes, to_typed_bytes

    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return -1
    values = from_typed_bytes(raw)
    pairs = [(bytearray(to_typed_bytes(k)), bytearray(to_typed_bytes(v))) for k, v in zip(values[::2], values[1::2])]
    spark.sparkContext.parallelize(pairs).saveAsSequenceFile(path)
    return 0


def register_source(spark: SparkSession, name: str, read: Callable[[dict], Callable[[], object]], schema: str) -> None:
    """A record reader of one's own under a name for `spark.read.format`: read(options) gives tuples of the schema."""
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def read(self, partition):
            yield from read(self.options)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(dict(self.options))

    spark.dataSource.register(Source)
