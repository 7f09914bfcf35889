import pytest
from pyspark.sql import functions as F

from tracewell.operators import processes
from tracewell.sources import readers


def test_pipe(spark):
    df = spark.createDataFrame([(f"k{i % 3}", str(i)) for i in range(30)], "key string, value string")
    assert sorted(map(tuple, processes.pipe(df, ["cat"]).collect())) == sorted(map(tuple, df.collect()))
    counted = processes.pipe(df, ["awk", "-F\\t", '{n[$1]++} END {for (k in n) print k "\\t" n[k]}'], grouped=True)
    assert {r.key: r.value for r in counted.collect()} == {"k0": "10", "k1": "10", "k2": "10"}
    with pytest.raises(Exception, match="ended with"):
        processes.pipe(df, ["false"]).collect()


def test_typed_bytes(spark, tmp_path):
    values = [True, 5, -(1 << 40), 2.5, "é", b"ab", (1, "x"), [1, [2]], {"k": (3,)}]
    assert processes.from_typed_bytes(b"".join(map(processes.to_typed_bytes, values))) == values
    raw = processes.to_typed_bytes("k") + processes.to_typed_bytes(7)
    assert readers.typed_bytes(spark, raw, str(tmp_path / "seq")) == 0 and readers.typed_bytes(spark, raw, str(tmp_path / "seq")) == -1
    assert [processes.from_typed_bytes(bytes(r.value)) for r in readers.sequence_file(spark, str(tmp_path / "seq")).collect()] == [[7]]


def test_user_code(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 2.0)], "k string, v double")
    assert {r.k: r.report for r in processes.aggregate(df, ["k"], "v", lambda s: s.max() - s.min()).collect()} == {"a": 4.0, "b": 0.0}
    assert processes.map_rows(df, lambda b: b.assign(v=b.v * 2), "k string, v double").agg(F.sum("v")).head()[0] == 16
    lines = spark.createDataFrame([("x=1,y=2",), (None,), ("",)], "line string")
    got = processes.parse_lines(lines, "line", lambda s: [tuple(p.split("=")) for p in s.split(",") if p], "k string, v string")
    assert sorted(map(tuple, got.collect())) == [("x", "1"), ("y", "2")]
    assert processes.counters(df, many=F.col("v") > 1.5).head().many == 2


def test_property_values(spark):
    df = spark.createDataFrame([("a", "12"), ("b", "1.5"), ("c", "true"), ("d", "x y"), ("e", "007")], "n string, v string")
    got = processes.property_values(df, "n", "v").select("n", F.schema_of_variant("typed").alias("t")).collect()
    assert [r.t for r in got] == ["BIGINT", "DECIMAL(2,1)", "BOOLEAN", "STRING", "STRING"]


def test_lines_per_split(spark, tmp_path):
    (tmp_path / "x.txt").write_text("\n".join(map(str, range(10))) + "\n")
    got = readers.lines_per_split(spark, str(tmp_path / "x.txt"), 4).groupBy("split").count().collect()
    assert sorted((r.split, r["count"]) for r in got) == [(0, 4), (1, 4), (2, 2)]
