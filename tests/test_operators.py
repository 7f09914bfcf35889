"""Edge semantics of the operators on small fixtures."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tracewell.functions import drain, numeric, text
from tracewell.operators import aggregates, fields, graph, joins, partitioning, predicates, windows
from tracewell.plans import callgraph, catalogue, jobs
from tracewell.sources import readers, sinks, splits
from tracewell.streaming import metrics


def column(spark, expr, **row):
    return spark.createDataFrame([tuple(row.values())] if row else [(1,)], list(row) or ["x"]).select(expr.alias("v")).head().v


def test_unique_count_reaches_one_over_its_limit(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "k string, v int")
    assert {r.k: r.n for r in aggregates.unique_count(df, "k", "v", 3).collect()} == {"a": 4, "b": 1}


def test_running_statistics(spark):
    r = aggregates.running_statistics(spark.createDataFrame([(17.0,), (29.0,)], "v double"), "v").head()
    assert (r.n, r.mean, r.variance, r.deviation, r.outlier) == (2, 23.0, 36.0, 6.0, 29.0)


def test_dispatch_has_a_place_for_new_aggregators(spark):
    aggregates.register("firstLetter", lambda v: F.min(F.left(v, F.lit(1))))
    try:
        df = spark.createDataFrame([("FirstLetter:x", "pq"), ("LongValueSum:x", "3"), ("LongValueSum:x", "no")], "key string, value string")
        assert {(r.type, r.report) for r in aggregates.dispatch(df).collect()} == {("FIRSTLETTER", "p"), ("LONGVALUESUM", "3")}
    finally:
        aggregates.AGGREGATORS.pop("FIRSTLETTER")


def test_dispatch_histogram_and_empty_extremes(spark):
    rows = [("ValueHistogram:x", v) for v in "aaabbcd"] + [("ValueHistogram:x", None), ("UniqValueCount:x", "a"), ("UniqValueCount:x", None)]
    rows += [("LongValueMax:x", "none"), ("LongValueMin:x", None), (None, "1")]
    got = {(r.type, r.id): r.report for r in aggregates.dispatch(spark.createDataFrame(rows, "key string, value string")).collect()}
    assert got[("VALUEHISTOGRAM", "x")].split("\t")[:5] == ["4", "1", "2", "3", "1.75"]
    assert got[("UNIQVALUECOUNT", "x")] == "1" and got[(None, None)] is None
    assert got[("LONGVALUEMAX", "x")] == str(-(1 << 63)) and got[("LONGVALUEMIN", "x")] == str((1 << 63) - 1)


def test_int_sum_wraps(spark):
    df = spark.createDataFrame([(2147483647,), (1,), (None,)], "v int")
    assert df.agg(aggregates.int_sum(F.col("v")).alias("s")).head().s == -(1 << 31)


def test_cdf_is_exact_for_null_keys_hot_values_and_no_key(spark):
    import math
    import random

    draw = random.Random(5)
    rows = [(None, draw.randrange(50)) for _ in range(301)] + [("a", 7)] * 200 + [("a", draw.randrange(-900, 900)) for _ in range(997)] + [("b", None), ("c", 3), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    disc = lambda vs, i: sorted(vs)[math.ceil(i * len(vs) / 7) - 1]
    for r in numeric.cdf(df, "v", 7, 7, "k").collect():
        vs = [v for k, v in rows if k == r.k and v is not None]
        assert tuple(r)[1:] == ((min(vs), max(vs), *[disc(vs, i) for i in range(1, 8)]) if vs else (None,) * 9)
    vs = [v for _, v in rows if v is not None]
    assert tuple(numeric.cdf(df, "v", 2, 7).head()) == (min(vs), max(vs), disc(vs, 1), disc(vs, 2))


def test_metric_sum_with_a_null(spark):
    row = spark.sql("SELECT 5 a, cast(null as int) b").select(aggregates.metric_sum(F.col("a"), F.col("b")), aggregates.metric_sub(F.col("b"), F.col("a")), aggregates.metric_compare(F.col("a"), F.col("b"))).head()
    assert tuple(row) == (5, -5, 1)


def test_checksum_does_not_depend_on_order(spark):
    rows = [("b", 2), ("a", 1), (None, 3)]
    want = sum(zlib.crc32(f"{a or ''}\t{b}".encode()) for a, b in rows)
    assert int(aggregates.checksum(spark.createDataFrame(rows, "a string, b int"), "a", "b").head().checksum) == want


def test_override_keeps_all_rows_of_the_last_source(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    two = spark.createDataFrame([(1, "c"), (1, "d")], "k int, v string")
    assert sorted((r.k, r.v) for r in joins.override("k", one, two).collect()) == [(1, "c"), (1, "d"), (2, "b")]


def test_between_join(spark):
    points = spark.createDataFrame([("k", i) for i in range(30)], "k string, at long")
    spans = spark.createDataFrame([("k", 3, 12), ("k", 25, 26)], "k string, a long, z long")
    got = joins.between_join(points, spans, "k", "at", "a", "z", 5)
    assert sorted(r.at for r in got.collect()) == [*range(3, 12), 25]


def test_rolling_average(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 50, 15), ("k", 160, 2)], "k string, ms long, v long")
    assert [r.rolling for r in windows.rolling_average(df, "k", "ms", "v", 100).orderBy("ms").collect()] == [5, 10, 2]


def test_field_selection(spark):
    df = spark.createDataFrame([("a,b,c,d",)], "line string")
    pick = lambda spec: tuple(fields.select_fields(df, "line", spec, ",").head())
    assert pick("0-:") == ("a,b,c,d", None)
    assert pick("2,0:1-2,9") == ("c,a", "b,c")
    assert pick(":1-") == (None, "b,c,d")
    with pytest.raises(ValueError):
        pick("x:")


@pytest.mark.parametrize(
    "rule, wanted",
    [
        ("a == 'x' && n > 1", True),
        ("!(a == 'x') || n <= 1", False),
        ("string.contains(a, 'y') || startsWithAny(a, 'q', 'x')", True),
        ("string.length(a) != 1", False),
        ("n == -2 || n == 2", True),
    ],
)
def test_rules(spark, rule, wanted):
    assert column(spark, predicates.rule_column(rule, {"a": F.col("a"), "n": F.col("n")}), a="x", n=2) is wanted


@pytest.mark.parametrize("rule", ["a ==", "b == 1", "containsAny(a)", "string.startsWith(a)", "(a == 'x'", "a == 'x' c", "foo(a, 'x')", "a ~ 1"])
def test_bad_rules(spark, rule):
    with pytest.raises(predicates.RuleError):
        predicates.rule_column(rule, {"a": F.col("a")})


def test_rule_that_is_no_condition(spark):
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(predicates.RuleError):
        predicates.validate_rule("string.length(a)", df, {"a": F.col("a")})
    assert predicates.ignore(df, "  ", {}).count() == 1


def test_timeline_not_equal_and_the_key(spark):
    df = spark.createDataFrame([({"k": 1},), ({"j": 1},)], "m map<string,long>")
    for expression, n in (("k ne 1", 1), ("k ene 1", 0), ("k eq 1", 1), ("(k ge 1 OR j eq 1) AND k ne 5", 2)):
        assert df.where(predicates.parse_compare(expression, True).column(F.col("m"))).count() == n, expression
    for bad in ("k xx 1", "k eq", "(k eq 1", "k eq 1)", "k eq 1.5", "k eq 1 j eq 2"):
        with pytest.raises(predicates.RuleError):
            predicates.parse_compare(bad, True)
    with pytest.raises(predicates.RuleError):
        predicates.admit("EVENTS", predicates.parse_compare("k eq 1"))


def test_exists_relations_and_prefixes(spark):
    df = spark.createDataFrame([(["a", "b"],), (["c"],)], "e array<string>")
    held = lambda x: [r.e for r in df.where(predicates.parse_exists(x).column(F.col("e"))).collect()]
    assert held("a,b") == [["a", "b"]]
    assert held("!(a)") == [["c"]]
    assert held("c OR a") == [["a", "b"], ["c"]]
    with pytest.raises(predicates.RuleError):
        predicates.parse_relations("type")
    m = F.create_map(F.lit("ab"), F.lit(1), F.lit("cd"), F.lit(2))
    assert column(spark, predicates.retrieve(m, predicates.parse_retrieve("(a)"))) == {"ab": 1}
    assert column(spark, predicates.retrieve(m, predicates.parse_retrieve("!(a)"))) == {"cd": 2}


@pytest.mark.parametrize("glob, name, ok", [("*.txt", "a.txt", True), ("a?c", "abc", True), ("[!a]b", "ab", False), ("{x,y}z", "yz", True), ("a.b", "axb", False)])
def test_globs(spark, glob, name, ok):
    assert column(spark, predicates.name_matches("p", glob), p=f"/d/{name}") is ok


def test_splits():
    assert splits.points(3, 0, 10) == [0, 3, 6, 9, 10]
    assert splits.points(1, 5, 5) == [5, 5]
    assert splits.integers("c", None, None, 4) == ["c IS NULL"]
    assert splits.integers("c", 0, 4, 2, True) == ["c >= 0 AND c < 2", "c >= 2 AND c <= 4", "c IS NULL"]
    assert splits.booleans("c", False, True) == ["c = FALSE", "c = TRUE"]


def test_every_row_is_in_one_split(spark):
    df = spark.createDataFrame([(i if i % 7 else None, i / 3) for i in range(100)], "a long, b double")
    low, high, nulls = splits.bounds(df, "a")
    assert splits.scan(df, splits.integers("a", low, high, 6, nulls)).count() == 100
    assert splits.scan(df, splits.floats("b", 0.0, 33.0, 6)).count() == 100


def java_hash(s):
    h = 0
    for c in s:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return h


def test_partitions(spark):
    words = ["", "a", "hello", "polygenelubricants"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", partitioning.hash_partition("w", 7).alias("p"))
    assert {r.w: r.p for r in df.collect()} == {w: (java_hash(w) & 0x7FFFFFFF) % 7 for w in words}
    numbers = spark.range(0, 100_001, 3).select(partitioning.rehash(F.col("id"), 32).alias("p")).groupBy("p").count().collect()
    mean = sum(r["count"] for r in numbers) / 32
    assert sum(abs(r["count"] - mean) > 0.2 * mean for r in numbers) <= 3


def test_ring_wraps_round(spark):
    places = partitioning.ring(["x", "y"], 3)
    items = [f"i{i}" for i in range(50)]
    import hashlib

    want = {i: next((n for p, n in places if p >= hashlib.md5(i.encode()).hexdigest()), places[0][1]) for i in items}
    got = partitioning.ring_route(spark.createDataFrame([(i,) for i in items], "i string"), "i", spark.createDataFrame(places, "place string, location string"))
    assert {r.i: r.location for r in got.collect()} == want


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "a")]


def test_subgraphs_end_in_cycles(spark):
    e = spark.createDataFrame(EDGES, "caller string, callee string")
    got = graph.subgraphs(e, spark.createDataFrame([("a",), ("d",), ("q",)], "s string"), 9)
    assert sorted((r.seed, r.caller, r.callee, r.depth) for r in got.collect()) == [("a", "a", "b", 0), ("a", "b", "c", 1), ("a", "c", "a", 2), ("a", "c", "d", 2), ("a", "d", "e", 3), ("d", "d", "e", 0)]


def test_reverse_trace_and_its_frontier(spark):
    e = spark.createDataFrame(EDGES, "caller string, callee string")
    traced, frontier = graph.reverse_trace(e, spark.createDataFrame([("a",)], "s string"), 3)
    assert sorted(r.node for r in traced.collect()) == ["a", "b", "c", "x"]
    assert sorted(r.node for r in frontier.collect()) == ["a"]


def test_call_edges(spark):
    rows = [("a", "b", 1, 1), ("a", "b", 1, None), ("a", "c", 0, 1), ("a", "d", 1, 0)]
    assert [tuple(r) for r in graph.call_edges(spark.createDataFrame(rows, "caller string, callee string, enabled int, log_propagation int")).collect()] == [("a", "b")]


def test_clean_text(spark):
    assert column(spark, text.clean_text(F.col("t")), t="  ```xml\n<a>\n x &lt; y\n``` ") == "<a> x < y"
    assert column(spark, text.clean_text(F.col("t")), t="```\nq\n````") == "q ````"
    assert column(spark, text.clean_text(F.col("t")), t=" a \t b ") == "a b"


def test_pairs_are_cut_to_the_shorter_list(spark):
    body = "<exec_flow>1</exec_flow><exec_flow>2\n</exec_flow><log_seq>l</log_seq>"
    assert [tuple(p) for p in column(spark, text.tag_pairs(F.col("t")), t=body)] == [("1", "l")]
    assert column(spark, text.tag_pairs(F.col("t")), t="none") == []
    assert column(spark, text.block(F.col("t")), t="z<enhanced_paths>p</enhanced_paths>q") == "<enhanced_paths>p</enhanced_paths>"


def test_code_functions(spark):
    code = 'int f(int a) { /* { */ return "}"; // x\n}'
    assert column(spark, text.is_method(F.col("t")), t=code)
    assert not column(spark, text.is_method(F.col("t")), t="// f() {\nint x;")
    assert column(spark, text.mask_fields(F.col("t")), t="to /10.1.2.3:80 {a}") == "to <*> <*>"


def test_escapes(spark):
    assert column(spark, text.escape_split(F.col("t")), t="*!cluster!*!b**o***!xer!oozie**") == ["!cluster", "!b*o*!xer", "oozie*"]
    assert column(spark, text.key_values(F.col("t")), t='J a="x\\"y" b="1" a="2"') == {"b": "1", "a": "2"}


def murmur2(data, seed=0):
    m, h = 0x5BD1E995, seed ^ len(data)
    n = len(data) // 4 * 4
    for i in range(0, n, 4):
        k = int.from_bytes(data[i : i + 4], "little") * m & 0xFFFFFFFF
        h = (h * m & 0xFFFFFFFF) ^ ((k ^ k >> 24) * m & 0xFFFFFFFF)
    if data[n:]:
        h = (h ^ int.from_bytes(data[n:], "little")) * m & 0xFFFFFFFF
    h = (h ^ h >> 13) * m & 0xFFFFFFFF
    return h ^ h >> 15


def test_murmur(spark):
    data = [bytes(range(200, 200 + i)) for i in range(12)]
    df = spark.createDataFrame([(bytearray(x),) for x in data], "b binary").select("b", numeric.murmur2(F.col("b")).alias("h"))
    assert {bytes(r.b): r.h for r in df.collect()} == {x: murmur2(x) for x in data}


def test_distributions(spark):
    points = [(0.0, 100000.0), (0.1, 200000.0), (0.5, 800000.0), (0.9, 1000000.0), (1.0, 1100000.0)]
    at = lambda r: column(spark, numeric.piecewise_quantile(F.col("r"), points), r=r)
    assert [at(0.0), at(0.3), at(0.95), at(1.0)] == pytest.approx([100000, 500000, 1050000, 1100000])
    df = spark.createDataFrame([(0.05,), (0.5,), (0.99,)], "r double")
    assert [r.choice for r in numeric.weighted_choice(df, "r", {"a": 1, "b": 8, "c": 1}).collect()] == ["a", "b", "c"]
    assert column(spark, numeric.normal(0, 1, 1)) is None


def test_reversed_bytes_sort_descending(spark):
    values = [-(1 << 63), -5, 0, 7, (1 << 63) - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long").orderBy(numeric.reversed_bytes(F.col("v"))).collect()
    assert [r.v for r in rows] == values[::-1]


def test_templates(spark):
    lines = [(i, f"open block {i} at node{i % 2}") for i in range(6)] + [(9, "close all")]
    got = {r.template: r.occurrences for r in drain.templates(spark.createDataFrame(lines, "n int, line string"), "line", "n", 0.5, 4).collect()}
    assert got == {"open block <*> at <*>": 6, "close all": 1}


def drained(lines, similarity):
    """Occurrences by template, by Drain in plain Python: lines by number of tokens and the first two of them, each distinct one once, in order."""
    groups = {}
    for text, n in collections.Counter(lines).items():
        tokens = text.split(" ")
        known = groups.setdefault((len(tokens), *("<*>" if re.search(r"\d", t) else t for t in tokens[:2])), [])
        best, score = None, (-1, -1)
        for t in known:
            now = sum(a == b for a, b in zip(t[0], tokens)) / len(tokens), t[0].count("<*>")
            if now > score:
                best, score = t, now
        if best and score[0] >= similarity:
            best[0], best[1] = [a if a == b else "<*>" for a, b in zip(best[0], tokens)], best[1] + n
        else:
            known.append([tokens, n])
    out = collections.Counter()
    for t, n in (x for known in groups.values() for x in known):
        out[" ".join(t)] += n
    return out


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.75])
def test_templates_of_large_groups(spark, monkeypatch, similarity):
    """Groups that are cut into runs have the templates of one pass, also where late lines alter them, beside groups that aren't cut."""
    monkeypatch.setattr(drain, "LARGE", 4000)
    draw = random.Random(7)
    words = lambda i: [draw.choice("abcde" if k > 3 or i < 300 else "fghij") for k in range(6)]
    lines = [" ".join(["go", f"n{i}", *words(i)]) for i in range(400)] + ["go <*> a b c d e <*>"] * 3 + [f"stop {draw.choice('xyz')} all" for _ in range(150)] + ["one more"] * 2
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string").repartition(7)
    got = {r.template: r.occurrences for r in drain.templates(df, "line", "n", similarity, 4).collect()}
    assert got == drained(lines, similarity)


def test_large_group_is_not_one_call(spark):
    """Lines of one group, of over 32 MB, aren't handed to one call of a worker."""
    df = spark.range(400_000).select("id", F.format_string("user %s of %s left", F.col("id").cast("string"), (F.col("id") % 7).cast("string")).alias("line"))
    found = drain.templates(df, "line", "id", 0.5, 4)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.template, r.occurrences) for r in found.collect()] == [("user <*> of <*> left", 400_000)]


def test_call_facts(spark, tmp_path):
    (tmp_path / "calls.txt").write_text("1\t1\ta:f()\t(VIR)b:g()\t12\tvoid\n\nshort\t1\nx\t1\tq\tr\t \tint\n")
    rows = readers.call_facts(spark, str(tmp_path)).collect()
    assert [(r.call_seq, r.callee, r.call_line_no) for r in rows] == [(1, "b:g()", 12), (None, "r", None)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abcdef")
    assert [bytes(r.record) for r in readers.fixed_records(spark, str(tmp_path / "a.bin"), 3).collect()] == [b"abc", b"def"]
    (tmp_path / "t.txt").write_bytes(b"abc\ndef\t\nghi\njkl")
    assert [r.value for r in readers.lines(spark, str(tmp_path / "t.txt"), "\t\n").collect()] == ["abc\ndef", "ghi\njkl"]
    (tmp_path / "m.json").write_text('{"a": "1",\n "b": "2"}')
    assert {r.key: r.value for r in readers.json_map(spark, str(tmp_path / "m.json")).collect()} == {"a": "1", "b": "2"}
    (tmp_path / "c.xml").write_text("<configuration><property><name>n</name><value>v</value></property></configuration>")
    assert [tuple(r) for r in readers.xml_properties(spark, str(tmp_path / "c.xml")).collect()] == [("n", "v")]
    (tmp_path / "top.json").write_text('{"name": "root", "children": [{"name": "r1", "children": [{"name": "n1"}]}]}')
    assert sorted(((r.name, r.parent, r.depth) for r in readers.topology(spark, str(tmp_path / "top.json")).collect()), key=str) == [("n1", "r1", 2), ("r1", "root", 1), ("root", None, 0)]
    for d in ("x/classes", "x/target/test-classes"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "A.class").write_bytes(b"\xca\xfe")
    assert [r.directory.rsplit("/", 2)[1:] for r in readers.bytecode_directories(spark, str(tmp_path)).collect()] == [["x", "classes"]]
    assert readers.count_files(spark, str(tmp_path / "x")) == 2 and readers.count_files(spark, str(tmp_path / "none")) == 0
    with pytest.raises(FileNotFoundError):
        readers.globbed(spark, str(tmp_path / "*.nothing"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c")], "seed string, caller string, callee string")
    sinks.edge_lists(df, str(tmp_path / "edges"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "edges")).collect()) == ["a->b", "b->c"]
    rows = spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, v int")
    assert sinks.append_json(rows.limit(1), str(tmp_path / "j"), "key") == 1
    assert sinks.append_json(rows, str(tmp_path / "j"), "key") == 1
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert not sinks.skip_empty(rows.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    sinks.sequence_file(rows.select("key", F.col("v").alias("value")), str(tmp_path / "seq"))
    assert sorted(tuple(r) for r in readers.sequence_file(spark, str(tmp_path / "seq"), True).collect()) == [("k1", "1"), ("k2", "2")]
    for codec in ("gzip", "bzip2", "snappy"):
        sinks.compressed(rows, str(tmp_path / codec), codec)
        assert spark.read.schema(rows.schema).json(str(tmp_path / codec)).count() == 2


def test_compressed_logs(spark):
    nodes = spark.createDataFrame([("m1", "<enhanced_paths>m1</enhanced_paths>"), ("m2", "two"), ("m3", "three")], "signature string, code string")
    signatures = nodes.select("signature")
    import hashlib

    key = lambda s: hashlib.sha256(s.encode()).hexdigest()[:8]
    done = spark.createDataFrame([(key("m3") + "_1",)], "key string")

    def reply(p):
        if p == "two":
            raise RuntimeError
        return f"```xml\n<exec_flow>{p[16:18]} &lt;</exec_flow><log_seq>a</log_seq><exec_flow>2</exec_flow><log_seq>b</log_seq>\n```"

    got = callgraph.compressed_logs(signatures, nodes, done, reply)
    assert sorted(tuple(r) for r in got.collect()) == [(key("m1") + "_1", "m1 <", "a"), (key("m1") + "_2", "2", "b")]


def test_catalogue(spark):
    catalogue.create(spark, "last_sequence_num")
    assert catalogue.seed(spark, "last_sequence_num", 0) and not catalogue.seed(spark, "last_sequence_num", 0)
    assert spark.table("last_sequence_num").count() == 1
    catalogue.drop(spark, "last_sequence_num")


def test_jobs():
    g, seen = jobs.JobGraph(), []
    g.add("c", lambda: seen.append("c"), "a", "b")
    g.add("a", lambda: seen.append("a"))
    g.add("b", lambda: seen.append("b"), "a")
    g.add("bad", lambda: 1 / 0)
    g.add("after", lambda: seen.append("never"), "bad")
    assert g.run() == {"a": "successful", "b": "successful", "c": "successful", "bad": "failed", "after": "failed"} and seen == ["a", "b", "c"]
    waits = []
    with pytest.raises(ZeroDivisionError):
        jobs.retry(lambda: 1 / 0, 3, 0.5, waits.append)
    assert waits == [0.5, 1.0, 2.0]


def test_stream_equals_batch(spark, tmp_path):
    from conftest import TINY

    src = str(tmp_path / "src")
    batch = spark.read.parquet(f"{TINY}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    batch.repartition(3).write.parquet(src)
    stream = metrics.read(spark, src, "ts timestamp, event_type string, value double")
    seen = []
    q = metrics.pipeline(stream, F.col("value") > 10, {"count": lambda b, n: seen.append(b.count())}, str(tmp_path / "cp"))
    q.awaitTermination()
    assert sum(seen) == batch.where("value > 10").count()
    out = metrics.windowed_average(stream, "ts", "event_type", "value", "1 day", late="60 days")
    q = out.writeStream.format("memory").queryName("averages").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.start, r.event_type): r.n for r in metrics.windowed_average(batch, "ts", "event_type", "value", "1 day").collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("averages").collect()} == want


def test_hierarchies_end_whole_or_with_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "c long, p long")
    assert graph.hierarchy(chain, "c", "p", 6).count() == 21
    with pytest.raises(ValueError):
        graph.hierarchy(chain, "c", "p", 5)
    tree = spark.createDataFrame([(i, i - 1 if i else None, str(i)) for i in range(6)], "n long, p long, name string")
    assert graph.tree_paths(tree, "n", "p", "name", 5).count() == 6
    with pytest.raises(ValueError):
        graph.tree_paths(tree, "n", "p", "name", 4)
