"""The registered queries of the library's own operators, and the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import drain, numeric, text
from .operators import aggregates, fields, graph, joins, ordering, partitioning, predicates, sets, windows
from .plans import callgraph
from .sources import readers, sinks, splits
from .streaming import metrics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("decimal(28,2)")


# --- sources and splits -------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def s26_int_splits(spark, d):
    df = t(spark, d, "lineitem")
    low, high, nulls = splits.bounds(df, "l_orderkey")
    return splits.scan(df, splits.integers("l_orderkey", low, high, 4, nulls)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_retailprice FROM part")
def s27_float_splits(spark, d):
    df = t(spark, d, "part")
    low, high, nulls = splits.bounds(df, "p_retailprice")
    return splits.scan(df, splits.floats("p_retailprice", low, high, 4, nulls)).select("p_partkey", "p_retailprice")


@query("SELECT o_orderkey, o_totalprice > 150000 AS large FROM orders")
def s28_boolean_splits(spark, d):
    df = t(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") > 150000).alias("large"))
    low, high, nulls = splits.bounds(df, "large")
    return splits.scan(df, splits.booleans("large", low, high, nulls)).drop("split")


@query("SELECT o_orderkey FROM orders")
def s29_date_splits(spark, d):
    df = t(spark, d, "orders")
    low, high, nulls = splits.bounds(df, "o_orderdate")
    return splits.scan(df, splits.timestamps("o_orderdate", str(low), str(high), 4, nulls)).select("o_orderkey")


@query("SELECT event_id AS call_seq, 1 AS enabled, event_type AS caller, 'T' || user_id AS callee FROM events WHERE event_id % 7 <> 0")
def s03_call_facts(spark, d):
    e = t(spark, d, "events")
    kept = F.concat_ws("\t", F.col("event_id").cast("string"), F.lit("1"), "event_type", F.concat(F.lit("(VIR)T"), F.col("user_id").cast("string")), F.lit("x"), F.lit("void"))
    short = F.concat_ws("\t", F.col("event_id").cast("string"), F.lit("1"), "event_type")
    lines = e.select(F.when(F.col("event_id") % 7 == 0, short).otherwise(kept).alias("value"))
    return readers.parse_call_facts(lines).select(F.col("call_seq").cast("long").alias("call_seq"), "enabled", "caller", "callee")


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS "Date", upper(event_type) AS "Level", user_id::VARCHAR AS "Node", event_type || ' took ' || event_id AS "Content" FROM events"""
)
def s09_header_scan(spark, d):
    e = t(spark, d, "events")
    line = F.format_string("%s %s - %s  [%s:comp@%s] - %s took %s", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), F.upper("event_type"), F.col("user_id").cast("string"), F.col("event_id").cast("string"), "event_type", F.col("event_id").cast("string"))
    return drain.read_header(e.select(line.alias("line")), "line", r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>").select("Date", "Level", "Node", "Content")


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer UNION ALL SELECT r_name, '' FROM region")
def s11_key_value(spark, d):
    with_key = t(spark, d, "customer").select(F.concat_ws("\t", "c_name", "c_mktsegment").alias("line"))
    return fields.key_value(with_key.unionByName(t(spark, d, "region").select(F.col("r_name").alias("line"))), "line")


# --- projections and predicates -----------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def f01_equality(spark, d):
    return predicates.by_example(t(spark, d, "lineitem"), {"l_returnflag": "R", "l_linestatus": "F", "l_tax": None}).select("l_orderkey", "l_linenumber")


@query("SELECT n_name FROM nation WHERE NOT ((starts_with(n_name, 'NATION_1') AND n_regionkey <> 2) OR length(n_name) < 8)")
def f03_ignore_rule(spark, d):
    n = t(spark, d, "nation")
    rule = "(string.startsWith(name, 'NATION_1') && region != 2) || string.length(name) < 8"
    return predicates.ignore(n, rule, {"name": F.col("n_name"), "region": F.col("n_regionkey")}).select("n_name")


@query("SELECT p_partkey FROM part WHERE NOT (contains(p_name, 'cold') OR contains(p_name, 'small') OR p_brand = 'Brand#1' OR p_brand = 'Brand#2' OR ends_with(p_type, 'D') OR ends_with(p_type, 'Y'))")
def x10_any_functions(spark, d):
    rule = "containsAny(name, 'cold', 'small') || equalsAny(brand, 'Brand#1', 'Brand#2') || endsWithAny(type, 'D', 'Y')"
    return predicates.ignore(t(spark, d, "part"), rule, {"name": F.col("p_name"), "brand": F.col("p_brand"), "type": F.col("p_type")}).select("p_partkey")


@query("SELECT s_suppkey FROM supplier WHERE NOT (s_suppkey % 3 = 0 AND s_nationkey >= 10)")
def f07_method_rule(spark, d):
    full = F.concat(F.lit("a.b.C"), (F.col("s_suppkey") % 3).cast("string"), F.lit(":m("), F.when(F.col("s_nationkey") >= 10, "int,long").otherwise(""), F.lit(")"))
    rule = "ee_simple_class_name == 'C0' && ee_method_arg_num == 2 && ee_package_name == 'a.b' && ee_method_name == 'm'"
    return predicates.ignore(t(spark, d, "supplier"), rule, predicates.method_variables(full, "ee_")).select("s_suppkey")


@query("SELECT p_brand || '|' || p_size AS key, p_type || '|' || p_name AS value FROM part")
def f11_field_selection(spark, d):
    line = F.concat_ws("|", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
    return fields.select_fields(t(spark, d, "part").select(line.alias("line")), "line", "1,3:2,0", "|")


@query("SELECT n_nationkey AS key, n_name AS value FROM nation")
def f12_inverse(spark, d):
    return fields.inverse(t(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("value")))


@query("SELECT unnest(regexp_extract_all(p_name, '([a-z])[a-z]+', 1)) AS match, 1::BIGINT AS one FROM part")
def f14_regex_extract(spark, d):
    return fields.regex_extract(t(spark, d, "part"), "p_name", "([a-z])[a-z]+", 1)


@query("SELECT event_id FROM events WHERE (json_extract(props, '$.k')::BIGINT >= 50 AND json_extract(props, '$.k')::BIGINT <> 60) OR json_extract(props, '$.k')::BIGINT < 5")
def f15_timeline_metrics(spark, d):
    wanted = predicates.parse_compare("(k ge 50 AND k ne 60) OR k lt 5", numeric=True)
    predicates.admit("METRICS", wanted)
    return t(spark, d, "events").where(wanted.column(F.from_json("props", "map<string,bigint>"))).select("event_id")


@query("SELECT event_id FROM events WHERE event_type <> 'click'")
def f16_timeline_configs(spark, d):
    info = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("type"), F.col("event_type"))).otherwise(F.create_map(F.lit("kind"), F.col("event_type")))
    wanted = predicates.parse_compare("type ne click AND kind ne click")
    predicates.admit("CONFIGS", wanted)
    return t(spark, d, "events").where(wanted.column(info)).select("event_id")


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'click' AND value < 5) > 0 AND count(*) FILTER (WHERE event_type = 'error' AND value < 5) = 0")
def f18_timeline_events(spark, d):
    small = t(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") < 5, F.col("event_type"))).alias("seen"))
    return small.where(predicates.parse_exists("click AND !(error)").column(F.col("seen"))).select("user_id")


@query("SELECT n_regionkey FROM nation GROUP BY n_regionkey HAVING bool_or(n_nationkey = 0) AND bool_or(n_nationkey = 10) ")
def f17_timeline_relations(spark, d):
    n = t(spark, d, "nation").groupBy("n_regionkey").agg(F.create_map(F.lit("nation"), F.collect_set(F.col("n_nationkey").cast("string"))).alias("r"))
    wanted = predicates.parse_relations("nation:0:10")
    return n.where(wanted.column(F.col("r"))).select("n_regionkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-c].*widget$')")
def f24_glob(spark, d):
    return t(spark, d, "part").where(predicates.name_matches("p_name", "[a-c]*widget")).select("p_partkey")


@query("SELECT DISTINCT p_type FROM part WHERE NOT (p_type LIKE 'E%' OR p_type = 'PROMO')")
def f27_copy_filter(spark, d):
    return t(spark, d, "part").where(predicates.copy_filter("p_type", ["E.*", "PROMO"])).select("p_type").distinct()


@query("SELECT event_id AS relative_ts, 'u' || user_id AS ugi, event_type AS command FROM events")
def f28_audit_columns(spark, d):
    line = F.concat_ws("\u0001", F.col("event_id").cast("string"), F.concat(F.lit("u"), F.col("user_id").cast("string")), "event_type", F.lit("/a"), F.lit(""), F.lit("1.1.1.1"))
    return fields.audit_columns(t(spark, d, "events").select(line.alias("line")), "line").select("relative_ts", "ugi", "command")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'a.x' END AS kept, CASE WHEN o_custkey % 2 = 1 THEN 'b.x' END AS other FROM orders")
def f19_prefix(spark, d):
    named = F.create_map(F.when(F.col("o_custkey") % 2 == 0, "a.x").otherwise("b.x"), F.col("o_custkey"))
    first = lambda op: F.get(F.map_keys(predicates.Prefix(op, "a.").entries(named)), F.lit(0))
    return t(spark, d, "orders").select("o_orderkey", first("=").alias("kept"), first("!=").alias("other"))


@query("SELECT p_partkey, p_size > 10 AND starts_with(p_brand, 'Brand#1') AS passes, p_size > 5 AND p_size < 40 AS descend FROM part")
def f25_find_and(spark, d):
    size = F.col("p_size")
    passes, descend = predicates.find_and((size > 10, size > 5), (F.startswith("p_brand", F.lit("Brand#1")), size < 40))
    return t(spark, d, "part").select("p_partkey", passes.alias("passes"), descend.alias("descend"))


@query("SELECT DISTINCT p_type, p_type LIKE 'S%' OR NOT (p_type LIKE '%D' OR p_type LIKE 'E%') AS kept, p_type NOT LIKE 'E%' AS not_excluded FROM part")
def f26_metric_filter(spark, d):
    kept = predicates.metric_filter(F.col("p_type"), ["S*"], ["*D", "E*"])
    return t(spark, d, "part").select("p_type", kept.alias("kept"), predicates.metric_filter(F.col("p_type"), exclude=["E.*"], globs=False).alias("not_excluded")).distinct()


# --- joins and sets -----------------------------------------------------------------------------------------------


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j01_known(spark, d):
    c = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.known(t(spark, d, "orders"), c, "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000)")
def j02_unprocessed(spark, d):
    done = t(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 200000")
    return joins.unprocessed(t(spark, d, "customer"), done.select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_name")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j04_lookup(spark, d):
    return joins.lookup(t(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), t(spark, d, "nation"), "n_nationkey").select("s_suppkey", "n_name")


@query("SELECT o_orderkey AS key, o_totalprice, c_name, l_linenumber FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def j08_inner_many(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    c = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("key"), "c_name")
    return joins.inner_many("key", o, c, t(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber"))


@query("SELECT coalesce(a.k, b.k) AS key, coalesce(a.n, -1) AS parts, coalesce(b.m, -1) AS supplied FROM (SELECT p_size AS k, count(*) AS n FROM part GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS m FROM supplier GROUP BY 1) b ON a.k = b.k")
def j09_outer_many(spark, d):
    a = t(spark, d, "part").groupBy(F.col("p_size").alias("key")).agg(F.count("*").alias("parts"))
    b = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("supplied"))
    return joins.outer_many("key", a, b).na.fill(-1)


@query(
    """WITH u AS (SELECT c_nationkey AS key, c_name AS name, 0 AS source_id FROM customer UNION ALL SELECT s_nationkey, s_name, 1 FROM supplier)
SELECT * FROM u WHERE (key, source_id) IN (SELECT key, max(source_id) FROM u GROUP BY key)"""
)
def j10_override(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"))
    return joins.override("key", c, t(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("name")))


@query("SELECT c_custkey AS key, c_name AS left_name, o_orderkey AS right_order FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey % 5 <> 0")
def j13_tagged_join(spark, d):
    c = t(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("key"), F.col("c_name").alias("name"))
    return joins.tagged_join("key", {"left": c, "right": t(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("order"))})


@query("SELECT 'left' AS tag, count(*) AS total, count(*) FILTER (WHERE c_custkey % 5 = 0) AS null_keys, count(*) FILTER (WHERE c_custkey % 5 <> 0) AS collected FROM customer")
def j14_join_counters(spark, d):
    return joins.join_counters("key", {"left": t(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("key"))})


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = 3 AND l_returnflag = 'N'")
def j16_prefix_scan(spark, d):
    return joins.prefix_scan(t(spark, d, "lineitem"), l_suppkey=3, l_returnflag="N").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100")
def j17_scan_from(spark, d):
    return joins.scan_from(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, "o_orderkey")


@query("SELECT c_nationkey AS key, c_name AS name FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT s_nationkey, s_name FROM supplier")
def u01_keyed_union(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"))
    return sets.keyed_union("key", c, t(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("name")))


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def u02_distinct_edges(spark, d):
    return sets.distinct_edges(t(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def u03_difference(spark, d):
    return sets.difference(t(spark, d, "customer").select(F.col("c_custkey").alias("key")), t(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("key")))


@query("SELECT s_nationkey AS key FROM supplier UNION SELECT c_nationkey FROM customer")
def u04_union_distinct(spark, d):
    return sets.union_distinct(t(spark, d, "supplier").select(F.col("s_nationkey").alias("key")), t(spark, d, "customer").select(F.col("c_nationkey").alias("key")))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n > 1")
def u05_duplicates(spark, d):
    return sets.split_duplicates(t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])[1]


@query("SELECT DISTINCT p_brand, p_type FROM part")
def u06_add_if_absent(spark, d):
    return sets.add_if_absent(t(spark, d, "part").select("p_brand", "p_type"), "p_brand", "p_type")


@query("SELECT c_name AS name, c_acctbal AS value FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def u07_union_statistics(spark, d):
    return sets.union_statistics(t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("value")), t(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("value")))


# --- aggregations -------------------------------------------------------------------------------------------------


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\t\\n\\r\\f]+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def a01_word_count(spark, d):
    return aggregates.word_count(t(spark, d, "documents"))


@query("SELECT match, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, 'th[a-z]+')) AS match FROM documents) GROUP BY match")
def a02_grep_count(spark, d):
    return aggregates.grep_count(t(spark, d, "documents"), "text", "th[a-z]+")


@query(
    """WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\t]')) AS word FROM documents) GROUP BY word)
SELECT count(*) AS words, min(n) AS least, max(n) AS most, quantile_disc(n, 0.5)::BIGINT AS median, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation FROM w"""
)
def a04_word_histogram(spark, d):
    return aggregates.word_histogram(t(spark, d, "documents")).withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@query(
    """WITH v AS (SELECT l_returnflag AS id, l_partkey AS n, l_linestatus AS s FROM lineitem)
SELECT id, 'LONGVALUESUM' AS type, sum(n)::VARCHAR AS report FROM v GROUP BY id
UNION ALL SELECT id, 'LONGVALUEMAX', max(n)::VARCHAR FROM v GROUP BY id
UNION ALL SELECT id, 'LONGVALUEMIN', min(n)::VARCHAR FROM v GROUP BY id
UNION ALL SELECT id, 'UNIQVALUECOUNT', count(DISTINCT n)::VARCHAR FROM v GROUP BY id
UNION ALL SELECT id, 'STRINGVALUEMAX', max(n::VARCHAR) FROM v GROUP BY id
UNION ALL SELECT id, 'STRINGVALUEMIN', min(n::VARCHAR) FROM v GROUP BY id
UNION ALL SELECT id, 'UNKNOWN', NULL FROM v GROUP BY id"""
)
def a12_dispatch(spark, d):
    kinds = ("LongValueSum", "longvaluemax", "LONGVALUEMIN", "UniqValueCount", "StringValueMax", "StringValueMin", "unknown")
    rows = t(spark, d, "lineitem").select(F.explode(F.array(*[F.concat(F.lit(f"{k}:"), "l_returnflag") for k in kinds])).alias("key"), F.col("l_partkey").alias("value"))
    return aggregates.dispatch(rows)


@query("SELECT o_orderpriority AS id, 'DOUBLEVALUESUM' AS type, round(sum(o_totalprice), 2) AS report FROM orders GROUP BY 1")
def a07_double_sum(spark, d):
    rows = t(spark, d, "orders").select(F.concat(F.lit("DoubleValueSum:"), "o_orderpriority").alias("key"), F.col("o_totalprice").alias("value"))
    return aggregates.dispatch(rows).withColumn("report", F.round(F.col("report").cast("double"), 2))


@query("SELECT o_custkey, least(count(DISTINCT o_orderpriority), 4)::BIGINT AS n FROM orders GROUP BY o_custkey")
def a10_unique_capped(spark, d):
    return aggregates.unique_count(t(spark, d, "orders"), "o_custkey", "o_orderpriority", 3)


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def a11_value_histogram(spark, d):
    return aggregates.value_histogram(t(spark, d, "orders"), "o_orderpriority")


@query("SELECT user_id, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS time FROM events GROUP BY user_id, event_type")
def a17_count_and_time(spark, d):
    e = t(spark, d, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    return aggregates.count_and_time(e, ["user_id", "event_type"], "value").withColumn("time", F.col("time").cast("double"))


@query()
def a18_checksum(spark, d):
    return aggregates.checksum(t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c.code, count(e.event_type) AS n FROM (VALUES ('click'), ('view'), ('none')) c(code) LEFT JOIN events e ON e.event_type = c.code GROUP BY c.code")
def a19_code_counts(spark, d):
    return aggregates.code_counts(t(spark, d, "events"), "event_type", ["click", "view", "none"])


@query(
    """WITH c AS (SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1),
b AS (SELECT CASE WHEN n >= 100000 THEN 100000 WHEN n >= 10000 THEN 10000 WHEN n >= 1000 THEN 1000 WHEN n >= 100 THEN 100 WHEN n >= 10 THEN 10
 WHEN n >= 5 THEN 5 WHEN n >= 4 THEN 4 WHEN n >= 3 THEN 3 WHEN n >= 2 THEN 2 END::BIGINT AS bucket, n, (length(name) + 24) * (n - 1) AS s FROM c)
SELECT bucket, count(*) AS names, sum(n)::BIGINT AS files, sum(s)::BIGINT AS savings FROM b WHERE bucket IS NOT NULL GROUP BY bucket"""
)
def a20_name_distribution(spark, d):
    return aggregates.name_distribution(t(spark, d, "part").select(F.concat(F.lit("/x/"), "p_name").alias("path")), "path")


@query(
    """SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS variance, round(stddev_pop(l_quantity), 6) AS deviation,
round(avg(l_quantity) + stddev_pop(l_quantity), 6) AS outlier, round(avg(l_quantity) + 1.96 * stddev_pop(l_quantity) / sqrt(count(*)), 6) AS upper95 FROM lineitem GROUP BY l_returnflag"""
)
def a21_running_statistics(spark, d):
    out = aggregates.running_statistics(t(spark, d, "lineitem"), "l_quantity", "l_returnflag")
    return out.withColumns({c: F.round(c, 6) for c in out.columns[2:]})


@query(
    """WITH m AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id)
SELECT e.user_id, min(value) AS global_min, max(value) AS global_max, round(sum(value), 2) AS sum, min(value) FILTER (WHERE e.ts = m.ts) AS latest_min, max(value) FILTER (WHERE e.ts = m.ts) AS latest_max
FROM events e JOIN m USING (user_id) GROUP BY e.user_id"""
)
def a22_aggregation_ops(spark, d):
    return aggregates.aggregation_ops(t(spark, d, "events").select("user_id", "value", "ts"), ["user_id"], "value", "ts").withColumn("sum", F.round("sum", 2))


@query("SELECT user_id, event_type, min(event_id) AS started, max(event_id) AS ended FROM events GROUP BY 1, 2")
def a23_flow_runs(spark, d):
    return aggregates.flow_runs(t(spark, d, "events"), ["user_id", "event_type"], "event_id", "event_id")


@query(
    """SELECT coalesce(n_regionkey, -1) AS n_regionkey, coalesce(n_nationkey, -1) AS n_nationkey, coalesce(c_mktsegment, '') AS c_mktsegment, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS total, count(*) AS n, (3 - grouping(nation.n_regionkey) - grouping(nation.n_nationkey) - grouping(customer.c_mktsegment))::INTEGER AS track
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (nation.n_regionkey, nation.n_nationkey, customer.c_mktsegment)"""
)
def a25_tracks(spark, d):
    df = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    return aggregates.tracks(df, ["n_regionkey", "n_nationkey", "c_mktsegment"], "c_acctbal").withColumn("total", F.col("total").cast("double")).na.fill(-1).na.fill("")


@query("SELECT event_type, round(sum(value), 2) AS counter, arg_max(value, (ts, value)) AS gauge, count(*) AS samples, round(avg(value), 6) AS rate FROM events GROUP BY event_type")
def a28_metric_kinds(spark, d):
    return aggregates.metric_kinds(t(spark, d, "events"), "event_type", "value", "ts").withColumns({"counter": F.round("counter", 2), "rate": F.round("rate", 6)})


@query("SELECT 'k' AS key, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total FROM events")
def a31_merge_statistics(spark, d):
    return aggregates.merge_statistics(t(spark, d, "events").select(F.from_json("props", "map<string,bigint>").alias("m")), "m")


@query()
def a32_row_hashes(spark, d):
    return aggregates.row_hashes(t(spark, d, "orders"), "o_orderpriority", "o_orderkey", "o_custkey")


@query(
    """WITH c AS (SELECT o_orderpriority AS id, o_custkey AS v, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY id) AS m FROM c)
SELECT id, max(m)::BIGINT AS values, min(n)::BIGINT AS least, max(n) FILTER (WHERE i = m // 2)::BIGINT AS median, max(n)::BIGINT AS most, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation FROM r GROUP BY id"""
)
def a11_histogram_report(spark, d):
    rows = t(spark, d, "orders").select(F.concat(F.lit("ValueHistogram:"), "o_orderpriority").alias("key"), F.col("o_custkey").alias("value"))
    part = F.split("report", "\t")
    whole = {c: part[i].cast("long").alias(c) for i, c in enumerate(("values", "least", "median", "most"))}
    return aggregates.dispatch(rows).select("id", *whole.values(), F.round(part[4].cast("double"), 6).alias("mean"), F.round(part[5].cast("double"), 6).alias("deviation"))


@query("SELECT o_orderstatus, ((sum(o_custkey * 1000003)::HUGEINT + 2147483648) % 4294967296 - 2147483648)::INTEGER AS total FROM orders GROUP BY 1")
def a05_int_sum(spark, d):
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(aggregates.int_sum(F.col("o_custkey") * 1000003).alias("total"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a16_value_count(spark, d):
    return aggregates.value_count(t(spark, d, "orders"), "o_orderstatus")


@query(
    """WITH p AS (SELECT p_partkey, nullif(p_partkey % 3, 0) AS a, nullif(p_size % 4, 0) AS b FROM part)
SELECT p_partkey, coalesce(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a + b END, -99) AS total, coalesce(CASE WHEN a IS NULL THEN -b WHEN b IS NULL THEN a ELSE a - b END, -99) AS less,
CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN -1 WHEN b IS NULL THEN 1 ELSE sign(a - b) END::INTEGER AS compared FROM p"""
)
def a27_metric_calculus(spark, d):
    a, b = F.nullif(F.col("p_partkey") % 3, F.lit(0).cast("long")), F.nullif((F.col("p_size") % 4).cast("long"), F.lit(0).cast("long"))
    return t(spark, d, "part").select("p_partkey", aggregates.metric_sum(a, b).alias("total"), aggregates.metric_sub(a, b).alias("less"), aggregates.metric_compare(a, b).alias("compared")).na.fill(-99)


@query(
    """WITH s AS (SELECT l_orderkey AS key, l_linenumber / 8 AS p, l_linenumber * l_linenumber::DOUBLE AS v FROM lineitem),
g AS (SELECT *, lag(p, 1, 0) OVER w AS p0, lag(v, 1, 0) OVER w AS v0 FROM s WINDOW w AS (PARTITION BY key ORDER BY p, v))
SELECT key, least(floor(p * 4), 3)::INTEGER AS bucket, round(sum(v - v0), 6) AS cumulative, round(sum((v + v0) / 2 * (p - p0)) * 4, 6) AS state FROM g GROUP BY ALL"""
)
def a29_progress_buckets(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") / 8).alias("p"), (F.col("l_linenumber") * F.col("l_linenumber")).cast("double").alias("v"))
    out = aggregates.progress_buckets(rows, "key", "p", "v", 4)
    return out.withColumns({c: F.round(c, 6) for c in ("cumulative", "state")})


# --- windows and sorts --------------------------------------------------------------------------------------------


@query(
    """SELECT event_id, (sum(floor(value)::BIGINT) OVER w // count(*) OVER w)::BIGINT AS rolling FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW)"""
)
def w01_rolling_average(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.floor("value").alias("v"))
    return windows.rolling_average(e, "user_id", "ms", "v", 3_600_000).select("event_id", "rolling")


@query(
    """WITH c AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, user_id, event_type)::INTEGER AS rank FROM c)
SELECT strftime(window_start, '%Y-%m-%d') AS window_start, user_id, event_type, n, rank FROM r WHERE rank <= 3"""
)
def w02_top_by_window(spark, d):
    out = windows.top_by_window(t(spark, d, "events"), "ts", ["user_id", "event_type"], 1440, 3)
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def w03_top_n(spark, d):
    return windows.top_n(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10, "o_orderkey")


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def w04_changes(spark, d):
    return windows.changes(t(spark, d, "events"), "user_id", "event_id", "event_type").select("event_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def w05_latest(spark, d):
    return windows.latest(t(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id").drop("ts")


@query("SELECT slot, sum(c)::BIGINT AS containers FROM (SELECT unnest(generate_series(l_orderkey, l_orderkey + 4)) AS slot, floor(l_quantity / 8)::BIGINT AS c FROM lineitem) GROUP BY slot")
def w06_allocation_steps(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") + 5).alias("e"), "l_quantity")
    return windows.allocation_steps(df, "l_orderkey", "e", "l_quantity", 8, 1).withColumnRenamed("at", "slot")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS seq FROM orders")
def w07_sequence(spark, d):
    return windows.sequence_in(t(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("SELECT p_brand || chr(9) || p_size AS line FROM part ORDER BY p_size DESC, p_brand LIMIT 50")
def o08_key_sort(spark, d):
    df = t(spark, d, "part").select(F.concat_ws("\t", "p_brand", F.col("p_size").cast("string")).alias("line"))
    return ordering.sort_by_keys(df, "-k2,2nr -k1,1", "line").limit(50)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100")
def o09_compound(spark, d):
    return ordering.compound(t(spark, d, "orders"), F.col("o_orderpriority").asc(), F.col("o_totalprice").desc(), F.col("o_orderkey").asc()).limit(100).select("o_orderkey")


@query("SELECT p_brand || chr(9) || p_size AS line FROM part ORDER BY p_size DESC, p_brand")
def o08_key_sort_whole(spark, d):
    df = t(spark, d, "part").select(F.concat_ws("\t", "p_brand", F.col("p_size").cast("string")).alias("line"))
    return ordering.sort_by_keys(df, "-k2,2nr -k1,1", "line")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def o09_compound_whole(spark, d):
    return ordering.compound(t(spark, d, "orders"), F.col("o_orderpriority").asc(), F.col("o_totalprice").desc(), F.col("o_orderkey").asc()).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders")
def p03_total_order(spark, d):
    return ordering.total_order(t(spark, d, "orders").select("o_orderkey", "o_custkey"), 8, "o_custkey", "o_orderkey")


# --- partitioning -------------------------------------------------------------------------------------------------

_RING = partitioning.ring([f"node{i}" for i in range(5)])


@query(
    f"""WITH ring AS (SELECT md5('node' || n || '/' || v) AS place, 'node' || n AS location FROM range(5) a(n), range({partitioning.VIRTUAL_NODES}) b(v)),
s AS (SELECT s_suppkey, md5(s_name) AS h FROM supplier)
SELECT s_suppkey, coalesce((SELECT location FROM ring WHERE place >= h ORDER BY place LIMIT 1), (SELECT location FROM ring ORDER BY place LIMIT 1)) AS location FROM s"""
)
def p07_ring_route(spark, d):
    return partitioning.ring_route(t(spark, d, "supplier"), "s_name", spark.createDataFrame(_RING, "place string, location string")).select("s_suppkey", "location")


@query("SELECT p_partkey, ((p_partkey + i) % 7)::INTEGER AS node FROM part, range(3) r(i)")
def p09_replicas(spark, d):
    return partitioning.replicas(t(spark, d, "part").select("p_partkey"), "p_partkey", 3, 7)


@query(
    f"""WITH a AS (SELECT p_partkey, xor(p_partkey, {partitioning.REHASH_SEED}) AS h FROM part), b AS (SELECT p_partkey, xor(xor(h, h >> 20), h >> 12) AS h FROM a),
c AS (SELECT p_partkey, xor(xor(h, h >> 7), h >> 4) AS h FROM b) SELECT p_partkey, (h & 2147483647) % 32 AS part FROM c"""
)
def p02_rehash(spark, d):
    return t(spark, d, "part").select("p_partkey", partitioning.rehash(F.col("p_partkey"), 32).alias("part"))


@query("SELECT i AS record, 10 + CASE WHEN i < 5 THEN 1 ELSE 0 END::BIGINT AS bytes FROM range(30) r(i)")
def p10_balanced(spark, d):
    return partitioning.balanced(spark, 305, 30)


@query(
    """WITH h AS (SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM part)
SELECT p_partkey, (h & 2147483647) % 16 AS part FROM h"""
)
def p01_hash(spark, d):
    return t(spark, d, "part").select("p_partkey", partitioning.hash_partition("p_name", 16).alias("part"))


@query(
    """WITH h AS (SELECT p_partkey, list_reduce(list_prepend(1::BIGINT, list_transform(string_split(substr(p_brand, 2, length(p_brand) - 2), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM part)
SELECT p_partkey, (h & 2147483647) % 16 AS part FROM h"""
)
def p05_byte_slice(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.encode("p_brand", "utf-8").alias("key"))
    return p.select("p_partkey", partitioning.byte_partition("key", 1, -2, 16).alias("part"))


@query("SELECT count(DISTINCT l_orderkey) AS keys, count(*) AS n, count(DISTINCT l_orderkey) AS places FROM lineitem")
def p04_field_partition(spark, d):
    """Every key is in one place: as many (key, partition) pairs as keys."""
    lines = t(spark, d, "lineitem").select("l_orderkey", F.concat_ws("\t", F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string"), "l_returnflag").alias("line"))
    placed = partitioning.field_partition(lines, 8, "line", 2, 2).select("l_orderkey", F.spark_partition_id().alias("place")).groupBy("l_orderkey", "place").agg(F.count("*").alias("n"))
    return placed.agg(F.count_distinct("l_orderkey").alias("keys"), F.sum("n").alias("n"), F.count("*").alias("places"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 < 3 THEN p_size % 4 END::INTEGER AS partition FROM part WHERE p_size % 4 < 3")
def p06_given_partition(spark, d):
    p = t(spark, d, "part").select("p_partkey", (F.col("p_size") % 4).alias("number")).where("number < 3")
    return partitioning.given_partition(p, "number", 3).select("p_partkey", "partition")


# --- functions ----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, substr(sha256(p_name), 1, 8) AS key FROM part")
def x04_hash8(spark, d):
    return t(spark, d, "part").select("p_partkey", text.hash8(F.col("p_name")).alias("key"))


@query("SELECT p_partkey, p_name AS callee, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE -1 END::INTEGER AS size FROM part")
def x05_strip_and_parse(spark, d):
    size = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("x"))
    return t(spark, d, "part").select("p_partkey", text.strip_prefix(F.concat(F.lit("(INT)"), "p_name")).alias("callee"), F.coalesce(text.safe_int(size), F.lit(-1)).alias("size"))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) || ' & <b>' AS cleaned FROM conversations")
def x01_clean_text(spark, d):
    fenced = F.concat(F.lit("```xml\n"), "text", F.lit(" &amp; &lt;b&gt;\n```"))
    return t(spark, d, "conversations").select("conv_id", "turn", text.clean_text(fenced).alias("cleaned"))


@query("SELECT conv_id, turn, 'f' || i AS exec_flow, CASE WHEN i = 1 THEN text ELSE 'l2' END AS log FROM conversations, (VALUES (1), (2)) v(i)")
def x02_tag_pairs(spark, d):
    body = F.concat(F.lit("<exec_flow>f1</exec_flow><log_seq>"), "text", F.lit("</log_seq>\n<exec_flow>f2</exec_flow><log_seq>l2</log_seq><exec_flow>f3</exec_flow>"))
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.explode(text.tag_pairs(body)).alias("p"))
    return rows.select("conv_id", "turn", "p.exec_flow", "p.log")


@query("SELECT event_id, user_id::VARCHAR AS u, event_type AS k FROM events")
def x15_key_value_line(spark, d):
    line = F.concat(F.lit('Job u="'), F.col("user_id").cast("string"), F.lit('" k="'), "event_type", F.lit('" .'))
    m = text.key_values(line)
    return t(spark, d, "events").select("event_id", F.try_element_at(m, F.lit("u")).alias("u"), F.try_element_at(m, F.lit("k")).alias("k"))


@query("SELECT n_name, 'a!b|' || n_name || '|*' AS parts FROM nation")
def x21_escape_round_trip(spark, d):
    joined = text.escape_join(F.array(F.lit("a!b"), F.col("n_name"), F.lit("*")))
    return t(spark, d, "nation").select("n_name", F.array_join(text.escape_split(joined), "|").alias("parts"))


@query("SELECT l_returnflag, min(l_extendedprice) AS least, max(l_extendedprice) AS greatest, quantile_disc(l_extendedprice, 0.25) AS p1, quantile_disc(l_extendedprice, 0.5) AS p2, quantile_disc(l_extendedprice, 0.75) AS p3 FROM lineitem GROUP BY 1")
def x25_cdf(spark, d):
    return numeric.cdf(t(spark, d, "lineitem"), "l_extendedprice", 3, 4, "l_returnflag")


@query("SELECT o_orderkey, 9223372036854775807 - o_orderkey AS inverted, epoch_ms(o_orderdate) * 1000000 + o_custkey % 1000000 AS cell FROM orders")
def x17_encodings(spark, d):
    o = t(spark, d, "orders")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return o.select("o_orderkey", numeric.invert(F.col("o_orderkey")).alias("inverted"), numeric.supplement(ms, F.col("o_custkey")).alias("cell"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '<enhanced_paths>' || p_name || '</enhanced_paths>' ELSE 'a ' || p_name END AS block FROM part")
def x03_block(spark, d):
    tagged = F.concat(F.lit("a <enhanced_paths>"), "p_name", F.lit("</enhanced_paths> b <enhanced_paths>c</enhanced_paths>"))
    return t(spark, d, "part").select("p_partkey", text.block(F.when(F.col("p_size") % 2 == 0, tagged).otherwise(F.concat(F.lit("a "), "p_name"))).alias("block"))


@query("SELECT p_partkey, 'int ' || replace(p_name, ' ', '') || '() { return f(); }' AS code, true AS method FROM part")
def x07_strip_code(spark, d):
    name = F.replace("p_name", F.lit(" "), F.lit(""))
    code = F.concat(F.lit("int "), name, F.lit('(/* one\n two */) { return f("a \\" b"); }// end'))
    return t(spark, d, "part").select("p_partkey", text.strip_code(code).alias("code"), text.is_method(code).alias("method"))


@query("SELECT conv_id, turn, translate(text, chr(13) || chr(10), chr(1) || chr(2)) AS encoded, text AS decoded FROM conversations")
def x11_line_codes(spark, d):
    encoded = text.encode_lines(F.col("text"))
    return t(spark, d, "conversations").select("conv_id", "turn", encoded.alias("encoded"), text.decode_lines(encoded).alias("decoded"))


@query("SELECT p_partkey, p_brand || '.class' AS entry, printf('%04d%%%s', p_size, p_brand) AS dir, p_size AS number FROM part")
def x12_jar_paths(spark, d):
    outer = F.when(F.col("p_size") % 2 == 0, "lib/a.jar!/").otherwise("lib/x/")
    folder = text.numbered_dir(F.col("p_brand"), F.col("p_size"))
    return t(spark, d, "part").select("p_partkey", text.jar_entry(F.concat(outer, "p_brand", F.lit(".class"))).alias("entry"), folder.alias("dir"), text.dir_number(folder).alias("number"))


@query("SELECT event_id, 'from <*> to <*>: ' || event_type || ' <*>' AS masked FROM events")
def x14_mask(spark, d):
    n = (F.col("event_id") % 200).cast("string")
    line = F.concat(F.lit("from /10.0.0."), n, F.lit(":80 to 10.1.0."), n, F.lit(": "), "event_type", F.lit(" {k="), n, F.lit("}"))
    return t(spark, d, "events").select("event_id", text.mask_fields(line).alias("masked"))


@query("SELECT p_partkey, replace(replace(replace(p_name || '%' || chr(9), '%', '%0$'), ' ', '%1$'), chr(9), '%2$') AS qualifier FROM part")
def x20_qualifier(spark, d):
    return t(spark, d, "part").select("p_partkey", text.encode_qualifier(F.concat("p_name", F.lit("%\t"))).alias("qualifier"))


@query("SELECT l_orderkey AS file, count(*) AS blocks, md5(unhex(string_agg(md5(l_returnflag || l_partkey), '' ORDER BY l_linenumber, md5(l_returnflag || l_partkey)))) AS md5 FROM lineitem GROUP BY l_orderkey")
def x23_file_md5(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), "l_linenumber", F.encode(F.concat("l_returnflag", F.col("l_partkey").cast("string")), "utf-8").alias("data"))
    return numeric.file_checksums(rows, "file", "l_linenumber", "data")


@query("SELECT p_partkey, round(CASE WHEN r < 0.25 THEN 10 + r / 0.25 * 90 WHEN r < 1 THEN 100 + (r - 0.25) / 0.75 * 900 ELSE 1000 END, 6) AS value FROM (SELECT p_partkey, p_size / 50 AS r FROM part)")
def x24_piecewise(spark, d):
    value = numeric.piecewise_quantile(F.col("p_size") / 50, [(0.0, 10.0), (0.25, 100.0), (1.0, 1000.0)])
    return t(spark, d, "part").select("p_partkey", F.round(value, 6).alias("value"))


@query("SELECT s_suppkey, unnest(range(s_suppkey, s_suppkey + 20, 6)) AS term FROM supplier")
def x26_progression(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") + 20).alias("stop"), F.lit(6).cast("long").alias("step"))
    return numeric.progression(s, "s_suppkey", "stop", "step").select("s_suppkey", "term")


@query("SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS a, l_partkey - l_suppkey AS s, l_partkey * l_suppkey AS m, CASE WHEN l_linenumber % 3 <> 0 THEN round(l_partkey / (l_linenumber % 3), 6) END AS q FROM lineitem")
def x27_arithmetic(spark, d):
    x, y = F.col("l_partkey"), F.col("l_suppkey")
    q = F.round(numeric.arithmetic("/", x, F.col("l_linenumber") % 3), 6)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[numeric.arithmetic(k, x, y).alias(c) for k, c in (("+", "a"), ("-", "s"), ("*", "m"))], q.alias("q"))


@query(
    """WITH w AS (SELECT DISTINCT word, CASE WHEN ends_with(word, '.log') THEN '.log' ELSE '' END AS suffix FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'u' || user_id || '.log' WHEN user_id % 3 = 0 THEN 'known.log' ELSE user_id::VARCHAR END AS word FROM events)),
k AS (SELECT word, suffix, substr(word, 1, length(word) - length(suffix)) AS stem FROM w),
n AS (SELECT stem, dense_rank() OVER (ORDER BY stem) AS i FROM (SELECT DISTINCT stem FROM k WHERE stem <> 'known' AND NOT regexp_full_match(stem, '-?[0-9]+')))
SELECT word, coalesce('word75_' || i, stem) || suffix AS anonymous FROM k LEFT JOIN n USING (stem)"""
)
def x28_anonymise(spark, d):
    user = F.col("user_id").cast("string")
    word = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("u"), user, F.lit(".log"))).when(F.col("user_id") % 3 == 0, "known.log").otherwise(user)
    return numeric.anonymise(t(spark, d, "events").select(word.alias("word")).distinct(), "word", ["known"], [".log"])


@query("SELECT o_orderkey, o_custkey % 3 IS NOT DISTINCT FROM nullif(o_orderkey % 3, 2) AS same FROM orders")
def x29_deep_equal(spark, d):
    a, b = F.struct(F.lit("k"), F.array(F.col("o_custkey") % 3)), F.struct(F.lit("k"), F.array(F.nullif(F.col("o_orderkey") % 3, F.lit(2))))
    return t(spark, d, "orders").select("o_orderkey", numeric.deep_equal(a, b).alias("same"))


@query()
def x22_murmur2(spark, d):
    return t(spark, d, "part").select("p_partkey", numeric.murmur2(F.encode("p_name", "utf-8")).alias("hash"))


@query("SELECT s_suppkey, (WITH RECURSIVE p(i, v) AS (SELECT 0, 1::HUGEINT UNION ALL SELECT i + 1, (v * (s_suppkey + 2)) % 1000003 FROM p WHERE i < 13) SELECT v::BIGINT FROM p WHERE i = 13) AS v FROM supplier")
def x26_mod_pow(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", numeric.mod_pow(F.col("s_suppkey") + 2, F.lit(13).cast("long"), F.lit(1000003).cast("long")).alias("v"))


@query("SELECT s_suppkey, 'key-' || s_suppkey AS reply FROM supplier")
def l05_completion(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("key-"), F.col("s_suppkey").cast("string")).alias("prompt"))
    return callgraph.complete(s, "prompt", lambda p: p).select("s_suppkey", "reply")


@query()
def l01_templates(spark, d):
    e = t(spark, d, "events").select("event_id", F.format_string("user %s did %s from 10.0.0.%s:80 in %s ms", F.col("user_id").cast("string"), "event_type", (F.col("event_id") % 200).cast("string"), F.floor("value").cast("string")).alias("line"))
    return drain.templates(e, "line", "event_id", 0.5, 4)


@query("SELECT ts::VARCHAR IS NOT NULL AS ok, 'ev.' || event_type || ': user=' || user_id || ', k=' || json_extract(props, '$.k') AS line FROM events")
def k17_metric_lines(spark, d):
    e = t(spark, d, "events").select(F.lit("0").alias("ts"), F.lit("ev").alias("context"), F.col("event_type").alias("name"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("tags"), F.from_json("props", "map<string,bigint>").alias("metrics"))
    return sinks.metric_lines(e).select(F.lit(True).alias("ok"), F.expr("substring(value, 3)").alias("line"))


# --- graph --------------------------------------------------------------------------------------------------------

_EDGES = "SELECT DISTINCT p AS caller, n AS callee FROM (SELECT event_type || '@' || user_id % 50 AS n, lag(event_type || '@' || user_id % 50) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NOT NULL AND p <> n"


def transitions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    name = F.concat("event_type", F.lit("@"), (F.col("user_id") % 50).cast("string"))
    rows = t(spark, d, "events").select(name.alias("callee"), F.lag(name).over(Window.partitionBy("user_id").orderBy("event_id")).alias("caller"))
    return rows.where("caller is not null and caller <> callee").select("caller", "callee").distinct()


@query(
    f"""WITH RECURSIVE e AS ({_EDGES}),
r(seed, node, depth) AS (SELECT caller, caller, 0 FROM (SELECT DISTINCT caller FROM e WHERE caller LIKE 'click@1%') UNION SELECT r.seed, e.callee, r.depth + 1 FROM r JOIN e ON r.node = e.caller WHERE r.depth < 3),
f AS (SELECT seed, node, min(depth) AS depth FROM r GROUP BY seed, node)
SELECT f.seed, e.caller, e.callee, f.depth::INTEGER AS depth FROM f JOIN e ON f.node = e.caller WHERE f.depth < 3"""
)
def g02_subgraphs(spark, d):
    e = transitions(spark, d)
    return graph.subgraphs(e, e.where("caller like 'click@1%'").select("caller").distinct(), 3)


@query(
    f"""WITH RECURSIVE e AS ({_EDGES}),
r(node, depth) AS (SELECT DISTINCT callee, 0 FROM e WHERE callee LIKE 'error@2%' UNION SELECT e.caller, r.depth + 1 FROM r JOIN e ON r.node = e.callee WHERE r.depth < 2)
SELECT DISTINCT node FROM r"""
)
def g03_reverse_trace(spark, d):
    e = transitions(spark, d)
    return graph.reverse_trace(e, e.where("callee like 'error@2%'").select("callee").distinct(), 3)[0]


@query(f"WITH e AS ({_EDGES}) SELECT caller || '->' || callee AS edge FROM e")
def g04_edge_text(spark, d):
    return transitions(spark, d).select(graph.edge_text().alias("edge"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS c, n_nationkey // 3 AS p FROM nation WHERE n_nationkey > 0), r(child, ancestor, depth) AS (SELECT c, p, 1 FROM e UNION SELECT r.child, e.p, r.depth + 1 FROM r JOIN e ON r.ancestor = e.c WHERE r.depth < 10)
SELECT child::BIGINT AS child, ancestor::BIGINT AS ancestor, min(depth)::INTEGER AS depth FROM r GROUP BY child, ancestor"""
)
def g11_hierarchy(spark, d):
    n = t(spark, d, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").cast("long").alias("c"), F.expr("cast(n_nationkey div 3 as long)").alias("p"))
    return graph.hierarchy(n, "c", "p")


@query("SELECT DISTINCT event_type AS caller, 'T' || user_id AS callee FROM events WHERE event_id % 5 <> 0 AND event_id % 3 <> 1")
def g01_call_edges(spark, d):
    on, log = (F.col("event_id") % 5 != 0).cast("int"), F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 0)
    callee = F.concat(F.lit("T"), F.col("user_id").cast("string"))
    return graph.call_edges(t(spark, d, "events").select(F.col("event_type").alias("caller"), callee.alias("callee"), on.alias("enabled"), log.alias("log_propagation")))


@query(
    """WITH RECURSIVE r(node, path, depth) AS (SELECT 0, '/NATION_0', 0 UNION ALL SELECT n.n_nationkey, r.path || '/NATION_' || n.n_nationkey, r.depth + 1 FROM r JOIN nation n ON n.n_nationkey > 0 AND n.n_nationkey // 3 = r.node)
SELECT node::BIGINT AS node, path, depth FROM r"""
)
def g12_tree_walk(spark, d):
    n, key = t(spark, d, "nation"), F.col("n_nationkey").cast("long")
    tree = n.select(key.alias("n"), F.when(key > 0, F.expr("n_nationkey div 3")).alias("p"), F.concat(F.lit("NATION_"), key.cast("string")).alias("name"))
    return graph.tree_paths(tree, "n", "p", "name")


# --- streams, run over the same tables as batches ------------------------------------------------------------------


@query("SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def t03_windowed_average(spark, d):
    out = metrics.windowed_average(t(spark, d, "events"), "ts", "event_type", "value", "6 hours")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("SELECT 60 AS minutes, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 720, strftime(time_bucket(INTERVAL 12 HOUR, ts), '%Y-%m-%d %H'), event_type, count(*) FROM events GROUP BY ALL")
def t04_windowed_counts(spark, d):
    parts = metrics.windowed_counts(t(spark, d, "events"), "ts", ["event_type"], [60, 720])
    return sets.union_statistics(*[p.select(F.lit(m).alias("minutes"), F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n") for m, p in parts.items()])


@query()
def t05_quantiles(spark, d):
    return metrics.quantiles(t(spark, d, "events"), "value", {0.5: 0.01, 0.99: 0.001}, "event_type")


@query("SELECT event_id, 1000000 + (event_id / 2)::BIGINT AS at_ms FROM (SELECT event_id * 2 AS event_id FROM events)")
def t11_replay(spark, d):
    return metrics.replay(t(spark, d, "events").select((F.col("event_id") * 2).alias("event_id")), "event_id", 1_000_000, 2.0)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 4 = 0")
def t02_changed_only(spark, d):
    now = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    before = now.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice") - 1).otherwise(F.col("o_totalprice")))
    return metrics.changed_only(before, now)
