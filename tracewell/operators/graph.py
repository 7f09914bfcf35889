"""Call graphs: adjacency, bounded expansion, reverse trace, hierarchies. Each level is one join; only a frontier's being empty
comes to the driver. Levels are written through checkpoint(), to the folder that spark.checkpoint.dir names, so plans don't grow with depth."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of calls, of a callee's object, of call facts, of field relations.
CALL_OPCODES = ("VIR", "INT", "SPE", "STA", "DYN")
CALLEE_OBJECTS = ("this", "static_field", "field", "variable")
CALL_FACTS = ("t", "v", "bv", "sf", "sfm", "nof", "nov", "mcrci", "mas", "mcrci_eqc", "mas_eqc", "mcefo")
FIELD_RELATIONS = ("DI", "DI_EQC", "BU", "MMAD", "MCP", "MCP_EQC")


def _cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracewell-"))
    return df.checkpoint()


def call_edges(calls: DataFrame) -> DataFrame:
    """Distinct (caller, callee) of calls that are enabled and propagate logs; a null log_propagation counts as 1."""
    on = (F.col("enabled") == 1) & (F.coalesce(F.col("log_propagation"), F.lit(1)) == 1) if "log_propagation" in calls.columns else F.col("enabled") == 1
    return calls.where(on).select("caller", "callee").distinct()


def subgraphs(edges: DataFrame, seeds: DataFrame, depth: int = 4) -> DataFrame:
    """(seed, caller, callee, depth): for each seed the edges of the nodes met in fewer than `depth` steps; each node is expanded once for a
    seed, at its first depth. Seeds without callees have no rows."""
    edges = _cut(edges.select("caller", "callee"))
    frontier = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct().withColumn("node", F.col("seed"))
    seen, out = frontier, None
    for level in range(depth):
        step = _cut(frontier.join(edges, frontier.node == edges.caller).select("seed", "caller", "callee", F.lit(level).alias("depth")))
        out = step if out is None else out.unionByName(step)
        frontier = _cut(step.select("seed", F.col("callee").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return out


def reverse_trace(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(traced, frontier), single columns `node`: nodes expanded in `depth` rounds of callers, the seeds first, and the callers found in the last
    round, which may be among the traced."""
    edges = _cut(edges.select("caller", "callee"))
    current = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct()
    traced = current.limit(0)
    for _ in range(depth):
        fresh = _cut(current.join(traced, "node", "left_anti"))
        if fresh.isEmpty():
            current = fresh
            break
        traced = traced.unionByName(fresh)
        current = _cut(fresh.join(edges, fresh.node == edges.callee).select(F.col("caller").alias("node")).distinct())
    return traced, current


def edge_text(caller: str = "caller", callee: str = "callee") -> Column:
    return F.concat_ws("->", F.col(caller), F.col(callee))


def hierarchy(extends: DataFrame, child: str, parent: str, most: int = 32) -> DataFrame:
    """(child, ancestor, depth): all ancestors with the least number of steps to them; cycles end by themselves. Ancestors over `most`
    steps away are an error."""
    base = extends.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).distinct()
    up = base.select(F.col("child").alias("_c"), F.col("ancestor").alias("_a"))
    level, seen = base.withColumn("depth", F.lit(1)), base
    out = level
    for depth in range(2, most + 2):
        new = level.join(up, level.ancestor == up._c).select("child", F.col("_a").alias("ancestor")).distinct()
        new = _cut(new.join(seen, ["child", "ancestor"], "left_anti"))
        if new.isEmpty():
            break
        if depth > most:
            raise ValueError(f"ancestors over {most} steps away")
        seen = seen.unionByName(new)
        level = new.withColumn("depth", F.lit(depth))
        out = out.unionByName(level)
    return out


def field_relations(getters: DataFrame, setters: DataFrame) -> DataFrame:
    """Fields tied by a value that goes from a getter into a setter of the same call: join on `call_id`."""
    return getters.select("call_id", F.col("field").alias("from_field")).join(setters.select("call_id", F.col("field").alias("to_field")), "call_id")


def call_facts(facts: DataFrame) -> DataFrame:
    """(call_id, arg_seq, kinds): the facts of each argument as a map of sorted values by kind; unknown kinds are an error."""
    kind = F.when(F.col("kind").isin(*CALL_FACTS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("null")))))
    values = facts.select("call_id", "arg_seq", kind.alias("kind"), "value").groupBy("call_id", "arg_seq", "kind").agg(F.sort_array(F.collect_set("value")).alias("values"))
    return values.groupBy("call_id", "arg_seq").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "values")))).alias("kinds"))


def tree_paths(nodes: DataFrame, node: str, parent: str, name: str, most: int = 64) -> DataFrame:
    """(node, path, depth) of a tree's nodes from its roots, whose parent is null, one level after the other. Nodes under more than `most` are an error."""
    level = nodes.where(F.col(parent).isNull()).select(F.col(node).alias("node"), F.concat(F.lit("/"), F.col(name)).alias("path"), F.lit(0).alias("depth"))
    out = level
    for depth in range(1, most + 2):
        kids = nodes.select(F.col(node).alias("_n"), F.col(parent).alias("_p"), F.col(name).alias("_name"))
        level = _cut(level.join(kids, level.node == kids._p).select(F.col("_n").alias("node"), F.concat_ws("/", "path", "_name").alias("path"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        if depth > most:
            raise ValueError(f"nodes under more than {most} others")
        out = out.unionByName(level)
    return out
