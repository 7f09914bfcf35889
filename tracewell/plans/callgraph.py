"""From call facts to subgraphs, and from method texts to compressed logs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, joins


def log_subgraphs(calls: DataFrame, logging: DataFrame, methods: DataFrame, up: int = 3, down: int = 4) -> DataFrame:
    """(seed, caller, callee, depth): callers of logging methods traced upward, kept where their code is known, then expanded downward."""
    edges = graph.call_edges(calls)
    traced, _ = graph.reverse_trace(edges, logging, up)
    return graph.subgraphs(edges, joins.known(traced.withColumnRenamed("node", "signature"), methods, "signature"), down)


def complete(df: DataFrame, prompt: str, call: Callable[[str], str], retries: int = 3, wait: float = 0.5, reply: str = "reply") -> DataFrame:
    """`reply` to each prompt from an injected function, with retries at doubling waits; null once they're used up. One worker calls it in turn."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{reply: [attempt(call, p, retries, wait) for p in b[prompt]]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{reply}` string"
    return df.mapInPandas(each, schema)


def attempt(call: Callable[[str], str], argument: str | None, retries: int, wait: float) -> str | None:
    if argument is None:
        return None
    for n in range(retries + 1):
        try:
            return call(argument)
        except Exception:
            if n < retries:
                time.sleep(wait * 2**n)
    return None


def control_flow(df: DataFrame, code: str, analyse: Callable[[str], str]) -> DataFrame:
    """`flow`: what an injected analyser makes of a method, put in a class; the code itself where it isn't a method or the analyser fails."""
    wrapped = df.withColumn("_w", F.when(text.is_method(F.col(code)), text.wrap_method(F.col(code))))
    return complete(wrapped, "_w", analyse, 0, 0, "_flow").withColumn("flow", F.coalesce("_flow", F.col(code))).drop("_w", "_flow")


#: Fixed value: the request that asks for paths.
REQUEST = "Analyse the control and data flow of this code.\nAnswer with <elements>, then <cfg> with <path1>, <path2> ... in it.\n\n%s"


def prompt(code: Column) -> Column:
    return F.format_string(REQUEST, code)


def compressed_logs(signatures: DataFrame, nodes: DataFrame, done: DataFrame, call: Callable[[str], str], second: str = "log_seq") -> DataFrame:
    """(key, exec_flow, log): for each signature with a node and no first pair in `done` (key), the pairs of the model's reply; key is the
    signature's hash and the pair's number from 1."""
    hashed = signatures.select("signature", text.hash8(F.col("signature")).alias("_h"))
    open_ = hashed.join(done.select(F.regexp_replace("key", "_1$", "").alias("_h")).where(F.col("key").endswith("_1")), "_h", "left_anti")
    asked = open_.join(nodes, "signature").select("_h", text.block(F.col("code")).alias("prompt"))
    replies = complete(asked, "prompt", call)
    cleaned = replies.select("_h", text.clean_text(F.col("reply")).alias("c")).select("_h", text.tag_pairs(F.col("c"), second=second).alias("p"))
    rows = cleaned.select("_h", F.posexplode("p").alias("i", "pair"))
    return rows.select(F.concat_ws("_", "_h", (F.col("i") + 1).cast("string")).alias("key"), text.clean_text(F.col("pair.exec_flow")).alias("exec_flow"), text.clean_text(F.col("pair.log")).alias("log"))


def model(backend: str, client: Callable[..., str], retries: int = 3, timeout: int = 40) -> Callable[[str], str]:
    """A completion function of the only known backend; another one is an error."""
    if backend != "openai":
        raise ValueError(f"no backend {backend!r}")
    return lambda p: client(p, retries=retries, timeout=timeout)


def tokenizer(name: str, load: Callable[[str], object], fallback: str = "cl100k_base") -> object:
    """The model's own tokenizer, else the fallback."""
    try:
        return load(name)
    except KeyError:
        return load(fallback)
