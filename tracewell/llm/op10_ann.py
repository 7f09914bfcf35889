"""Operator 10: approximate nearest neighbours by cosine, on robust-pruned directed graphs (Vamana, NeurIPS 2019).

Rows are dealt into shards of bounded size by hash. In a shard, equal vectors are one node, which keeps the smallest ids that can
ever be asked for. The graph begins at random; in two rounds every node is found again by a greedy search, the nodes
met are its proposed neighbours, and relaxed distance pruning keeps a diverse few: a candidate goes when a kept one is closer
to it, by the factor alpha, than the node is. Queries search every shard with a beam, in blocks, and exact cosines order what
the shards return. Nodes of a round are handled in batches of numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, scratch, table

TOP, SHARD_ROWS, QUERY_BYTES = 5, 2048, 32 << 20
DEGREE, BEAM, WIDTH, ALPHA, BATCH = 24, 64, 4, 1.2, 256
#: Entries of a graph, and random nodes proposed beside those met: a tight group of rows would otherwise propose only itself.
ENTRIES, RANDOM, SEARCH_BEAM = 16, 16, 128


def scaled(x: np.ndarray) -> np.ndarray:
    """The rows times powers of two that bring their largest components below 1: cosines stay the same to the last bit, and no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def units(x: np.ndarray) -> np.ndarray:
    """Scaled rows as float32 unit vectors, for the search."""
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, start: np.ndarray, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the best `beam` nodes for each row of q, best first; -1 and -inf where there are fewer."""
    n, rows = len(q), np.arange(len(q))[:, None]
    ids = np.full((n, beam), -1, np.int64)
    sim = np.full((n, beam), -np.inf, np.float32)
    done = np.ones((n, beam), bool)
    seen = np.zeros((n, len(x) + 1), bool)  # the last column stands for no node
    seen[:, -1] = True
    e = len(start)
    ids[:, :e], sim[:, :e], done[:, :e] = start, q @ x[start].T, False
    seen[:, start] = True
    while not done.all():
        pick = np.argsort(np.where(done, np.inf, -sim), axis=1, kind="stable")[:, :WIDTH]
        use = ~done[rows, pick]
        done[rows, pick] = True
        near = np.where(use[:, :, None], graph[ids[rows, pick]], -1).reshape(n, -1)
        near.sort(axis=1)
        new = ~seen[rows, near]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[rows, near] = True
        s = np.where(new, np.einsum("ijk,ik->ij", x[near], q), -np.inf).astype(np.float32)
        ids, sim, done = (np.concatenate(p, axis=1) for p in ((ids, near), (sim, s), (done, ~new)))
        best = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
        ids, sim, done = ids[rows, best], sim[rows, best], done[rows, best]
    ids[~np.isfinite(sim)] = -1
    return ids, sim


def robust_prune(x: np.ndarray, own: np.ndarray, ids: np.ndarray, alpha: float) -> np.ndarray:
    """(nodes, DEGREE) neighbours out of the candidates ids of each node of own; -1 where there are fewer."""
    rows = np.arange(len(own))[:, None]
    ids = np.sort(np.where(ids == own[:, None], -1, ids), axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    far = np.where(ids < 0, np.inf, 2 - 2 * np.einsum("ijk,ik->ij", x[ids], x[own]))
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = ids[rows, order], far[rows, order]
    c = x[ids]
    between = 2 - 2 * np.einsum("ijk,ilk->ijl", c, c)
    alive, out = np.isfinite(far), np.full((len(own), DEGREE), -1, np.int64)
    r = rows[:, 0]
    for k in range(DEGREE):
        j = alive.argmax(axis=1)
        ok = alive[r, j]
        if not ok.any():
            break
        out[:, k] = np.where(ok, ids[r, j], -1)
        alive[r, j] = False
        alive &= ~(ok[:, None] & (alpha * alpha * between[r, j] <= far))
    return out


def build(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The graph of unit vectors and its entries: the node next to the mean, then each time the node furthest from those before."""
    n, rng = len(x), np.random.default_rng(seed)
    start = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[start[0]]
    while len(start) < min(ENTRIES, n):
        near[start] = np.inf
        start.append(int(near.argmin()))
        near = np.maximum(near, x @ x[start[-1]])
    start = np.array(start)
    graph = rng.integers(0, n, (n, min(DEGREE, max(1, n - 1))))
    graph = np.pad(graph, ((0, 0), (0, DEGREE - graph.shape[1])), constant_values=-1)
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            own = order[at : at + BATCH]
            found, _ = beam_search(x, graph, start, x[own])
            graph[own] = robust_prune(x, own, np.concatenate((found, graph[own], rng.integers(0, n, (len(own), RANDOM))), axis=1), alpha)
            back = pd.DataFrame({"to": graph[own].ravel(), "of": np.repeat(own, DEGREE)})
            back = back[back["to"] >= 0].sort_values(["to", "of"])
            back["at"] = back.groupby("to").cumcount()
            to = back["to"].unique()
            more = np.full((len(to), int(back["at"].max()) + 1 if len(back) else 0), -1, np.int64)
            more[np.searchsorted(to, back["to"]), back["at"]] = back["of"]
            for a in range(0, len(to), BATCH):
                part = to[a : a + BATCH]
                both = np.concatenate((graph[part], more[a : a + BATCH]), axis=1)
                slots = np.sort(both, axis=1)
                slots[:, 1:][slots[:, 1:] == slots[:, :-1]] = -1
                full = (slots >= 0).sum(axis=1) > DEGREE
                if full.any():
                    graph[part[full]] = robust_prune(x, part[full], both[full], alpha)
                if (~full).any():
                    graph[part[~full]] = -np.sort(-slots[~full], axis=1)[:, :DEGREE]
    return graph.astype(np.int32), start


INDEX = "dim int, shard int, n int, start array<int>, vectors binary, graph binary, members array<array<long>>"


def index(vectors: DataFrame, k: int = TOP, id_col: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard. All rows are indexed, but those with a null id, a null, empty or zero vector, or a null or
    non-finite component. A node stands for all equal vectors of its shard and holds their k + 1 smallest ids: no others can be
    among the k nearest of any row. Rows that repeat an id and its vector are one row."""
    ok = F.col("i").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where(ok).distinct()
    rows = materialise(rows.withColumn("dim", F.size("v")), "ann-rows")  # read again when the index is
    shards = {r.dim: -(-r.c // shard_rows) for r in rows.groupBy("dim").agg(F.count("*").alias("c")).collect()}
    if not shards:
        return vectors.sparkSession.createDataFrame([], INDEX)
    count = F.try_element_at(F.create_map(*[F.lit(x) for kv in shards.items() for x in kv]), F.col("dim"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("i", "v"), count).cast("int"))

    def make(b: pd.DataFrame) -> pd.DataFrame:
        x, of = np.unique(np.stack(b["v"].to_list()) + 0.0, axis=0, return_inverse=True)
        ids = b["i"].to_numpy(np.int64)
        order = np.lexsort((ids, of.ravel()))
        cuts = np.searchsorted(of.ravel()[order], np.arange(len(x) + 1))
        members = [ids[order[a:z]][: k + 1].tolist() for a, z in zip(cuts[:-1], cuts[1:])]
        graph, start = build(units(scaled(x)))
        return pd.DataFrame({"dim": [b["dim"].iloc[0]], "shard": [b["shard"].iloc[0]], "n": [len(x)], "start": [start.tolist()], "vectors": [x.tobytes()], "graph": [graph.tobytes()], "members": [members]})

    return rows.groupBy("dim", "shard").applyInPandas(make, INDEX)


def search(idx: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "vec_id", vector: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): the k nearest found for every row of queries, its own id left out,
    largest cosine first, ties to the smaller id. Queries that `index` would leave out get no rows. Query blocks of at most
    query_bytes are broadcast one after the other, and each block's result is written before the next."""
    spark = idx.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where("i is not null and v is not null and size(v) > 0").distinct()
    made: list[str] = []
    asked = materialise(asked.withColumn("n", F.size("v")), "ann-queries", made)
    parts = []
    for n, c in sorted((r.n, r.c) for r in asked.groupBy("n").agg(F.count("*").alias("c")).collect()):
        blocks = -(-c * n * 8 // query_bytes)
        for block in range(blocks):
            mine = asked.where((F.col("n") == n) & (F.pmod(F.xxhash64("i", "v"), F.lit(blocks)) == block)).select("i", "v").collect()
            mine = [r for r in mine if None not in r.v]
            q = np.array([r.v for r in mine]).reshape(-1, n)
            ok = np.isfinite(q).all(axis=1) & q.any(axis=1)
            if not ok.any():
                continue
            shared = spark.sparkContext.broadcast((np.array([r.i for r in mine], np.int64)[ok], q[ok]))

            def each(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                ids, q = shared.value
                q = scaled(q)
                unit, qn = units(q), np.sqrt((q * q).sum(axis=1))
                for b in batches:
                    for s in b.itertuples():
                        x = scaled(np.frombuffer(s.vectors, np.float64).reshape(s.n, s.dim))
                        xu, xn = units(x), np.sqrt((x * x).sum(axis=1))
                        graph = np.frombuffer(s.graph, np.int32).reshape(s.n, DEGREE)
                        out = []
                        for at in range(0, len(q), BATCH):
                            found, _ = beam_search(xu, graph, np.asarray(s.start), unit[at : at + BATCH], SEARCH_BEAM)
                            for i, near in enumerate(found[:, : 2 * k + 2], at):
                                near = near[near >= 0]
                                score = (x[near] * q[i]).sum(axis=1) / (xn[near] * qn[i])  # row by row: equal vectors score alike in every shard
                                rows = [(-v, m) for j, v in zip(near, score.tolist()) for m in s.members[j] if m != ids[i]]
                                out += [(ids[i], m, -v) for v, m in sorted(rows)[:k]]
                        yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

            near = idx.where(F.col("dim") == n).select("dim", "n", "start", "vectors", "graph", "members").mapInPandas(each, "query_id long, vec_id long, score double")
            ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
            parts.append(materialise(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ann", result=True))
            shared.unpersist()
    discard(spark, made)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    with scratch(spark):
        return search(materialise(index(vectors), "ann-index"), vectors.where("vec_id % 50 = 0"))
