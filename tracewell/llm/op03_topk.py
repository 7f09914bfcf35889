"""Operator 3: exact top-k by integer inner product, with multi-resolution segment statistics.

For a query q and a candidate x, |q - x|^2 is at least the sum over segments of w ((mean difference)^2 + (deviation difference)^2),
w being a segment's width (Cauchy-Schwarz in each segment). As <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2, that bound from below is
a bound from above on the score. Bounds go from one segment to ever more; a candidate that stays under a query's k-th best
score so far is done with, and what is left at the finest level is scored exactly. A bound equal to the k-th score survives,
so ties are kept.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, scratch, table

SCALE, TOP, QUERY_BYTES = 1024, 10, 32 << 20
#: Numbers of segments, coarse to fine; those over a vector's length aren't used.
LEVELS = (1, 4, 16)
#: From one pair in so many on, a block's bounds or scores are one product of matrices, which costs less than pair by pair.
DENSE = 64
#: Components from here on have no bounds; a number above any score.
HUGE, WIDEST = 2.0**400, 1 << 2300


def integers(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE x) of the vectors (all of one length) as float64, infinite where that overflows, and which of the vectors take part."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    ok = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.floor(SCALE * x), ok


def statistics(x: np.ndarray) -> list[np.ndarray]:
    """For each level, rows of sqrt(w) * (means, deviations): inner products of two such rows bound the score from above."""
    out = []
    for n in LEVELS:
        if n > x.shape[1]:
            break
        cuts = np.linspace(0, x.shape[1], n + 1).astype(int)
        parts = [x[:, a:z] for a, z in zip(cuts[:-1], cuts[1:])]
        out.append(np.hstack([np.sqrt(p.shape[1]) * np.stack((p.mean(axis=1), p.std(axis=1)), axis=1) for p in parts]))
    return out


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _whole(x: float, raw: float) -> int:
    return int(x) if math.isfinite(x) else SCALE * int(raw)  # so large a number is whole


def exact(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray) -> np.ndarray:
    """Integer inner products row by row: 64-bit ones, or Python's where a sum might not fit (the array then holds objects)."""
    most_a, most_b = np.abs(a).max(axis=1, initial=0), np.abs(b).max(axis=1, initial=0)
    with np.errstate(over="ignore", invalid="ignore"):
        small = (most_a < 2.0**62) & (most_b < 2.0**62) & (most_a * most_b * a.shape[1] < 2.0**62)
    if small.all():
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    out = np.empty(len(a), object)
    out[small] = np.einsum("ij,ij->i", a[small].astype(np.int64), b[small].astype(np.int64))
    for i in np.flatnonzero(~small):
        out[i] = sum(_whole(p, rp) * _whole(q, rq) for p, rp, q, rq in zip(a[i], raw_a[i], b[i], raw_b[i]))
    return out


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether doubles hold all inner products of whole rows exactly, whatever the order of their sums."""
    with np.errstate(over="ignore", invalid="ignore"):
        return bool(np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0**53)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which are the k largest scores, ties by the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


class Best:
    """The k best (score, id) of every query of a block so far. queries: their numbers, ids and vectors."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, raw: np.ndarray, k: int):
        self.numbers, self.ids, self.raw, self.k = numbers, ids, raw, k
        self.x, _ = integers(list(raw))
        self.stats, self.norms = self._bounds(self.x)
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * len(ids)
        self.found: list[np.ndarray] = [np.empty(0, np.int64)] * len(ids)
        self.least = np.full(len(ids), -np.inf)

    @staticmethod
    def _bounds(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Statistics and norms; rows too large for their squares are infinitely long, so that no bound drops them."""
        huge = ~(np.abs(x).max(axis=1, initial=0) < HUGE)
        y = np.where(huge[:, None], 0.0, x)
        return statistics(y), np.where(huge, np.inf, norms(y))

    def _slack(self, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What rounding can take from a bound: it goes with both norms, not with the sum, whose terms may cancel out."""
        with np.errstate(invalid="ignore"):
            s = (self.x.shape[1] + 64) * 1e-15 * m * n + 1
        return np.where(np.isnan(s), np.inf, s)

    def offer(self, ids: np.ndarray, raw: np.ndarray) -> None:
        x, _ = integers(list(raw))
        stats, sizes = self._bounds(x)
        for at in range(0, len(self.ids), 256):
            rows = slice(at, min(at + 256, len(self.ids)))
            limit = self.least[rows, None] - self._slack(self.norms[rows, None], sizes[None, :])
            q, c = np.nonzero(self.stats[0][rows] @ stats[0].T >= limit)
            for level in range(1, len(stats)):
                if len(q) * DENSE >= limit.size:
                    keep = (self.stats[level][rows] @ stats[level].T)[q, c] >= limit[q, c]
                else:
                    parts = [(q[a : a + 200_000], c[a : a + 200_000]) for a in range(0, len(q), 200_000)]  # bounded memory
                    keep = np.concatenate([*(np.einsum("ij,ij->i", self.stats[level][at + i], stats[level][j]) >= limit[i, j] for i, j in parts), np.empty(0, bool)])
                q, c = q[keep], c[keep]
            keep = self.ids[at + q] != ids[c]
            q, c = q[keep], c[keep]
            if len(q) * DENSE >= limit.size and _fits(self.x[rows], x):
                score = (self.x[rows] @ x.T)[q, c].astype(np.int64)
            else:
                parts = [(at + q[a : a + 100_000], c[a : a + 100_000]) for a in range(0, len(q), 100_000)]
                score = np.concatenate([*(exact(self.x[i], x[j], self.raw[i], raw[j]) for i, j in parts), np.empty(0, np.int64)])
            cuts = np.searchsorted(q, np.arange(rows.stop - at + 1))
            for i in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[i], cuts[i + 1])
                s = np.concatenate((self.scores[at + i], score[part]))
                f = np.concatenate((self.found[at + i], ids[c[part]]))
                order = first(s, f, self.k)
                self.scores[at + i], self.found[at + i] = s[order], f[order]
                if len(order) == self.k:
                    self.least[at + i] = _double(int(s[order[-1]]))

    def rows(self) -> pd.DataFrame:
        n = [len(s) for s in self.scores]
        score = np.concatenate([*self.scores, np.empty(0, np.int64)])
        whole = [int(s) for s in score] if score.dtype == object else None
        return pd.DataFrame(
            {
                "q": np.repeat(self.numbers, n),
                "query_id": np.repeat(self.ids, n),
                "vec_id": np.concatenate([*self.found, np.empty(0, np.int64)]),
                "score": score if whole is None else np.array([min(max(s, -(2**63)), 2**63 - 1) for s in whole], np.int64),
                # Beyond 64 bits scores are told apart by their bytes, which sort as the numbers do.
                "beyond": [b""] * len(score) if whole is None else [(s + WIDEST).to_bytes(300, "big") if not -(2**63) < s < 2**63 else b"" for s in whole],
            }
        )


def _double(score: int) -> float:
    try:
        return float(score)
    except OverflowError:
        return -math.inf if score < 0 else sys.float_info.max


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "vec_id", vector: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): the k rows of `vectors` with the largest scores for each row of
    `queries`, the query's own id left out, ties to the smaller id; all of them if there are fewer.

    Rows with a null id or vector, an empty one, a null or non-finite component take no part; only vectors of one length are compared.
    Rows of `vectors` that repeat an id count as many times as they occur; rows of `queries` that repeat an id and its vector are one query, and
    with another vector a query of its own, of the same query_id. Scores are exact for all finite numbers; one beyond 64 bits is ranked as it
    is and given as the largest or smallest long. Empty tables give an empty result; other columns aren't read, so no names clash. The
    queries are dealt into blocks of at most query_bytes, broadcast one after the other; each block scans all rows, and its result is written
    before the next.
    """
    spark = vectors.sparkSession
    usable = F.col("i").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where(usable & (F.size("v") > 0))
    source, schema, parts = pick(vectors), "q long, query_id long, vec_id long, score long, beyond binary", []
    with scratch(spark):
        asked = materialise(pick(queries).distinct().select(F.monotonically_increasing_id().alias("q"), "i", "v", F.size("v").alias("n")), "topk-queries")
        sizes = asked.groupBy("n").agg(F.count("*").alias("c")).collect()  # a row for each length of vector
        for n, c in sorted((r.n, r.c) for r in sizes):
            blocks = -(-c * n * 8 // query_bytes)
            for block in range(blocks):
                mine = asked.where((F.col("n") == n) & (F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)).select("q", "i", "v").collect()
                if not mine:
                    continue
                shared = spark.sparkContext.broadcast((np.array([r.q for r in mine], np.int64), np.array([r.i for r in mine], np.int64), np.array([r.v for r in mine], np.float64)))

                def each(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                    best = Best(*shared.value, k)
                    for b in batches:
                        for a in range(0, len(b), 2048):
                            part = b.iloc[a : a + 2048]
                            best.offer(part["i"].to_numpy(np.int64), np.stack(part["v"].to_list()).astype(np.float64))
                    yield best.rows()

                near = source.where(F.size("v") == n).mapInPandas(each, schema)
                place = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
                ranked = near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
                parts.append(materialise(ranked.select("query_id", "rank", "vec_id", "score"), "topk", result=True))
                shared.unpersist()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, parts)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
