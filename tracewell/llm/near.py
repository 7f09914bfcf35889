"""The whole links of operator 9: pairs of documents whose shingles are similar enough, without a miss.

Two sets of m and n shingles of Jaccard similarity s or more share at least s max(m, n) of them, so under any one order of all
shingles the first n - ceil(s n) + 1 of either hold a common one (prefix filtering). The order is that of hashes, with shingles that
many documents have last: whichever those are, no pair is lost, and buckets stay small. Each bucket is linked to a few of its sets
first; then all its pairs that are not connected yet are compared, so a large group of near copies costs its size. Pairs are first
held against parities of their sets, about a bit a shingle, which prove most to have too much apart (the bitmap filter) and never leave out
a link. Every link is verified on the whole sets, which are read again from the texts for the sets that are wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import bitmap, chunks, connected, discard, in_bitmap, materialise, trim

#: Times that a shingle is among the first of documents to come last, shingles that come last at most, and centres of a bucket.
FREQUENT, HOT, CENTRES = 32, 1 << 18, 2
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def prefix(n: np.ndarray, least: float) -> np.ndarray:
    """How many shingles of n two sets of the similarity can't both have apart."""
    return np.where(n > 0, n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, 0)


def shingled(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the shingles of each text one after the other, in order, repeats included, and their texts."""
    h, row = hashing.words([(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts])
    return hashing.shingles(h, row, words, len(texts))


def distinct(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, sorted, one row after the other, and how many each has."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=rows)


def first_keys(h: np.ndarray, n: np.ndarray, least: float, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of sorted sets that lie one after the other, those among `last` (sorted) coming last, and how many each has."""
    row = np.repeat(np.arange(len(n)), n)
    at = np.minimum(np.searchsorted(last, h), max(0, len(last) - 1))
    order = np.lexsort((h, last[at] == h, row)) if len(last) else np.arange(len(h))
    kept = np.arange(len(h)) - (np.cumsum(n) - n)[row] < prefix(n, least)[row]
    return h[order][kept], prefix(n, least)


def frequent(docs: DataFrame, text: str, words: int, least: float) -> Broadcast:
    """The shingles, sorted, that are most often among the first of all documents, HOT at most. Those that a task has once aren't counted: what
    is left out only makes buckets larger, and loses no pair."""

    def counted(keys: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["key", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                keys.append(first_keys(*distinct(*shingled(texts, words), len(texts)), least, np.zeros(0, np.uint64))[0])
                if sum(map(len, keys)) > 1 << 22:
                    yield counted(keys)
                    keys = []
        yield counted(keys)
        trim()

    found = docs.select(F.col(text).alias("t")).where("t is not null").mapInArrow(each, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    hot = found.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(HOT).select("key").toArrow()
    return docs.sparkSession.sparkContext.broadcast(np.sort(hot.column(0).to_numpy().view(np.uint64)))


def parities(s: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each set a bitmap of the least power of two of bits that is 64 or more and its size or more: whether an odd number of its hashes
    fall on a bit. Sets that differ in d hashes differ in d bits at most, also once the longer bitmap is folded."""
    bits = 1 << np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64)
    first = np.cumsum(bits) - bits
    at = (s & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(first, n)
    packed = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(bool), bitorder="little").tobytes()
    return [packed[a : a + b] for a, b in zip((first >> 3).tolist(), (bits >> 3).tolist())]


def apart(x: bytes, y: bytes) -> int:
    """How many hashes two sets differ in at least, by their parities."""
    if len(x) < len(y):
        x, y = y, x
    a, bits = int.from_bytes(x, "little"), 8 * len(x)
    while bits > 8 * len(y):
        bits >>= 1
        a = a >> bits ^ a & (1 << bits) - 1
    return (a ^ int.from_bytes(y, "little")).bit_count()


SETS = "doc_id long, h long, k long, k2 long, n int, fp long, parity binary, keys array<long>"


def sets(docs: DataFrame, text: str, id_col: str, words: int, least: float) -> DataFrame:
    """One row for each row of docs: h is the text's hash, k and k2 the halves of the hash of its set of n shingles, fp its SimHash, parity its
    bitmap of `parities`, keys the prefix."""
    last = frequent(docs, text, words, least)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(2)):
                h, row = shingled(texts, words)
                fp = hashing.simhashes(h, np.bincount(row, minlength=len(texts)))
                s, n = distinct(h, row, len(texts))
                keys, m = first_keys(s, n, least, last.value)
                k = named(s, n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(m))), pa.int32()), pa.array(keys.view(np.int64)))
                own = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(n.astype(np.int32)), pa.array(fp), pa.array(parities(s, n), pa.binary()), lists], names=["doc_id", "h", "k", "k2", "n", "fp", "parity", "keys"])
        trim()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    return source.mapInArrow(each, SETS)


def named(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(rows, 2): the halves of the 128-bit hash of each set."""
    ends = np.cumsum(n)
    digests = b"".join(xxhash.xxh3_128_digest(s[e - m : e].tobytes()) for e, m in zip(ends.tolist(), n.tolist()))
    return np.ascontiguousarray(np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2).T).T


def whole_sets(wanted: DataFrame, docs: DataFrame, text: str, words: int) -> DataFrame:
    """(u, s): the shingles of the sets wanted (u, k, k2), read again from docs; of equal sets, one of each run of texts is sent on."""
    shared = bitmap(wanted, "k")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                s, n = distinct(*shingled(texts, words), len(texts))
                k = named(s, n)
                _, first = np.unique(k[:, 0], return_index=True)
                some = np.sort(first[in_bitmap(shared.value, np.ascontiguousarray(k[first, 0]))])
                ends = np.cumsum(n)
                parts = [s[ends[i] - n[i] : ends[i]] for i in some]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n[some]))), pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(k[some, 0]), pa.array(k[some, 1]), lists], names=["k", "k2", "s"])
        trim()

    found = docs.select(F.col(text).alias("t")).mapInArrow(each, "k long, k2 long, s array<long>")
    found = found.groupBy("k", "k2").agg(F.first("s").alias("s"))
    return materialise(found.join(wanted, ["k", "k2"]).select("u", "s"), "near-sets")


def possible(pairs: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of sets that their parities don't prove to be less similar: sets of m and n shingles that are similar enough differ in
    at most (m + n) (1 - least) / (1 + least)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            most = (p.column(2).to_numpy().astype(np.int64) + p.column(3).to_numpy()) * (1 - least) / (1 + least) + 1e-6
            differ = np.fromiter(map(apart, p.column(4).to_pylist(), p.column(5).to_pylist()), np.int64, len(p))
            yield p.select(["a", "b"]).filter(pa.array(differ <= most))
        trim()

    side = lambda c: own.select(F.col("u").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb")
    return materialise(both.mapInArrow(each, "a long, b long"), "near-possible")


def verified(pairs: DataFrame, own: DataFrame, docs: DataFrame, text: str, words: int, least: float) -> DataFrame:
    """The pairs (a, b) of sets that have the similarity."""
    pairs = possible(pairs, own, least)
    ends = pairs.select(F.col("a").alias("u")).unionByName(pairs.select(F.col("b").alias("u"))).distinct()
    wanted = materialise(own.select("u", "k", "k2").join(ends, "u", "left_semi"), "near-wanted")
    met = whole_sets(wanted, docs, text, words)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            alike = []
            for x, y in zip(p.column(2), p.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(common >= least * (len(x) + len(y) - common) - 1e-9)
            yield p.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))
        trim()

    both = pairs.join(met.select(F.col("u").alias("a"), F.col("s").alias("sa")), "a").join(met.select(F.col("u").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(each, "a long, b long")


def members(docs: DataFrame, proposed, text: str, id_col: str, words: int, least: float) -> DataFrame:
    """(doc_id, h, root): the group of each row of docs, whose text has the hash h. Texts of the same shingles are in one group,
    as are all that links of the similarity connect; texts without words are a group of their own.

    proposed gets the distinct sets (u, fp and more) and gives pairs (a, b) of them that are compared first.
    """
    wide: list[str] = []
    keys: list[str] = []
    rows = materialise(sets(docs, text, id_col, words, least), "near", wide)
    own = rows.groupBy("k", "k2").agg(*[F.first(c).alias(c) for c in ("n", "fp", "parity", "keys")]).withColumn("u", F.monotonically_increasing_id())
    own = materialise(own, "near-keys", keys)
    rows = materialise(rows.select("doc_id", "h", "k", "k2"), "near-rows")
    discard(docs.sparkSession, wide)
    keyed = own.select("u", "n", F.explode("keys").alias("key")).repartition("key")  # dealt once, for the sums and the join
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    met = materialise(keyed.join(shared.hint("shuffle_hash"), "key", "left_semi"), "near-met")
    own = materialise(own.select("u", "k", "k2", "n", "fp", "parity"), "near-own")
    discard(docs.sparkSession, keys)  # nothing that follows reads the prefixes
    like = lambda n, o: F.lit(least) * F.greatest(n, o) - 1e-9 <= F.least(n, o)
    centres = met.groupBy("key").agg(F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("u", F.lit(i)), "u", "n")) for i in range(CENTRES)])).alias("centres"))
    near = F.transform(F.filter("centres", lambda c: (c["u"] != F.col("u")) & like(F.col("n"), c["n"])), lambda c: c["u"])
    stars = met.join(centres, "key").select("u", F.explode(near).alias("c")).select(F.least("u", "c").alias("a"), F.greatest("u", "c").alias("b"))
    first = materialise(stars.unionByName(proposed(own)).distinct(), "near-first")
    linked = materialise(verified(first, own, docs, text, words, least), "near-links")
    roots = connected(linked)
    of = met.join(roots, met.u == roots.node, "left").select("key", "u", "n", F.coalesce("root", "u").alias("root"))
    split = of.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    of = materialise(of.join(split, "key", "left_semi"), "near-rooted")
    left, right = of.alias("l"), of.alias("r")
    open_ = (F.col("l.key") == F.col("r.key")) & (F.col("l.u") < F.col("r.u")) & (F.col("l.root") != F.col("r.root")) & like(F.col("l.n"), F.col("r.n"))
    rest = left.join(right, open_).select(F.col("l.u").alias("a"), F.col("r.u").alias("b")).distinct()
    rest = materialise(rest.join(first, ["a", "b"], "left_anti"), "near-rest")  # others are compared already
    roots = materialise(connected(linked.unionByName(verified(rest, own, docs, text, words, least))), "near-roots")
    of = materialise(own.join(roots, own.u == roots.node, "left").select("k", "k2", F.coalesce("root", "u").alias("root")), "near-of")
    return rows.join(of, ["k", "k2"]).select("doc_id", "h", "root")
