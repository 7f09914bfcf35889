"""Operator 9: near-duplicate documents by SimHash, with pigeonring filtering of candidates.

Two 64-bit fingerprints on a ring of 4 segments differ in at most 3 bits only if some chain of consecutive segments
keeps, at each of its lengths l, at most floor(3 l / 4) differing bits: 0, 1, 2, 3 (the pigeonring principle). The first
two lengths are in the join key: one side gives a segment and the next one as they are (4 rows a fingerprint), the other
gives the segment with the next one unchanged or with one bit flipped (68 rows). Longer chains are checked on the pairs that
meet, then the full Hamming distance. Keys have 32 bits besides the segment's number, so buckets stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near
from .common import bucket, buckets, connected, materialise, packed, scratch, table, trim

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEGMENTS, WIDTH, BITS = 4, 16, 3
#: Of documents of which one stays: words of a shingle and Jaccard similarity.
WORDS, SIMILARITY = 5, 0.8


def shingles(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """Hashes of the shingles of `words` words, in their order; of a shorter text as a whole; none where there is no word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    n = len(tokens) - words + 1
    digest = xxhash.xxh64_intdigest
    if n < 2:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64, n)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the shingles of `words` words; 0 where there is no word."""
    h = shingles(text, words, seed)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):  # very long texts: bounded memory
        bits = np.unpackbits(h[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3) -> DataFrame:
    """(doc_id, fp): one row for each row of docs; null and empty texts have fingerprint 0."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = [fingerprint(t, words) for t in b["t"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": np.array(fp, np.int64)})
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInPandas(each, "doc_id long, fp long")


def _segment(fp, i: int):
    return F.shiftrightunsigned(fp, 48 - WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF).cast("long"))


def _key(i: int, first, second):
    return F.shiftleft(first, 16).bitwiseOR(second).bitwiseOR(F.lit(i << 32).cast("long"))


def pairs(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b), a < b: pairs of different fingerprints of the distinct column fp at 3 or fewer differing bits; a pair may
    come more than once. No bucket is capped."""
    x, y = F.col("a"), F.col("b")
    flips = F.expr("transform(sequence(0, 16), j -> if(j = 16, 0L, shiftleft(1L, j)))")
    left = fps.select(F.col(fp).alias("a")).select("a", F.explode(F.array(*[_key(i, _segment(x, i), _segment(x, i + 1)) for i in range(SEGMENTS)])).alias("key"))
    right = fps.select(F.col(fp).alias("b")).select("b", F.explode(F.array(*[_key(i, _segment(y, i), _segment(y, i + 1)) for i in range(SEGMENTS)])).alias("k"))
    right = right.select("b", "k", F.explode(flips).alias("flip")).select("b", F.col("k").bitwiseXOR(F.col("flip")).alias("key"))
    differ = x.bitwiseXOR(y)
    start = F.shiftright("key", 32).cast("int")
    turned = F.expr("shiftleft(a ^ b, 16 * cast(shiftright(key, 32) as int)) | shiftrightunsigned(a ^ b, 64 - 16 * cast(shiftright(key, 32) as int))")
    chain = F.when(start == 0, differ).otherwise(turned)  # the differing bits, the chain's first segment on top
    near = (x < y) & (F.bit_count(F.shiftrightunsigned(chain, 16)) <= 2) & (F.bit_count(differ) <= BITS)
    # Spark takes exploded rows for as few bytes as the table they come from, and would broadcast all 68 a fingerprint.
    joined = left.hint("merge").join(right.withColumnRenamed("key", "key2").hint("merge"), F.expr("key = key2") & near)
    return joined.select("a", "b")


def _rooted(own: DataFrame) -> DataFrame:
    """(fp, first, root): every fingerprint of own with its smallest id and the smallest fingerprint that links reach."""
    fps = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-fp")
    links = materialise(pairs(fps), "simhash-links")
    roots = materialise(connected(links), "simhash-roots")
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return materialise(rooted, "simhash-rooted")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs, repeated rows included.

    component_id is the smallest doc_id that links of at most 3 differing bits reach; null where all of them are null.
    An empty table gives an empty result; texts without words share fingerprint zero; texts of any length are read whole. Other columns are not
    read, so no names clash.
    """
    with scratch(docs.sparkSession):
        own = materialise(fingerprints(docs, text, id_col, words), "simhash", result=True)
        rooted = _rooted(own)
        least = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
        of = materialise(rooted.join(least, "root").select("fp", "component_id"), "simhash-of", result=True)
    return own.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, grouped: DataFrame, text: str, id_col: str) -> DataFrame:
    """The rows and columns of docs, one of each group of grouped (doc_id, h, root): that of the smallest id and, where the id repeats,
    of the smallest hash. Rows with a null id stay where nothing but null ids is in their group; of rows that repeat an id and its
    text, one stays.

    Every row is decided by its id and its text. Only rows in the hash buckets of groups of two or more are joined; all others
    pass as they are read.
    """
    place = F.struct("doc_id", "h")
    many = grouped.groupBy("root").agg(F.count("*").alias("m"), F.min(F.when(F.col("doc_id").isNotNull(), place)).alias("kept")).where("m > 1")
    goes = F.col("kept").isNotNull() & ~place.eqNullSafe(F.col("kept"))
    marked = grouped.join(many, "root").select("doc_id", "h", goes.alias("goes"))
    marked = materialise(marked.distinct(), "near-marked")
    source = docs.select(packed(docs).alias("own"), F.col(id_col).cast("long").alias("i"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    source = source.withColumn("b", bucket(F.col("th")))
    met = buckets(marked, "h")
    others = source.join(met, F.col("b") == F.col("_hash_bucket"), "left_anti")
    joined = source.join(met, F.col("b") == F.col("_hash_bucket"), "left_semi")
    same = F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("th") == F.col("h"))
    left = joined.join(marked.where("goes"), same, "left_anti").dropDuplicates(["i", "t"])
    return others.select("own").unionByName(left.select("own")).select("own.*")


def proposed(own: DataFrame) -> DataFrame:
    """(a, b), a < b: sets (u, fp) whose SimHashes are within 3 bits, each through the first set of its SimHash."""
    fps = materialise(own.groupBy("fp").agg(F.min("u").alias("u")), "simhash-fp")
    first = lambda c: fps.select(F.col("fp").alias(c), F.col("u").alias(f"u{c}"))
    linked = pairs(fps.select("fp")).distinct().join(first("a"), "a").join(first("b"), "b").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
    same = own.select("fp", F.col("u").alias("o")).join(fps, "fp").where("o <> u").select(F.col("u").alias("a"), F.col("o").alias("b"))
    return linked.unionByName(same)


def first_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """The rows and columns of docs, one of each group of near duplicates, as `keep_first` has it: links are all pairs whose shingles of `words`
    words have a Jaccard similarity of `least` or more.

    Pairs of SimHashes that pigeonring filtering finds are compared first, on their whole sets of shingles. Texts of that similarity differ in
    more than 3 bits, mostly, so `near` finds all others. Null, empty and wordless texts are one group; very long texts take part whole; repeated rows
    are one; an empty table gives an empty result; no column names clash.
    """
    with scratch(docs.sparkSession):
        grouped = materialise(near.members(docs, proposed, text, id_col, words, least), "near-groups", result=True)
    return keep_first(docs, grouped, text, id_col)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
