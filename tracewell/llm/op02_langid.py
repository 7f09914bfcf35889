"""Operator 2: language identification by nearest centroid.

A text is the TF-IDF vector of its hashed letter n-grams (1 to 3 letters, other characters as one space), of length one. Each
language has a few centroids, clustered from a bounded sample of its training rows; a text goes to the centroid of largest
cosine, and is rejected when it is far further from it than the language's own rows are, for its number of n-grams.
Document frequencies are counted over all training rows, the sample serves the clustering alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, table, trim

#: Hashed dimensions, centroids for a language, and the bound of the sample: rows for a language.
DIMS, CENTROIDS, SAMPLE = 1 << 13, 4, 600
#: Languages at most: their sample and centroids have room on the driver.
MAX_LANGUAGES = 250
#: Rejection below this share of the smallest cosine that a language's sampled rows of TYPICAL n-grams or more have; the
#: cosine of a shorter text falls with the root of its length, and so does the bound.
SLACK, TYPICAL = 0.4, 1024
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(texts: list[str | None]) -> np.ndarray:
    """float32 (texts, DIMS): how often each hashed n-gram occurs; a row of zeros where there is no letter."""
    joined = "\x00".join((t or "").lower().replace("\x00", " ") for t in texts) + "\x00"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    end = codes == 0
    row = np.cumsum(end) - end
    letter = _letters()[codes]
    keep = letter | np.concatenate(([True], letter[:-1] | end[:-1])) | end
    codes, row, letter = np.where(letter, codes, 32)[keep].astype(np.uint32), row[keep], letter[keep]
    out = np.zeros(len(texts) * DIMS, np.float32)
    base = row * DIMS
    h = np.zeros(len(codes), np.uint32)
    some, same = np.zeros(len(codes), bool), np.ones(len(codes), bool)
    for n in range(3):
        m = len(codes) - n
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + codes[n:] * np.uint32(0x9E3779B1)
        some, same = some[:m] | letter[n:], same[:m] & (row[:m] == row[n:])
        use = some & same
        mixed = h ^ (h >> np.uint32(15))
        at = base[:m][use] + ((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(19))[use].astype(np.int64)
        out += np.bincount(at, minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), DIMS)


def groups(texts: list[str | None], chars: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most 64 rows and about so many characters."""
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and end - at < 64 and (end == at or n + len(texts[end] or "") <= chars):
            n += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


@dataclass
class Model:
    langs: list[str]
    of: np.ndarray  # language of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    least: np.ndarray  # of each centroid: the smallest cosine that isn't rejected, for a typical length

    def vectors(self, x: np.ndarray) -> np.ndarray:
        v = np.log1p(x) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        lang, score, rejected = [], [], []
        for a, z in groups(texts):
            x = counts(texts[a:z])
            n = x.sum(axis=1)
            near = self.vectors(x) @ self.centroids.T
            best = near.argmax(axis=1)
            s = near[np.arange(z - a), best]
            known = n > 0
            lang += [self.langs[self.of[b]] if k else UNKNOWN for b, k in zip(best, known)]
            score.append(np.where(known, np.clip(s, 0, 1), 0))
            rejected.append(~known | (s < self.least[best] * np.sqrt(np.minimum(1, n / TYPICAL))))
        return lang, np.concatenate([*score, np.empty(0)]).astype(float), np.concatenate([*rejected, np.empty(0, bool)]).astype(bool)


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit vectors, begun at the points furthest from those taken; at most k centroids of length one."""
    centre = v.mean(axis=0)
    centre /= max(float(np.linalg.norm(centre)), 1e-12)
    near = v @ centre
    taken = [int(near.argmax())]
    near = v @ v[taken[0]]
    while len(taken) < min(k, len(v)):
        taken.append(int(near.argmin()))
        near = np.maximum(near, v @ v[taken[-1]])
    c = v[taken]
    for _ in range(rounds):
        of = (v @ c.T).argmax(axis=1)
        c = np.stack([v[of == i].mean(axis=0) if (of == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 5, is 0. A null id is neither learnt from nor held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> Model | None:
    """Learns from rows with an id, a text and a language that aren't held out, repeated rows as often as they occur; None if there is none.
    Over MAX_LANGUAGES languages are an error."""
    source = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    train = source.where(F.col("i").isNotNull() & F.col("t").isNotNull() & F.col("l").isNotNull() & ~held_out("i"))
    rows = {r.l: r.n for r in train.groupBy("l").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not rows:
        return None
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(DIMS, np.int64)
        for b in batches:
            texts = b["t"].tolist()
            for a, z in groups(texts):
                seen += (counts(texts[a:z]) > 0).sum(axis=0)
        yield pd.DataFrame({"dim": np.flatnonzero(seen), "df": seen[seen > 0]})
        trim()

    df = np.zeros(DIMS)
    for r in train.select("t").mapInPandas(frequencies, "dim long, df long").groupBy("dim").agg(F.sum("df").alias("df")).collect():
        df[r.dim] = r.df
    idf = (np.log((1 + sum(rows.values())) / (1 + df)) + 0.05).astype(np.float32)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, found = b["t"].tolist(), []
            for a, z in groups(texts):
                x = counts(texts[a:z])
                found += [(np.flatnonzero(r).astype("<i2").tobytes(), r[r > 0].astype("<f4").tobytes()) for r in x]
            yield pd.DataFrame({"l": b["l"], "o": b["o"], "dims": [d for d, _ in found], "n": [n for _, n in found]})

    # The rows with the smallest hashes: a share of each language that leaves room for chance, cut to SAMPLE on the driver.
    share = F.create_map(*[F.lit(x) for l, n in rows.items() for x in (l, min(1.0, 1.25 * SAMPLE / n + 30 / n))])
    order = F.xxhash64(F.col("i").cast("string"))
    unit = (F.shiftrightunsigned(order, 11)).cast("double") / float(1 << 53)
    picked = train.select("l", "t", order.alias("o")).where(unit < F.try_element_at(share, F.col("l")))
    sample: dict[str, list] = {}
    for r in picked.mapInPandas(sparse, "l string, o long, dims binary, n binary").collect():
        sample.setdefault(r.l, []).append((r.o, r.dims, r.n))

    model = Model(sorted(sample), np.empty(0, int), idf, np.empty((0, DIMS), np.float32), np.empty(0))
    for i, name in enumerate(model.langs):
        x = np.zeros((min(SAMPLE, len(sample[name])), DIMS), np.float32)
        for k, (_, dims, n) in enumerate(sorted(sample.pop(name), key=lambda s: s[0])[:SAMPLE]):
            x[k, np.frombuffer(dims, "<i2")] = np.frombuffer(n, "<f4")
        x = x[x.any(axis=1)]
        if not len(x):
            continue
        v = model.vectors(x)
        c = cluster(v, CENTROIDS)
        own, long = (v @ c.T).max(axis=1), x.sum(axis=1) >= TYPICAL
        model.least = np.concatenate((model.least, np.full(len(c), SLACK * own[long if long.any() else own > -1].min())))
        model.of = np.concatenate((model.of, np.full(len(c), i)))
        model.centroids = np.concatenate((model.centroids, c))
        del x, v
        trim()
    if not len(model.centroids):
        return None
    return model


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The columns of docs and lang_pred string, score double (the cosine, 0 to 1), rejected boolean; docs' own columns of these
    names are replaced, all others come through, whatever their names. Null texts and texts without letters are `und`, score 0, rejected; so is
    every text if there is no model. Each row is judged by its whole text alone, repeated ones alike; of equally near centroids the first counts. An
    empty table gives an empty result."""
    given = ("lang_pred", "score", "rejected")
    own = [c for c in docs.columns if c not in given]
    if model is None:
        found = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("lang_pred string, score double, rejected boolean")
        def classify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for t in texts:
                lang, score, rejected = shared.value.predict([None if x is None else x for x in t])
                yield pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})
            trim()

        found = classify(F.col(text))
    both = docs.select(packed(docs, given).alias("own"), found.alias("found"))
    return both.select(*[F.col("own").getField(c).alias(c) for c in own], *[F.col("found").getField(c).alias(c) for c in given])


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), fit(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
