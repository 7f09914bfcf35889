"""Operator 1: secrets, by fixed patterns and by a battery of randomness tests with false-discovery control.

Candidates are runs of at least `LEAST` characters of the base64 alphabets outside the patterns' spans. Each gets the smallest
encoding that holds all its characters, and a battery's p-value of being random in it: the chi-squared test of a uniform alphabet, the runs test
of upper and lower alphabet halves and the lag-1 serial correlation, combined by Fisher's method. Candidates are grouped by encoding and class of
length, and Benjamini-Hochberg runs over each group twice. First on the battery's p-values: what it finds not to be random goes. Then against chance,
on the rest: the likelihood ratio of the uniform encoding to the corpus's own character pairs is, under natural text, at least x with
probability at most 1 / x, so its inverse is a p-value, which longer strings make smaller by themselves; it is divided by the battery's p-value, so
the less random a string looks, the more its other evidence must say.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")  # of a run [0-9a-f]+ under 32 no part has 32
LEAST, BATTERY, DISCOVERY, LONGEST_LOG, ODDEST = 20, 1e-3, 1e-3, 1000, 100
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings in order of size; a string takes the first that holds all its characters.
ENCODINGS = [
    ("hex", DIGITS + "abcdef"),
    ("HEX", DIGITS + "ABCDEF"),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("BASE36", DIGITS + UPPER),
    ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
]
TABLES = [(name, len(chars), frozenset(chars), {c: i for i, c in enumerate(chars)}) for name, chars in ENCODINGS]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: leftmost, not overlapping within a kind, failing matches dropped."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(codes: np.ndarray, size: int) -> float:
    """The combined p-value of a uniformly random string of codes 0 .. size - 1 being this uneven or this ordered."""
    n = len(codes)
    chi = float(((np.bincount(codes, minlength=size) - n / size) ** 2).sum() * size / n)
    p_chi = _normal_tail((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))
    half = codes * 2 >= size
    up = int(half.sum())
    if 0 < up < n:
        mean = 2 * up * (n - up) / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p_runs = math.erfc(abs(1 + int((half[1:] != half[:-1]).sum()) - mean) / math.sqrt(2 * var))
    else:
        p_runs = 2.0 ** (1 - n)
    c = codes - codes.mean()
    var = float((c * c).sum())
    p_serial = math.erfc(abs(float((c[1:] * c[:-1]).sum()) / var * math.sqrt(n) + 1 / math.sqrt(n)) / math.sqrt(2)) if var else 0.0
    x = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return math.exp(-x) * (1 + x + x * x / 2)  # Fisher: chi-squared of 6 degrees


def pair_counts(docs: DataFrame, text: str) -> np.ndarray:
    """(128, 128) counts of adjacent ASCII characters over all texts, in lower case (names run together in capitals are still words);
    others count as code 0. Sums of each task are added up."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 14, np.int64)
        for b in batches:
            for at in range(0, len(b), 256):
                codes = np.frombuffer("\x00".join(b["t"].iloc[at : at + 256]).lower().encode("utf-8", "surrogatepass"), np.uint8)
                codes = np.where(codes < 128, codes, 0).astype(np.int64)
                total += np.bincount((codes[:-1] << 7) | codes[1:], minlength=1 << 14)
        yield pd.DataFrame({"pair": np.flatnonzero(total), "n": total[total > 0]})

    out = np.zeros(1 << 14, np.int64)
    found = docs.select(F.col(text).alias("t")).where("t is not null").mapInPandas(each, "pair long, n long")
    for r in found.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 2^14 rows at most
        out[r.pair] = r.n
    return out.reshape(128, 128)


def log_model(pairs: np.ndarray) -> np.ndarray:
    """log2 probabilities of a character after another, every pair counted once more."""
    smooth = pairs + 1.0
    return np.log2(smooth / smooth.sum(axis=1, keepdims=True))


def judge(token: str, model: np.ndarray) -> tuple[str, float, float] | None:
    """(encoding, battery p, evidence in bits) of a candidate; None if it has one kind of character only or no encoding."""
    body = token.rstrip("=")
    chars = set(body)
    if chars <= set(DIGITS) or chars <= set(LOWER) or chars <= set(UPPER):
        return None
    for name, size, allowed, at in TABLES:
        if chars <= allowed:
            codes = np.fromiter((at[c] for c in body), np.int64, len(body))
            low = body.lower()
            raw = np.frombuffer(low.encode(), np.uint8).astype(int)
            first = np.concatenate(([32], raw[:-1]))
            alike = sum(c.lower() in at and c.upper() in at and c.isalpha() for c in low)  # either case of a letter makes the same pair
            return name, battery(codes, size), float(alike - math.log2(size) * len(body) - model[first, raw].sum())
    return None


def merged(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of sorted spans."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e, _ in spans:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def candidates(text: str, base: list[tuple[int, int, str]], model: np.ndarray) -> Iterator[tuple[int, int, str, int, int]]:
    """(start, end, encoding, whole bits of evidence, whole bits against randomness) of the candidates that overlap no span of base."""
    starts, ends = merged(base)
    for c in CANDIDATE.finditer(text):
        s, e = c.span()
        i = bisect.bisect_right(ends, s)
        if i < len(starts) and starts[i] < e:
            continue
        if found := judge(c.group(), model):
            odd = -math.log2(max(found[1], 1e-300))
            yield s, e, found[0], max(0, min(LONGEST_LOG, math.floor(found[2] - odd))), min(ODDEST, math.floor(odd))


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", discovery: float = DISCOVERY) -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind, encoding>>): one row for each row of docs, repeated rows included.

    The fixed patterns' spans are always there; a random string's span never overlaps them. start and end are code points, spans come by start,
    then kind as listed. Null and empty texts have no spans; texts of any length are scanned whole; an empty table gives an empty result. A string
    that repeats is as many candidates. Other columns aren't read, so no names clash.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t"))
    model = docs.sparkSession.sparkContext.broadcast(log_model(pair_counts(docs, text)))
    span = "array<struct<start:int,end:int,kind:string,encoding:string,bits:int,odd:int>>"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            out = []
            for t in b["t"]:
                spans: list[tuple] = []
                if t and (":" in t or "=" in t or max(map(len, t.split()), default=0) >= 16):
                    base = base_spans(t)
                    spans = [(s, e, k, "", 0, 0) for s, e, k in base]
                    spans += [(s, e, "random", name, bits, odd) for s, e, name, bits, odd in candidates(t, base, m)]
                out.append(spans)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "spans": out})

    # Kept while the result is read: it is all that the result is made from.
    found = materialise(source.mapInPandas(each, f"doc_id long, spans {span}"), "secrets")
    size = lambda s: F.floor(F.log2((s["end"] - s["start"]) / LEAST)).cast("int")
    group = lambda s: F.concat_ws(":", s["encoding"], size(s).cast("string"))

    def bounds(spans: Column, field: str, level: float) -> Column | None:
        """The bounds of the groups, as a map: a row for each of LONGEST_LOG + 1 numbers at most of each encoding and class of length (a power of two)."""
        one = found.select(F.explode(F.filter(spans, lambda s: s["kind"] == "random")).alias("s")).select("s.*")
        one = one.groupBy("encoding", size({c: F.col(c) for c in ("start", "end")}).alias("size"), F.col(field).alias("bits")).count()
        least = thresholds([(r.encoding, r.size, r.bits, r["count"]) for r in one.collect()], level)
        return F.create_map(*[F.lit(x) for (e, n), bits in least.items() for x in (f"{e}:{n}", bits)]) if least else None

    def passing(spans: Column, ok: Callable[[Column], Column]) -> Column:
        return F.filter(spans, lambda s: (s["kind"] != "random") | ok(s))

    odd = bounds(F.col("spans"), "odd", BATTERY)
    spans = F.col("spans") if odd is None else passing(F.col("spans"), lambda s: s["odd"] < F.coalesce(F.try_element_at(odd, group(s)), F.lit(ODDEST + 1)))
    least = bounds(spans, "bits", discovery)
    kept = passing(spans, lambda s: F.lit(False) if least is None else s["bits"] >= F.coalesce(F.try_element_at(least, group(s)), F.lit(LONGEST_LOG + 1)))
    order = F.create_map(*[F.lit(x) for kv in {k: i for i, k in enumerate(KINDS)}.items() for x in kv])
    kept = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"), s["encoding"].alias("encoding")))
    return found.select("doc_id", F.transform(F.array_sort(kept), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["encoding"].alias("encoding"))).alias("spans"))


def thresholds(counts: list[tuple[str, int, int, int]], discovery: float) -> dict[tuple[str, int], int]:
    """The fewest bits (a p-value of 2^-bits at most) that Benjamini-Hochberg rejects at, by encoding and class of length, from counts of whole bits."""
    groups: dict[tuple[str, int], dict[int, int]] = {}
    for encoding, size, bits, n in counts:
        g = groups.setdefault((encoding, size), {})
        g[bits] = g.get(bits, 0) + n
    out = {}
    for key, g in groups.items():
        total, above = sum(g.values()), 0
        for bits in sorted(g, reverse=True):
            above += g[bits]
            if 2.0**-bits <= discovery * above / total:
                out[key] = bits
    return out


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"))

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, KINDS[:3]), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), number("random"))
