"""Operator 4: mixing sources to target weights by temperature.

Source s has the share p_s of all tokens. Its weight is p_s^a, normalised; a = 1 keeps the shares, a = 0 makes all sources equal. The
exponent a is bisected, on a grid of `GRID` steps, to the least one that stays within the limit: an entropy of the weights not over the
target, or no source seen more often than the limit.

A source's rows are dealt by hash into blocks of about `BLOCK_TOKENS` tokens. A pass is a seeded permutation of the blocks, and of the
rows in each; a source's budget is so many whole passes, then the first blocks of one more, the last of them in part: the row
that reaches the budget is the last one taken. Permutations are orders of seeded hashes, so two keys a source, the last block's and
the last row's, say of every row by itself whether it's taken: texts are never shuffled, and only sums of blocks are ordered within a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, packed, table

GRID, BLOCK_TOKENS, SEED, REPETITION, MAX_SOURCES, PART_DIGITS = 1_000_000, 100_000, "mix", 2.0, 100_000, 3


def words(text: str = "text") -> Column:
    """Tokens of a text: its words between ASCII white space; null has none."""
    bare = F.trim(F.translate(F.col(text), "\t\n\x0b\x0c\r", "     "))
    return F.coalesce(F.when(bare == "", 0).otherwise(F.length(F.regexp_replace(bare, "[^ ]+ *", "x"))), F.lit(0)).cast("long")


def exponent(tokens: dict[str, int], entropy: float | None = None, repetition: float | None = None) -> float:
    """The least exponent on the grid that keeps to the limit, which larger exponents keep to as well: either the entropy of the weights, in
    nats, is at most `entropy`, or the most repeated source is seen at most `repetition` times as often as the least repeated one."""
    total = sum(tokens.values())
    shares = [n / total for n in tokens.values() if n]

    def within(step: int) -> bool:
        a = step / GRID
        raw = [p**a for p in shares]
        norm = math.fsum(raw)
        if entropy is not None:
            return -math.fsum(w / norm * math.log(w / norm) for w in raw) <= entropy
        seen = [w / norm / p for w, p in zip(raw, shares)]
        return max(seen) <= repetition * min(seen)

    low, high = 0, GRID
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if within(mid) else (mid + 1, high)
    return low / GRID


def budgets(tokens: dict[str, int], a: float, total: int | None = None) -> dict[str, int]:
    """Tokens to take of each source. Without a total: so many that the source seen least often is seen once."""
    n = sum(tokens.values())
    raw = {s: (t / n) ** a for s, t in tokens.items() if t}
    norm = math.fsum(raw.values())
    if total is None:
        total = max(math.floor(t * norm / raw[s]) for s, t in tokens.items() if t)
        return {s: max(tokens[s], math.floor(total * w / norm)) for s, w in raw.items()}
    return {s: math.floor(total * w / norm) for s, w in raw.items()}


def _key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def crossing(sums: DataFrame, key: str, base: Column) -> DataFrame:
    """The row of each source, by key, with which the sum of t from base on reaches `rest`, and before, the sum of those before it."""
    before = base + F.sum("t").over(Window.partitionBy("name").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")
    return sums.withColumn("before", before).where("before < rest and rest <= before + t")


def plan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", entropy: float | None = None, repetition: float | None = REPETITION, total: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The columns of docs and tokens, block, epochs, extra (long): a row for each row of docs, which is taken epochs times in whole
    passes and extra times, 0 or 1, in the pass in part. Own columns of these names are replaced.

    With no total, the source seen least often is seen once and no row is left out. Null sources are a source of their own.
    A row without words counts as one token. Rows that repeat id and text are taken together. At most MAX_SOURCES sources, which
    come to the driver as one row each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.md5(text).alias("h"), F.col(source).cast("string").alias("s"), F.greatest(words(text), F.lit(1).cast("long")).alias("tokens"))
    made_tables: list[str] = []
    rows = materialise(rows, "mix-rows", made_tables)
    totals = [(r.s, r.n) for r in rows.groupBy("s").agg(F.sum("tokens").alias("n")).limit(MAX_SOURCES + 1).collect()]
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    # A null gets a name that no source has: others are prefixed.
    tokens = {"" if s is None else f"={s}": n for s, n in totals}
    take = budgets(tokens, exponent(tokens, entropy, repetition if entropy is None else None), total) if tokens else {}
    made = [(s, n, take[s] // n, take[s] % n, max(1, -(-n // block_tokens))) for s, n in tokens.items()]
    named = F.coalesce(F.concat(F.lit("="), F.col("s")), F.lit(""))

    def dealt(df: DataFrame, sources: DataFrame) -> DataFrame:
        first = F.conv(F.substring(_key(F.col("i"), F.col("h")), 1, 15), 16, 10).cast("long")
        df = df.withColumn("name", named).join(F.broadcast(sources), "name").withColumn("block", first % F.col("blocks"))
        return df.withColumn("bk", _key(F.col("epochs"), F.col("name"), F.col("block"))).withColumn("rk", _key(F.col("epochs"), F.col("i"), F.col("h")))

    sources = spark.createDataFrame(made, "name string, n long, epochs long, rest long, blocks long")
    all_rows = dealt(rows, sources)
    sums = all_rows.where("rest > 0").groupBy("name", "bk", "rest").agg(F.sum("tokens").alias("t"))
    sums = materialise(sums.withColumn("part", F.substring("bk", 1, PART_DIGITS)), "mix-blocks", made_tables)
    # A source's blocks are summed by parts of the range of their keys first, 16^PART_DIGITS at most; then those of one part, one after the other.
    coarse = crossing(sums.groupBy("name", "part", "rest").agg(F.sum("t").alias("t")), "part", F.lit(0)).select("name", "part", F.col("before").alias("base"))
    coarse = spark.createDataFrame(coarse.collect(), "name string, part string, base long")  # one row for each source
    last = {r.name: (r.bk, r.rest - r.before) for r in crossing(sums.join(F.broadcast(coarse), ["name", "part"]), "bk", F.col("base")).collect()}
    cut = spark.createDataFrame([(s, bk, left) for s, (bk, left) in last.items()], "name string, bk string, remaining long")
    # The rows of one block of each source: block_tokens of them at most, about.
    inside = all_rows.join(F.broadcast(cut), ["name", "bk"]).groupBy("name", "remaining", "rk").agg(F.sum("tokens").alias("t"))
    so_far = F.sum("t").over(Window.partitionBy("name").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0))
    reached = inside.withColumn("c", so_far).where("c - t < remaining").groupBy("name").agg(F.max("rk").alias("rk"))
    last_row = {r.name: r.rk for r in reached.collect()}
    discard(spark, made_tables)
    cuts = [(*m, last[m[0]][0] if m[0] in last else "", last_row.get(m[0], "")) for m in made]
    sources = spark.createDataFrame(cuts, "name string, n long, epochs long, rest long, blocks long, last_block string, last_row string")
    own = [c for c in docs.columns if c not in ("tokens", "block", "epochs", "extra")]
    keyed = docs.select(packed(docs, ("tokens", "block", "epochs", "extra")).alias("own"), F.col(id_col).cast("string").alias("i"), F.md5(text).alias("h"), F.col(source).cast("string").alias("s"), F.greatest(words(text), F.lit(1).cast("long")).alias("tokens"))
    extra = (F.col("bk") < F.col("last_block")) | ((F.col("bk") == F.col("last_block")) & (F.col("rk") <= F.col("last_row")))
    return dealt(keyed, sources).select(*[F.col("own").getField(c).alias(c) for c in own], "tokens", "block", "epochs", extra.cast("long").alias("extra"))


def passes(planned: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """The plan's rows, one for each pass that takes them, with pass (from 0; the one in part is the last), block_key and row_key: within a source, the
    order by these three is the permutation of every pass, whole or in part."""
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    own = planned.where("epochs + extra > 0").withColumn("pass", F.explode(F.expr("sequence(0L, epochs + extra - 1L)")))
    own = own.withColumn("block_key", _key(F.col("pass"), name, F.col("block")))
    return own.withColumn("row_key", _key(F.col("pass"), F.col(id_col).cast("string"), F.md5(text)))


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", **limits) -> DataFrame:
    """The rows and columns of docs, each as many times as the plan takes it, in no order: that of the passes is `passes`'. With no total, every row is there at least once."""
    planned = plan(docs.select(F.struct(*docs.columns).alias("_own"), F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.col(source).alias("_source")), "_text", "_id", "_source", **limits)
    return planned.select("_own", F.explode(F.array_repeat(F.lit(1), (F.col("epochs") + F.col("extra")).cast("int")))).select("_own.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens, block, epochs, extra: how often every row is taken, at most twice as often in one source as in another."""
    return plan(table(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("text")


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS name, coalesce(doc_id::VARCHAR, '') AS i, coalesce(md5(text), '') AS h,
         greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+')))::BIGINT AS tokens FROM documents),
p AS (SELECT name, sum(tokens)::BIGINT AS n, sum(tokens)::DOUBLE / (SELECT sum(tokens) FROM d)::DOUBLE AS p FROM d GROUP BY name),
bisect(lo, hi) AS (
  SELECT 0, {GRID}
  UNION ALL
  SELECT CASE WHEN ok THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN ok THEN (lo + hi) // 2 ELSE hi END
  FROM (SELECT lo, hi, (SELECT max(pow(p, ((lo + hi) // 2)::DOUBLE / {GRID}) / p) <= {REPETITION} * min(pow(p, ((lo + hi) // 2)::DOUBLE / {GRID}) / p) FROM p) AS ok
        FROM bisect WHERE lo < hi)),
a AS (SELECT lo::DOUBLE / {GRID} AS a FROM bisect WHERE lo = hi),
w AS (SELECT name, n, pow(p, a) AS w FROM p, a),
t AS (SELECT max(floor(n * (SELECT sum(w) FROM w) / w)) AS total, (SELECT sum(w) FROM w) AS norm FROM w),
s AS (SELECT name, n, greatest(n, floor(total * w / norm)::BIGINT) AS budget, greatest(1, -((-n) // {BLOCK_TOKENS})) AS blocks FROM w, t),
r AS (SELECT doc_id, source, name, i, h, tokens, budget // n AS epochs, budget % n AS rest,
             ('0x' || substr(md5('{SEED}:' || i || ':' || h), 1, 15))::BIGINT % CASE WHEN n % {BLOCK_TOKENS} = 0 THEN n // {BLOCK_TOKENS} ELSE n // {BLOCK_TOKENS} + 1 END AS block
      FROM d JOIN s USING (name)),
k AS (SELECT *, md5('{SEED}:' || epochs || ':' || name || ':' || block) AS bk, md5('{SEED}:' || epochs || ':' || i || ':' || h) AS rk FROM r),
b AS (SELECT name, bk, sum(t) OVER (PARTITION BY name ORDER BY bk) - t AS before FROM (SELECT name, bk, sum(tokens) AS t FROM k GROUP BY name, bk)),
e AS (SELECT k.*, before + sum(tokens) OVER (PARTITION BY name, bk ORDER BY rk) - tokens AS so_far FROM k JOIN b USING (name, bk))
SELECT doc_id, source, tokens, block, epochs, CASE WHEN so_far < rest THEN 1 ELSE 0 END::BIGINT AS extra FROM e
"""
