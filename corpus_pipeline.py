"""The corpus pipeline: language ID, line dedup, near-duplicate documents, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import common, op02_langid, op04_mixing, op07_bpe, op08_lines, op09_simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars is that of the text as it is now."""
    return df.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects: null or empty texts, those without letters, or too far from every language. Without any
    language to learn from, all go; repeated rows are judged alike; an empty table gives an empty result; only the columns of documents are read."""
    found = op02_langid.identify(docs.select(*COLUMNS), op02_langid.fit(docs))
    return found.where(~F.col("rejected")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out; a document all of whose lines were repeats goes, for its text is elsewhere. Null, empty and blank texts stay as
    they are; rows that repeat an id and its text are one document; texts and lines of any length take part; an empty table gives an empty result."""
    kept = op08_lines.dedup_lines(docs.select(*COLUMNS))
    return _columns(kept.where((F.col("n_removed") == 0) | (F.trim(F.col("text")) != "")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id: links are all pairs whose five-word shingles have
    a Jaccard similarity of 0.8 or more. Texts without words are one group; rows with a null id stay where nothing else is in their group; of rows
    that repeat an id and its text, one stays; an empty table gives an empty result."""
    return op09_simhash.first_of_each(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, so that no source is seen over twice as often as another; none is left out.
    A null source is a source of its own, a text without words counts as one token, and an empty table gives an empty result."""
    return op04_mixing.mix(docs.select(*COLUMNS))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids: every whole text in token ids, checked by decoding them; ids that don't give the text back are an error.
    Null and empty texts have no ids; an empty table gives an empty result."""
    import public_tokenizers

    ranks = op07_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = op07_bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=("doc_id", "source", "text"))
    back = op07_bpe.decode("ids", ranks).eqNullSafe(F.coalesce("text", F.lit("")).cast("binary"))
    ids = F.when(back, F.col("ids")).otherwise(F.raise_error(F.concat(F.lit("ids don't decode to the text of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: Fuzzy links, fingerprints and BPE are beyond SQL; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each one's result written to the shared folder and read again. What a stage has read is deleted
    when its result is written."""
    docs, before = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        made: list[str] = []
        with common.scratch(spark):
            docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", made)
        common.discard(spark, before)
        before = made
    return docs
