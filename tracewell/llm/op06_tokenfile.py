"""Operator 6: token ids in a word-aligned binary format (Simple-8b), written in document order and read back.

A block holds whole documents, about `BLOCK_IDS` ids. Its words are 64 bits: the lowest 4 are a selector, the other 60
hold as many ids as the selector says, each in its width; ids too wide for the packed selectors take the escape, one id in a word.
Every `STRIDE` words the block's header has an offset: the number of ids before that word, so that parts of a block
decode by themselves. Blocks are rows of a Parquet table (shard, block, start, n_ids, payload), which any store that
Spark writes can hold, and whose commit protocol makes a retried task's rows count once; a shard is a range of doc_id.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

MAGIC = 0x38534D54
BLOCK_IDS, STRIDE, KEPT_WORDS = 65_536, 1024, 600_000
#: Fixed value: the pre-tokenizer's pattern that `separable` knows; and the same for lower-case Latin-1, whose characters
#: lower-casing changes one by one and composition leaves as they are.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_L, _N, _S = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
LATIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
LETTERS = re.compile(f"[{_L}]+")
#: Fixed values of the format: ids in a word and bits of each, by selector; the last is the escape.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]


def pack(ids: np.ndarray) -> bytes:
    """The words of the ids (unsigned, under 2^60), with a header: magic, ids, words, then an offset for every STRIDE words."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if n and int(ids.max()) >= 1 << 60:
        raise ValueError("an id has over 60 bits")
    width = np.zeros(n, np.uint8)
    for _, bits in SELECTORS[:-1]:
        width += ids >= np.uint64(1 << bits)
    choice = np.full(n, len(SELECTORS) - 1, np.uint8)
    widest, done = {1: width}, 1  # the widest id among the next 1, 2, 4 ... ids
    while 2 * done <= min(n, SELECTORS[0][0]):
        widest[2 * done] = np.maximum(widest[done][: n - 2 * done + 1], widest[done][done:])
        done *= 2
    for s in range(len(SELECTORS) - 2, -1, -1):  # widest ids first: the most ids that fit win
        count = SELECTORS[s][0]
        if count <= n:
            w = widest[1 << (count.bit_length() - 1)]
            fits = np.maximum(w[: n - count + 1], w[count - (1 << (count.bit_length() - 1)) :][: n - count + 1]) <= s
            if not fits.any():
                break  # a narrower width for more ids can't fit either
            choice[: n - count + 1][fits] = s
    step = np.array([c for c, _ in SELECTORS], np.int64)[choice].tolist()
    at, starts = 0, []
    add = starts.append
    while at < n:
        add(at)
        at += step[at]
    start = np.array(starts, np.int64)
    chosen = choice[start] if n else choice
    words = chosen.astype(np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        rows = np.flatnonzero(chosen == s)
        for j in range(count if len(rows) else 0):
            words[rows] |= ids[start[rows] + j] << np.uint64(4 + bits * j)
    offsets = start[::STRIDE].astype("<u8")
    return np.array([MAGIC, n, len(words)], "<u8").tobytes() + offsets.tobytes() + words.astype("<u8").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a block, all words of one selector at a time."""
    magic, n, n_words = np.frombuffer(payload, "<u8", 3).tolist()
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    n_offsets = -(-n_words // STRIDE)
    words = np.frombuffer(payload, "<u8", n_words, 24 + 8 * n_offsets)
    offsets = np.frombuffer(payload, "<u8", n_offsets, 24).astype(np.int64)
    return unpack_words(words, n, offsets)


def unpack_words(words: np.ndarray, n: int, offsets: np.ndarray | None = None) -> np.ndarray:
    """The n ids of the words; offsets, if given, are checked against the words."""
    chosen = (words & np.uint64(15)).astype(np.intp)
    counts = np.array([c for c, _ in SELECTORS], np.int64)[chosen]
    start = np.cumsum(counts) - counts
    if offsets is not None and not np.array_equal(start[::STRIDE], offsets):
        raise ValueError("the offsets don't fit the words")
    out = np.zeros(n, np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        rows = np.flatnonzero(chosen == s)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count if len(rows) else 0):
            out[start[rows] + j] = (words[rows] >> np.uint64(4 + bits * j)) & mask
    return out


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def separable(spec: dict) -> bool:
    """Whether a text's ids are those of its parts between spaces and line ends, one after the other: the pre-tokenizer keeps
    no white space, no added token strips it, and the normalizer works within each part."""
    kinds = (spec.get("normalizer") or {}).get("normalizers", [])
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        all(k["type"] in ("NFC", "Lowercase") or k["type"] == "Replace" and k["pattern"] == {"Regex": "\\s+"} and k["content"] == " " for k in kinds)
        and split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and bool(split.get("invert"))
        and split.get("pattern", {}).get("Regex") == SPLIT
        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
        and spec.get("post_processor") is None
        and spec["model"].get("dropout") is None
    )


class Parts(dict):
    """Ids (as bytes) by part. A part that is in neither generation is an empty bytearray, listed in `new`, until it is encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.new: dict[str, bytearray] = {}

    def __missing__(self, part: str) -> bytes | bytearray:
        ids = self.older.get(part)
        if ids is None:
            ids = self.new[part] = bytearray()
        self[part] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(spec_json: str) -> Callable[[list[str | None]], list[np.ndarray]]:
    """A function from texts to their ids by the tokenizers library, without special tokens added; a worker keeps it between tasks.

    Where the tokenizer is separable, each distinct part is encoded once and kept, in two generations of KEPT_WORDS at most.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    spec, tokenizer = json.loads(spec_json), Tokenizer.from_str(spec_json)
    batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    if not separable(spec):
        return lambda texts: [np.array(e.ids, "<u4") for e in batch([t or "" for t in texts], add_special_tokens=False)]

    lower = any(k["type"] == "Lowercase" for k in spec["normalizer"]["normalizers"])
    marks = [(t["content"], t["id"]) for t in spec["added_tokens"]]
    suffix, cut = spec["model"].get("end_of_word_suffix"), spec["pre_tokenizer"]["pretokenizers"]
    bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *cut[1:]]}}))
    ends = np.zeros(tokenizer.get_vocab_size() + len(marks), bool)
    ends[[i for word, i in spec["model"]["vocab"].items() if suffix and word.endswith(suffix)]] = True
    find, single_word = LATIN.findall, LETTERS.fullmatch
    known = Parts()
    look = known.__getitem__

    def encode_parts(parts: list[str]) -> None:
        """Parts joined by an added token are encoded at once and its id parts them again; one by one where a part holds it itself."""
        if marks:
            mark, mark_id = marks[0]
            ids = np.array(batch([mark.join(parts)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == mark_id)
            if len(cuts) == len(parts) - 1:
                raw, cuts = ids.tobytes(), (4 * cuts).tolist()
                known.update(zip(parts, [raw[a:z] for a, z in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)])]))
                return
        known.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(parts, batch(parts, add_special_tokens=False)))

    def encode_plain(words: list[str]) -> None:
        """Runs of lower-case Latin-1 letters, which the normalizer leaves as they are and the pre-tokenizer leaves whole: the
        same model without both; the ids that end a word part them."""
        ids = np.array(bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = 4 * (np.flatnonzero(ends[ids]) + 1)
        if len(cuts) != len(words):
            return encode_parts(words)
        raw, cuts = ids.tobytes(), cuts.tolist()
        known.update(zip(words, [raw[a:z] for a, z in zip([0, *cuts], cuts)]))

    def parts_of(text: str) -> list[str]:
        if suffix and lower and "<|" not in text and _latin(text):
            return find(text.lower())
        return text.replace("\n", " ").split(" ")

    def encode(texts: list[str | None]) -> list[np.ndarray]:
        found = [list(map(look, parts_of(t or ""))) for t in texts]
        new, known.new = known.new, {}
        if single := [p for p in new if single_word(p)]:
            encode_plain(single)
        if rest := [p for p in new if not single_word(p)]:
            encode_parts(rest)
        for part, ids in new.items():
            ids += known[part]
        if len(known) > KEPT_WORDS:
            known.older = dict(known)
            known.clear()
        return [np.frombuffer(b"".join(f), "<u4") for f in found]

    return encode


def write_blocks(docs: DataFrame, tokenizer_json: str, end_id: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(shard, block, start, n_ids, doc_ids, n_tokens, payload): blocks of whole documents in ascending order of id_col.

    start counts the shard's ids before the block. Every document ends with end_id; null and empty texts have that id only;
    null ids come first; rows with the same id follow the hash of their text, then the text. An empty table gives no blocks.
    A document over BLOCK_IDS ids is a block of its own.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, shard = encoder(spec.value), TaskContext.get().partitionId()
        block = start = held = 0
        doc_ids: list[str | None] = []
        parts: list[np.ndarray] = []
        end = np.array([end_id], "<u4")

        def closed() -> pd.DataFrame:
            return pd.DataFrame({"shard": [shard], "block": [block], "start": [start], "n_ids": [held], "doc_ids": [doc_ids], "n_tokens": [[len(p) for p in parts]], "payload": [pack(np.concatenate(parts))]})

        for b in batches:
            ids = b["doc_id"].tolist()
            for at in range(0, len(ids), 256):
                for i, tokens in zip(ids[at : at + 256], encode(b["t"].iloc[at : at + 256].tolist())):
                    doc_ids.append(i)
                    parts.append(np.concatenate((tokens, end)))
                    held += len(tokens) + 1
                    if held >= BLOCK_IDS:
                        yield closed()
                        block, start, held, doc_ids, parts = block + 1, start + held, 0, [], []
        if parts:
            yield closed()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t"))
    ordered = source.repartitionByRange("doc_id", F.xxhash64("t")).sortWithinPartitions("doc_id", F.xxhash64("t"), "t")
    return ordered.select(F.col("doc_id").cast("string"), "t").mapInPandas(each, "shard int, block int, start long, n_ids long, doc_ids array<string>, n_tokens array<long>, payload binary")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the payloads; start counts all ids before it."""
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = F.broadcast(shards.select("shard", before.alias("base")))  # a row for each shard, of which there are as many as partitions

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                ids, n = unpack(row.payload).astype("<u4"), np.asarray(row.n_tokens, np.int64)
                ends = np.cumsum(n)
                starts = ends - n
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(starts.tolist(), ends.tolist())]
                yield pd.DataFrame({"doc_id": pd.array([None if i is None else int(i) for i in row.doc_ids], "Int64"), "start": starts + row.first, "n_tokens": n, "ids_crc32": np.array(crc, np.int64)})

    found = blocks.join(base, "shard").select("doc_ids", "n_tokens", "payload", (F.col("base") + F.col("start")).alias("first"))
    return found.mapInPandas(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    return read_blocks(materialise(write_blocks(table(spark, sf_dir, "documents", "doc_id", "text"), spec, 1), "tokenfile"))
