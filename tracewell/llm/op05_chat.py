"""Operator 5: chat formatting with loss masks aligned to token offsets.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its assistant turns meet the sorted token
spans by binary search. A turn is `<|turn|>role<|text|>text<|end|>`; the three marks are added tokens, so no token reaches across
them. In roles and texts every `<`, with any backslashes after it and then `|`, gets one backslash more: no mark, and no other
control string that begins like one, can come from inside a text, and taking one backslash away gives the text back.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEARNT = "assistant"
#: Characters that are encoded at once; a longer conversation is encoded by itself.
HELD_CHARS = 1 << 20
CONTROL, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURNS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    return CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the sorted spans of the assistant's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        at += len(head)
        if role == LEARNT and body:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += (head, body, END)
    return "".join(parts), spans


def mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> np.ndarray:
    """uint8, 1 for the tokens that lie in a span: for each span the first token that begins in it and the first after it are
    found by binary search, as both lists are sorted."""
    out = np.zeros(len(offsets), np.uint8)
    starts = [a for a, _ in offsets]
    for a, z in spans:
        out[bisect.bisect_left(starts, a) : bisect.bisect_left(starts, z)] = 1
    return out


@lru_cache(maxsize=2)
def _tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    t = Tokenizer.from_str(spec)
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
    t.no_truncation()
    t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, TEXT, END)])
    return t


def format_chats(rows: DataFrame, tokenizer_json: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted string, ids array<int>, starts array<int>, ends array<int>, loss_mask binary): one row for each conversation.

    The tokenizer is a byte-level one of the tokenizers library; starts and ends are code points of formatted, loss_mask is one byte for
    each token. Turns come by turn, a null first, ties by role, then text; repeated rows are turns of their own. Null roles
    and texts are empty; rows without a conversation are one conversation of their own, null. A conversation goes to one task, which
    holds it alone, however long: rendering it whole asks for that. An empty table gives an empty result; other columns aren't read, so no names clash.
    """
    spec = rows.sparkSession.sparkContext.broadcast(tokenizer_json)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _tokenizer(spec.value).encode_batch
        current, turns, done, held = None, [], [], 0

        def flush(finished: list) -> pd.DataFrame:
            rendered = [render(t) for _, t in finished]
            coded = encode([f for f, _ in rendered], add_special_tokens=False)
            return pd.DataFrame(
                {
                    "conv_id": pd.array([None if c == "" else int(c) for c, _ in finished], "Int64"),
                    "formatted": [f for f, _ in rendered],
                    "ids": [e.ids for e in coded],
                    "starts": [[a for a, _ in e.offsets] for e in coded],
                    "ends": [[z for _, z in e.offsets] for e in coded],
                    "loss_mask": [mask(e.offsets, spans).tobytes() for e, (_, spans) in zip(coded, rendered)],
                }
            )

        for b in batches:
            for c, r, t in zip(b["c"], b["r"], b["t"]):
                if c != current:
                    if turns:
                        done.append((current, turns))
                    current, turns = c, []
                    if len(done) >= 200 or held >= HELD_CHARS:
                        yield flush(done)
                        done, held = [], 0
                turns.append((r, t))
                held += len(t)
        if turns:
            done.append((current, turns))
        if done:
            yield flush(done)

    source = rows.select(F.coalesce(F.col(conv).cast("long").cast("string"), F.lit("")).alias("c"), F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("t"))
    ordered = source.repartition("c").sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t")
    return ordered.mapInPandas(each, "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss_mask binary")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id and the digests of what a formatted conversation holds, read from the text, the offsets and the mask alone."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f, starts, ends, m in zip(b["formatted"], b["starts"], b["ends"], b["loss_mask"]):
                found = [(unescape(r), unescape(t)) for r, t in TURNS.findall(f)]
                on = np.flatnonzero(np.frombuffer(m, np.uint8))
                cuts = np.flatnonzero(np.diff(on) > 1)
                runs = zip(on[np.r_[0, cuts + 1]], on[np.r_[cuts, len(on) - 1]]) if len(on) else ()
                loss = "".join(unescape(f[starts[i] : ends[j]]) for i, j in runs)
                whole = "".join(f"{r}\n{t}\n" for r, t in found)
                out.append((len(found), _sha(whole), len(loss), _sha(loss), len(f)))
            yield pd.concat([b[["conv_id"]].astype("Int64").reset_index(drop=True), pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])], axis=1)

    return formatted.select("conv_id", "formatted", "starts", "ends", "loss_mask").mapInPandas(each, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, LEARNT, said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return read_back(format_chats(rows.unionByName(extra), spec))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
             + length('<|turn|><|text|><|end|>') AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
