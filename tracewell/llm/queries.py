"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op03_topk, op04_mixing, op05_chat
from .op01_secrets import op1_secrets
from .op02_langid import op2_langid
from .op03_topk import op3_topk
from .op04_mixing import op4_mixing
from .op05_chat import op5_chat
from .op06_tokenfile import op6_tokenfile
from .op07_bpe import op7_bpe
from .op08_lines import op8_lines
from .op09_simhash import op9_simhash
from .op10_ann import op10_ann

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_langid": op2_langid,
    "op3_topk": op3_topk,
    "op4_mixing": op4_mixing,
    "op5_chat": op5_chat,
    "op6_tokenfile": op6_tokenfile,
    "op7_bpe": op7_bpe,
    "op8_lines": op8_lines,
    "op9_simhash": op9_simhash,
    "op10_ann": op10_ann,
}

ORACLE_SQL: dict[str, str] = {
    "op3_topk": op03_topk.ORACLE,
    "op4_mixing": op04_mixing.ORACLE,
    "op5_chat": op05_chat.ORACLE,
}
