"""Log template mining by Drain's fixed-depth tree (He et al., ICWS 2017), in groups that can never share a template.

Lines of different numbers of tokens never meet in the tree, nor lines that differ in the first `depth - 2` tokens (digits masked). So
the group is (token count, those tokens); groups are mined in parallel, and in each one lines come in the order of their number. Equal masked
lines are counted before they're sent, so a very frequent line is one row.

A large group is cut into runs of lines that are mined in parallel as well, each from the templates that the runs before it are thought to leave;
a run counts once those are known to be right. So a worker holds a batch of lines, and the templates, which the driver has too.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import _cut
from .text import mask_fields

ANY = "<*>"
#: Bytes of a group's lines, with 64 more for each, over which it's cut into runs of about as many.
LARGE = 32 << 20
#: Tokens of lines times templates that are compared at once.
CELLS = 1 << 22
#: Times as many runs of a group are mined in the next round if all were right.
WIDER = 8


def header_regex(pattern: str) -> tuple[str, list[str]]:
    """A header pattern like `<Date> <Time> - <Content>` as a regular expression and its field names; runs of blanks match any run."""
    names = re.findall(r"<(\w+)>", pattern)
    parts = re.split(r"<\w+>", pattern)
    out = "^"
    for i, part in enumerate(parts):
        out += "".join(r"\s+" if x.isspace() else re.escape(x[-1]) for x in re.findall(r"\s+|\\.|.", part))
        if i < len(names):
            out += "(.*?)"
    return out + "$", names


def read_header(df: DataFrame, line: str, pattern: str) -> DataFrame:
    """The fields of a header pattern as columns; lines that don't fit are dropped."""
    regex, names = header_regex(pattern)
    return df.where(F.col(line).rlike(regex)).select(*[c for c in df.columns if c != line], *[F.regexp_extract(line, regex, i).alias(n) for i, n in enumerate(names, 1)])


class Templates:
    """The templates of one group, in the order in which they came, and how many lines each has taken."""

    def __init__(self, similarity: float, start: tuple[str, ...] = ()):
        self.similarity = similarity
        self.names = list(start)
        self.counts = [0] * len(start)

    def add(self, texts: pa.Array, n: np.ndarray) -> list[str]:
        """Takes lines in (all of one number of tokens, in order; n: how many each stands for) and gives those that made a template or took tokens from
        one. A line goes to the first of the templates that are most similar, and of these have the most places open; all lines up to the next
        one that alters a template are compared at once."""
        coded = pc.split_pattern(texts, " ").flatten().dictionary_encode()
        lines = coded.indices.to_numpy(zero_copy_only=False).reshape(len(texts), -1)
        length = lines.shape[1]
        place = lambda tokens: pc.fill_null(pc.index_in(pa.array(tokens, coded.dictionary.type), value_set=coded.dictionary), -2).to_numpy(zero_copy_only=False)
        tokens = [t for name in self.names for t in name.split(" ")]
        any_ = max(-1, int(place([ANY])[0]))
        known = np.where(np.array(tokens, object) == ANY, any_, place(tokens)).astype(np.int32).reshape(-1, length)
        open_ = (known == any_).sum(1)
        counts = np.array(self.counts, np.int64)
        altered, at, width = [], 0, 1
        while at < len(lines):
            block = lines[at : at + min(width, max(1, CELLS // max(1, known.size)))]
            best, near, steady = np.zeros(len(block), np.int64), np.zeros(len(block), bool), np.zeros(len(block), bool)
            if len(known):
                same = (known[:, None] == block).sum(2)
                best = (same * (length + 1) + open_[:, None]).argmax(0)
                near = same[best, np.arange(len(block))] / length >= self.similarity
                steady = near & ((known[best] == block) | (known[best] == any_)).all(1)
            k = len(block) if steady.all() else int(steady.argmin())
            np.add.at(counts, best[:k], n[at : at + k])
            at, width = at + k, width * 2
            if k == len(block):
                continue
            text, i = texts[at].as_py(), int(best[k])
            if near[k]:
                known[i] = np.where(known[i] == block[k], known[i], any_)
                self.names[i] = " ".join(a if a == b else ANY for a, b in zip(self.names[i].split(" "), text.split(" ")))
                open_[i] = (known[i] == any_).sum()
            else:
                i = len(known)
                known, counts, open_ = np.vstack([known, block[k : k + 1]]), np.append(counts, 0), np.append(open_, (block[k] == any_).sum())
                self.names.append(text)
            counts[i] += n[at]
            altered.append(text)
            at, width = at + 1, 1
        self.counts = counts.tolist()
        return altered


def _after(similarity: float, start: tuple[str, ...], altered: list[str]) -> tuple[str, ...]:
    """The templates that lines leave which alter those of start; all other lines leave them as they are."""
    if not altered:
        return start
    found = Templates(similarity, start)
    found.add(pa.array(altered, pa.string()), np.ones(len(altered), np.int64))
    return tuple(found.names)


def _mine_runs(runs: DataFrame, starts: dict[tuple, tuple[str, ...]], similarity: float) -> dict[tuple, tuple[list[str], list[int]]]:
    """For each (run, length, lead) of starts, mined from those templates, the lines that altered one, and the counts of all templates. A
    partition of runs is one run, in order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found, altered = None, None, []
        row = lambda: pa.RecordBatch.from_pylist([dict(zip(names, (*key, altered, found.counts)))], schema)
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in names[:3])))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a or keys[a] not in starts:
                    continue
                if keys[a] != key:
                    if key is not None:
                        yield row()
                    key, found, altered = keys[a], Templates(similarity, starts[keys[a]]), []
                altered += found.add(batch["text"].slice(a, b - a), batch["n"].slice(a, b - a).to_numpy(zero_copy_only=False))
        if key is not None:
            yield row()

    names = ["run", "length", "lead", "altered", "counts"]
    schema = pa.schema(list(zip(names, (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())))))
    now = runs.where(F.col("run").isin(sorted({k[0] for k in starts})))
    found = now.mapInArrow(each, "run int, length int, lead string, altered array<string>, counts array<bigint>").collect()
    return {(r.run, r.length, r.lead): (list(r.altered), list(r.counts)) for r in found}


def _mine_large(grouped: DataFrame, weight: int, similarity: float) -> list[tuple[str, int]]:
    """(template, occurrences) of large groups, as if each one's lines were mined one after the other.

    Runs of a group are mined from the templates that the lines known so far to alter one leave before them. The first of them that isn't settled
    has the right ones, and settles; so does each next one that had those which are left by then. Others are mined again. The more of them settle,
    the more are tried in the next round.
    """
    order = ["length", "lead", F.col("o").asc_nulls_last(), "text"]
    runs = grouped.repartitionByRange(-(-weight // LARGE), *order).sortWithinPartitions(*order)
    runs = _cut(runs.select(F.spark_partition_id().alias("run"), "length", "lead", "text", "n"))
    todo = defaultdict(list)
    for r in sorted(runs.select("run", "length", "lead").distinct().collect()):
        todo[r.length, r.lead].append((r.run, r.length, r.lead))
    state, counts, width = {g: () for g in todo}, {g: [] for g in todo}, dict.fromkeys(todo, 1)
    mined: dict[tuple, tuple] = {}
    while any(todo.values()):
        starts = {}
        for g, left in todo.items():
            start = state[g]
            for run in left[: width[g]]:
                if run not in mined or mined[run][0] != start:
                    starts[run] = start
                if run in mined:
                    start = _after(similarity, start, mined[run][1])
        mined |= {run: (starts[run], *found) for run, found in _mine_runs(runs, starts, similarity).items()}
        for g, left in todo.items():
            tried = left[: width[g]]
            while left and left[0] in mined and mined[left[0]][0] == state[g]:
                _, altered, more = mined.pop(left.pop(0))
                state[g] = _after(similarity, state[g], altered)
                counts[g] = [a + b for a, b in zip(counts[g] + [0] * (len(more) - len(counts[g])), more + [0] * (len(counts[g]) - len(more)))]
            settled = sum(run not in left for run in tried)
            width[g] = width[g] * WIDER if settled == len(tried) else max(1, settled)
    return [(name, n) for g in state for name, n in zip(state[g], counts[g])]


def templates(df: DataFrame, line: str, order: str, similarity: float = 0.5, depth: int = 4) -> DataFrame:
    """(event_id, template, occurrences): the templates of the lines' contents; event_id is the first 8 hex digits of the template's MD5."""
    masked = F.filter(F.split(F.trim(mask_fields(F.col(line))), r"\s+"), lambda t: t != "")
    tokens = F.split("text", " ")
    lead = F.transform(F.slice(tokens, 1, max(0, depth - 2)), lambda t: F.when(t.rlike(r"\d"), ANY).otherwise(t))
    group = lambda rows: rows.withColumn("length", F.size(tokens)).withColumn("lead", F.array_join(lead, " "))
    texts = df.select(F.array_join(masked, " ").alias("text"), F.col(order).alias("o"))
    grouped = group(texts.groupBy("text").agg(F.min("o").alias("o"), F.count("*").alias("n")))

    def each(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["o", "text"])
        found = Templates(similarity)
        found.add(pa.array(group["text"], pa.string()), group["n"].to_numpy())
        return pd.DataFrame({"template": found.names, "n": found.counts})

    # repeated lines count here, so a group that isn't large by these weights isn't without them either
    weights = group(texts).groupBy("length", "lead").agg(F.sum(F.octet_length("text") + 64).alias("weight"))
    weights = weights.select("weight", F.when(F.col("weight") > LARGE, F.struct("length", "lead")).alias("large")).groupBy("large").agg(F.sum("weight").alias("weight")).collect()
    large = [r for r in weights if r.large is not None]
    mined = []
    if large:
        keys = pa.table({"length": pa.array([r.large.length for r in large], pa.int32()), "lead": pa.array([r.large.lead for r in large], pa.string())})
        keys = F.broadcast(df.sparkSession.createDataFrame(keys))
        found = _mine_large(grouped.join(keys, ["length", "lead"], "left_semi"), sum(r.weight for r in large), similarity)
        mined.append(df.sparkSession.createDataFrame(pa.table({"template": pa.array([t for t, _ in found], pa.string()), "n": pa.array([n for _, n in found], pa.int64())})))
        grouped = grouped.join(keys, ["length", "lead"], "left_anti")
    if len(large) < len(weights) or not large:
        mined.append(grouped.groupBy("length", "lead").applyInPandas(each, "template string, n long"))
    found = mined[0] if len(mined) == 1 else mined[0].unionByName(mined[1])
    return found.groupBy("template").agg(F.sum("n").alias("occurrences")).select(F.left(F.md5("template"), F.lit(8)).alias("event_id"), "template", "occurrences")


def structured(df: DataFrame, line: str, order: str, pattern: str, similarity: float = 0.5, depth: int = 4) -> DataFrame:
    """Header pattern, then templates of the Content field."""
    return templates(read_header(df, line, pattern), "Content", order, similarity, depth)
