"""String functions of the extraction pipeline, as Columns. Only HTML unescaping needs Python, in Arrow batches."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def html_unescape(text: Column) -> Column:
    return F.pandas_udf(_unescape, StringType())(text)


def without_fence(text: Column) -> Column:
    """A text in a code fence without its first line, and without its last if that is exactly three backticks."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    inside = F.regexp_replace(F.regexp_replace(trimmed, r"^```[^\n]*\n?", ""), r"(^|\n)```$", "")
    return F.when(F.startswith(trimmed, F.lit("```")), inside).otherwise(trimmed)


def clean_text(text: Column) -> Column:
    """Without a fence, white space collapsed, then HTML entities undone. Rows without `&` don't leave the JVM's result unchanged."""
    return html_unescape(F.trim(F.regexp_replace(without_fence(text), r"\s+", " ")))


def tag_texts(text: Column, tag: str) -> Column:
    """The contents of all `<tag>...</tag>`, shortest matches, over line ends."""
    return F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def pairs(text: Column, first: str = "exec_flow", second: str = "log_seq") -> Column:
    """array<struct<exec_flow, log>> of the two tags' contents, as many as the shorter list has."""
    a, b = tag_texts(text, first), tag_texts(text, second)
    return F.transform(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.struct(F.get(a, i - 1).alias("exec_flow"), F.get(b, i - 1).alias("log")))


def tag_pairs(text: Column, first: str = "exec_flow", second: str = "log_seq") -> Column:
    """As `pairs`; an empty array where a tag is missing."""
    none = (F.size(tag_texts(text, first)) == 0) | (F.size(tag_texts(text, second)) == 0)
    return F.when(none, F.array().cast("array<struct<exec_flow:string,log:string>>")).otherwise(pairs(text, first, second))


def block(text: Column, tag: str = "enhanced_paths") -> Column:
    """The first block of a tag with its tags, or the text itself."""
    found = F.regexp_extract(text, f"(?s)<{tag}>.*?</{tag}>", 0)
    return F.when(found == "", text).otherwise(found)


def hash8(text: Column) -> Column:
    """The first 8 hex digits of the SHA-256."""
    return F.left(F.sha2(text, 256), F.lit(8))


def strip_prefix(callee: Column) -> Column:
    """Without a leading `(TYPE)`."""
    return F.regexp_replace(callee, r"^\([^)]+\)", "")


def safe_int(text: Column) -> Column:
    """An int, or null if the text isn't one."""
    return F.trim(text).try_cast("int")


def strip_code(text: Column) -> Column:
    """Without line comments, then block comments, then string literals."""
    for pattern in (r"//[^\n]*", r"(?s)/\*.*?\*/", r'"(?:\\.|[^"\\])*"'):
        text = F.regexp_replace(text, pattern, "")
    return text


def is_method(text: Column) -> Column:
    """Whether code without comments and strings has an argument list and a body."""
    return strip_code(text).rlike(r"(?s)\(.*?\).*?\{")


#: Fixed value: the class that a method's text is put in to be parsed.
WRAPPER = "package tmp;\nimport java.util.*;\npublic class Tmp {\n%s\n}\n"


def wrap_method(text: Column) -> Column:
    return F.format_string(WRAPPER, text)


def encode_lines(text: Column) -> Column:
    """Line ends as control characters that tables don't use."""
    return F.translate(text, "\r\n", "\u0001\u0002")


def decode_lines(text: Column) -> Column:
    return F.translate(text, "\u0001\u0002", "\r\n")


def jar_entry(path: Column) -> Column:
    """Name inside an archive: what follows the last `!/`, else the base name."""
    return F.when(F.contains(path, F.lit("!/")), F.substring_index(path, "!/", -1)).otherwise(F.substring_index(path, "/", -1))


def numbered_dir(name: Column, n: Column) -> Column:
    return F.format_string("%04d%%%s", n, name)


def dir_number(name: Column) -> Column:
    return F.regexp_extract(name, r"^(\d{4})%", 1).try_cast("int")


def mask_fields(text: Column) -> Column:
    """Addresses (with a port or not), hex numbers and numbers in braces as `<*>`."""
    text = F.regexp_replace(text, r"(/|)(\d+\.){3}\d+(:\d+)?", "<*>")
    return F.regexp_replace(text, r"\{[^{}]*\}", "<*>")


def key_values(text: Column) -> Column:
    """map of `k="v"` pairs, escaped characters undone; of a repeated key the last value."""
    keys = F.regexp_extract_all(text, F.lit(r'(\w+)="((?:[^"\\]|\\.)*)"'), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r'(\w+)="((?:[^"\\]|\\.)*)"'), F.lit(2))
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], F.regexp_replace(e["v"], r"\\(.)", "$1"))))


def record_type(text: Column) -> Column:
    return F.substring_index(text, " ", 1)


def to_millis(text: Column, pattern: str = "MM/dd/yyyy HH:mm:ss") -> Column:
    return F.unix_millis(F.to_timestamp(text, pattern))


def escape_join(values: Column, delimiter: str = "!", escape: str = "*") -> Column:
    """The values joined, with the escape before every escape and delimiter in them."""
    esc = lambda v: F.replace(F.replace(v, F.lit(escape), F.lit(escape * 2)), F.lit(delimiter), F.lit(escape + delimiter))
    return F.array_join(F.transform(values, esc), delimiter)


def escape_split(text: Column, delimiter: str = "!", escape: str = "*") -> Column:
    """The values that `escape_join` joined: a scan from left to right, as an escape may itself be escaped."""
    one = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("part"), F.lit(False).alias("esc"))

    def step(s, c):
        add = F.struct(s["done"].alias("done"), F.concat(s["part"], c).alias("part"), F.lit(False).alias("esc"))
        opened = F.struct(s["done"].alias("done"), s["part"].alias("part"), F.lit(True).alias("esc"))
        closed = F.struct(F.concat(s["done"], F.array(s["part"])).alias("done"), F.lit("").alias("part"), F.lit(False).alias("esc"))
        return F.when(s["esc"], add).when(c == escape, opened).when(c == delimiter, closed).otherwise(add)

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, one, step, lambda s: F.concat(s["done"], F.array(s["part"])))


def encode_qualifier(text: Column) -> Column:
    """Space and tab escaped for a column name."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%0$")), F.lit(" "), F.lit("%1$")), F.lit("\t"), F.lit("%2$"))


def to_json_bytes(value: Column) -> Column:
    """JSON in UTF-8; null is empty."""
    return F.coalesce(F.encode(F.to_json(value), "utf-8"), F.lit(b""))
