"""Predicate languages turned into Columns: ignore rules, timeline filters, globs, query by example."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RuleError(ValueError):
    """A rule that cannot be read."""


# --- ignore rules -------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\s*(?:(?P<number>-?\d+)|(?P<text>'[^']*'|\"[^\"]*\")|(?P<name>[A-Za-z_][\w.]*)|(?P<op>&&|\|\||==|!=|<=|>=|[<>!(),]))")
_COMPARE = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
}
_STRING = {
    "string.startsWith": lambda a, b: F.startswith(a, b),
    "string.endsWith": lambda a, b: F.endswith(a, b),
    "string.contains": lambda a, b: F.contains(a, b),
    "containsAny": lambda a, b: F.contains(a, b),
    "startsWithAny": lambda a, b: F.startswith(a, b),
    "endsWithAny": lambda a, b: F.endswith(a, b),
    "equalsAny": lambda a, b: a == b,
}


def rule_column(rule: str, variables: Mapping[str, Column]) -> Column:
    """The boolean Column of a rule over the allowed variables; an unknown name, a bad form or a missing operand is a RuleError.

    Grammar: or := and ('||' and)*; and := not ('&&' not)*; not := '!' not | comparison; string functions take a value and
    a constant, the `...Any` functions a value and at least two arguments in all.
    """
    tokens, at = [], 0
    text = rule.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise RuleError(f"cannot read {text[at:]!r}")
        tokens.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    pos = 0

    def peek() -> str | None:
        return tokens[pos][1] if pos < len(tokens) else None

    def take(expected: str | None = None) -> tuple[str, str]:
        nonlocal pos
        if pos == len(tokens) or expected is not None and tokens[pos][1] != expected:
            raise RuleError(f"expected {expected or 'a value'} at item {pos} of {rule!r}")
        pos += 1
        return tokens[pos - 1]

    def either() -> Column:
        out = both()
        while peek() == "||":
            take()
            out = out | both()
        return out

    def both() -> Column:
        out = negated()
        while peek() == "&&":
            take()
            out = out & negated()
        return out

    def negated() -> Column:
        if peek() == "!":
            take()
            return ~negated()
        left = value()
        if peek() in _COMPARE:
            return _COMPARE[take()[1]](left, value())
        return left

    def value() -> Column:
        kind, word = take()
        if word == "(":
            out = either()
            take(")")
            return out
        if kind == "number":
            return F.lit(int(word))
        if kind == "text":
            return F.lit(word[1:-1])
        if kind != "name":
            raise RuleError(f"unexpected {word!r} in {rule!r}")
        if peek() == "(":
            return called(word)
        if word in ("true", "false"):
            return F.lit(word == "true")
        if word not in variables:
            raise RuleError(f"unknown variable {word!r}")
        return variables[word]

    def called(name: str) -> Column:
        take("(")
        args = [either()]
        while peek() == ",":
            take()
            args.append(either())
        take(")")
        if name == "string.length" and len(args) == 1:
            return F.length(args[0])
        if name in _STRING:
            many = name.endswith("Any")
            if len(args) < 2 or not many and len(args) != 2:
                raise RuleError(f"{name} has {len(args)} arguments")
            return reduce(lambda a, b: a | b, [_STRING[name](args[0], a) for a in args[1:]])
        raise RuleError(f"unknown function {name!r}")

    out = either()
    if pos != len(tokens):
        raise RuleError(f"unread {peek()!r} in {rule!r}")
    return out


def ignore(df: DataFrame, rule: str | None, variables: Mapping[str, Column]) -> DataFrame:
    """Drops the rows for which the rule holds. No rule keeps all; a rule that is null for a row keeps the row."""
    return df if not (rule or "").strip() else df.where(~F.coalesce(rule_column(rule, variables), F.lit(False)))


def validate_rule(rule: str, sample: DataFrame, variables: Mapping[str, Column]) -> None:
    """Reads the rule and has Spark analyse it on no rows; raises if either fails or it isn't boolean."""
    schema = sample.limit(0).select(rule_column(rule, variables).alias("x")).schema
    if schema["x"].dataType.simpleString() != "boolean":
        raise RuleError(f"{rule!r} is not a condition")


def method_variables(full: Column, prefix: str = "") -> dict[str, Column]:
    """Rule variables of a full method `a.b.Class:name(args)`: class, package, simple class, method name, argument count, full text."""
    owner, call = F.substring_index(full, ":", 1), F.substring_index(full, ":", -1)
    args = F.regexp_extract(call, r"\((.*)\)", 1)
    return {
        f"{prefix}class_name": owner,
        f"{prefix}package_name": F.when(F.contains(owner, F.lit(".")), F.regexp_replace(owner, r"\.[^.]*$", "")).otherwise(F.lit("")),
        f"{prefix}simple_class_name": F.substring_index(owner, ".", -1),
        f"{prefix}method_name": F.substring_index(call, "(", 1),
        f"{prefix}method_arg_num": F.when(args == "", 0).otherwise(F.size(F.split(args, ","))),
        f"{prefix}full_method": full,
    }


def file_variables(path: Column) -> dict[str, Column]:
    """Rule variables of a file path: path, name, extension with its dot (empty if there is none)."""
    name = F.substring_index(path, "/", -1)
    return {"file_path": path, "file_name": name, "file_ext": F.regexp_extract(name, r"(\.[^.]*)$", 1)}


# --- timeline filters ---------------------------------------------------------------------------------------------


@dataclass
class Compare:
    """A key of a map against a value; with != and key_must_exist false, rows without the key are kept."""

    op: str
    key: str
    value: object
    key_must_exist: bool = True

    def column(self, entries: Column) -> Column:
        found = F.try_element_at(entries, F.lit(self.key))
        absent = F.lit(self.op == "!=" and not self.key_must_exist)
        return F.coalesce(_COMPARE["==" if self.op == "=" else self.op](found, F.lit(self.value)), absent)


@dataclass
class KeyValues:
    """All the values (or, for !=, not all of them) are among those of a key of a map of arrays."""

    op: str
    key: str
    values: tuple[str, ...]

    def column(self, entries: Column) -> Column:
        own = F.coalesce(F.try_element_at(entries, F.lit(self.key)), F.array().cast("array<string>"))
        held = reduce(lambda a, b: a & b, [F.array_contains(own, v) for v in self.values])
        return held if self.op == "=" else ~held


@dataclass
class Exists:
    """An element of an array is there, or for != isn't."""

    op: str
    element: str

    def column(self, elements: Column) -> Column:
        held = F.coalesce(F.array_contains(elements, self.element), F.lit(False))
        return held if self.op == "=" else ~held


@dataclass
class Prefix:
    """Keeps, or with != drops, the entries of a map whose keys begin with the prefix."""

    op: str
    prefix: str

    def entries(self, entries: Column) -> Column:
        return F.map_filter(entries, lambda k, _: F.startswith(k, F.lit(self.prefix)) if self.op == "=" else ~F.startswith(k, F.lit(self.prefix)))


@dataclass
class FilterList:
    """AND (the default) or OR of filters and lists. An empty list keeps all."""

    filters: list = field(default_factory=list)
    op: str = "AND"

    def column(self, over: Column) -> Column:
        parts = [f.column(over) for f in self.filters]
        return reduce((lambda a, b: a & b) if self.op == "AND" else (lambda a, b: a | b), parts) if parts else F.lit(True)


#: Which filters a part of an entity admits.
ADMITTED = {
    "CONFIGS": (FilterList, Compare),
    "INFO": (FilterList, Compare),
    "METRICS": (FilterList, Compare),
    "EVENTS": (FilterList, Exists),
    "RELATIONS": (FilterList, KeyValues),
}


def admit(part: str, wanted) -> None:
    """Raises if the part doesn't admit the filter; configs and info take only equality."""
    if not isinstance(wanted, ADMITTED[part]):
        raise RuleError(f"{part} does not admit {type(wanted).__name__}")
    if isinstance(wanted, FilterList):
        for f in wanted.filters:
            admit(part, f)
    elif part in ("CONFIGS", "INFO") and wanted.op not in ("=", "!="):
        raise RuleError(f"{part} admits = and != only")


_WORDS = {"eq": "=", "ne": "!=", "ene": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def parse_compare(expression: str, numeric: bool = False) -> FilterList:
    """`(a eq 1 AND b ne 2) OR c gt 3`. `ne` keeps rows without the key, `ene` asks for the key. Numeric values must be integral;
    other expressions admit eq, ne and ene only."""
    words = re.findall(r"[()]|[^\s()]+", expression)
    at = 0

    def group(depth: int) -> FilterList:
        nonlocal at
        out = FilterList([], "AND")
        joined = None
        while at < len(words) and words[at] != ")":
            if words[at] == "(":
                at += 1
                out.filters.append(group(depth + 1))
                if at == len(words):
                    raise RuleError("a bracket is not closed")
                at += 1
            else:
                if at + 2 >= len(words) or words[at + 1].lower() not in _WORDS:
                    raise RuleError(f"expected key, operator and value at {' '.join(words[at:])!r}")
                key, word, value = words[at], words[at + 1].lower(), words[at + 2]
                if not numeric and word not in ("eq", "ne", "ene"):
                    raise RuleError(f"{word} needs a numeric filter")
                if numeric and not re.fullmatch(r"-?\d+", value):
                    raise RuleError(f"{value!r} is not integral")
                out.filters.append(Compare(_WORDS[word], key, int(value) if numeric else value, word != "ne"))
                at += 3
            if at < len(words) and words[at].upper() in ("AND", "OR"):
                if joined not in (None, words[at].upper()):
                    out, joined = FilterList([out]), None
                joined = out.op = words[at].upper()
                at += 1
            elif at < len(words) and words[at] != ")":
                raise RuleError(f"expected AND or OR at {' '.join(words[at:])!r}")
        if at == len(words) and depth:
            raise RuleError("a bracket is not closed")
        return out

    out = group(0)
    if at != len(words):
        raise RuleError("a bracket was never opened")
    return out


def _parse_equality(expression: str, delimiter: str, make) -> FilterList:
    """Lists `a,b` or negated `!(a,b)`, with AND, OR and brackets between them."""
    tokens = re.findall(r"!\s*\(|[()]|\bAND\b|\bOR\b|[^()!\s]+", expression)
    at = 0

    def listed(op: str, text: str) -> FilterList:
        return FilterList([make(op, x.strip()) for x in text.split(delimiter) if x.strip()], "AND")

    def group() -> FilterList:
        nonlocal at
        out = FilterList([], "AND")
        while at < len(tokens) and tokens[at] != ")":
            token = tokens[at]
            at += 1
            if token in ("AND", "OR"):
                if len(out.filters) > 1 and out.op != token:
                    out = FilterList([out], token)
                out.op = token
            elif token.startswith("!"):
                text = ""
                while at < len(tokens) and tokens[at] != ")":
                    text += tokens[at]
                    at += 1
                out.filters.append(listed("!=", text))
                at += 1
            elif token == "(":
                out.filters.append(group())
                at += 1
            else:
                out.filters.append(listed("=", token))
        return out

    out = group()
    if at != len(tokens):
        raise RuleError(f"brackets do not match in {expression!r}")
    return out


def parse_exists(expression: str, delimiter: str = ",") -> FilterList:
    """`e1,e2` or `!(e3,e4)`, with AND and OR."""
    return _parse_equality(expression, delimiter, Exists)


def parse_relations(expression: str, delimiter: str = ",", within: str = ":") -> FilterList:
    """`type:id:id,type:id`; an entry without an id is an error."""

    def make(op: str, text: str) -> KeyValues:
        key, *values = [x.strip() for x in text.split(within)]
        if not values:
            raise RuleError(f"no id in {text!r}")
        return KeyValues(op, key, tuple(values))

    return _parse_equality(expression, delimiter, make)


def parse_retrieve(expression: str) -> list[Prefix]:
    """Prefixes `(a,b)` to keep, or `!(a,b)` to drop."""
    m = re.fullmatch(r"\s*(!?)\s*\(([^()]*)\)\s*", expression)
    if not m:
        raise RuleError(f"expected (a,b) or !(a,b): {expression!r}")
    return [Prefix("!=" if m[1] else "=", x.strip()) for x in m[2].split(",") if x.strip()]


def retrieve(entries: Column, prefixes: list[Prefix]) -> Column:
    """The entries of a map that the prefixes let through: any of those to keep, none of those to drop."""
    if not prefixes:
        return entries
    keep = prefixes[0].op == "="

    def held(k, _):
        any_ = reduce(lambda a, b: a | b, [F.startswith(k, F.lit(p.prefix)) for p in prefixes])
        return any_ if keep else ~any_

    return F.map_filter(entries, held)


# --- other predicates ---------------------------------------------------------------------------------------------


def by_example(df: DataFrame, example: Mapping[str, object]) -> DataFrame:
    """Rows that equal the example in all its fields that aren't None."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in example.items() if v is not None], F.lit(True)))


def glob_regex(pattern: str) -> str:
    """A file glob (* ? [a-c] [^a] {a,b}, backslash escapes) as an anchored regular expression."""
    out, at, braces = "", 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            out += re.escape(pattern[at])
        elif c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", at + 2)) > 0:
            out += "[" + pattern[at + 1 : end].replace("\\", "\\\\").replace("!", "^", pattern[at + 1] == "!") + "]"
            at = end
        elif c == "{":
            out, braces = out + "(?:", braces + 1
        elif c == "}" and braces:
            out, braces = out + ")", braces - 1
        elif c == "," and braces:
            out += "|"
        else:
            out += re.escape(c)
        at += 1
    return f"^{out}$"


def name_matches(path: str, pattern: str, ignore_case: bool = False) -> Column:
    """Whether the base name of a path matches a glob."""
    return F.substring_index(path, "/", -1).rlike(("(?i)" if ignore_case else "") + glob_regex(pattern))


def find_and(*results: tuple[Column, Column]) -> tuple[Column, Column]:
    """AND of (passes, descend) pairs: both flags must hold in every part."""
    return reduce(lambda a, b: (a[0] & b[0], a[1] & b[1]), results)


def metric_filter(column: Column, include: list[str] = (), exclude: list[str] = (), globs: bool = True) -> Column:
    """Included or, if nothing is to be included, not excluded; an included name passes even if it's excluded too."""
    some = lambda ps: reduce(lambda a, b: a | b, [column.rlike(glob_regex(p) if globs else f"^(?:{p})$") for p in ps], F.lit(False))
    if include and not exclude:
        return some(include)
    return some(include) | ~some(exclude) if include else ~some(exclude)


def copy_filter(path: str, patterns: list[str] | None) -> Column:
    """Paths to copy: those that none of the patterns matches whole; without patterns, all."""
    return ~reduce(lambda a, b: a | b, [F.col(path).rlike(f"^(?:{p})$") for p in patterns or []], F.lit(False))
