"""Predicates and columns chosen by settings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = {"and", "or", "not", "is", "null", "in", "between", "like", "rlike", "true", "false", "case", "when", "then", "else", "end"}
FUNCTIONS = {"abs", "lower", "upper", "trim", "length", "coalesce", "round", "year", "month", "hour", "date", "timestamp", "isnan", "greatest", "least"}
_TOKEN = re.compile(r"\s+|'(?:[^'\\]|'')*'|`[^`]+`|[A-Za-z_]\w*|\d+(?:\.\d+)?|<=>|<>|!=|<=|>=|[-+*/%<>=(),]")


def checked(text: str, columns: list[str]) -> Column:
    """A SQL predicate from settings: only the given columns, literals, operators and FUNCTIONS; anything else is an error."""
    if "--" in text:
        raise ValueError(f"{text!r} has a comment")
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"{text!r} has {text[at]!r}")
        word = m.group()
        at = m.end()
        if word[0] == "`" and word[1:-1] not in columns or re.match(r"[A-Za-z_]", word) and word.lower() not in WORDS and word not in columns and not (word.lower() in FUNCTIONS and text[at:].lstrip().startswith("(")):
            raise ValueError(f"{text!r} has {word!r}, which is neither a column nor allowed")
    return F.expr(text)


def where_rules(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """df with a column per rule: TRUE where its predicate holds, FALSE where it doesn't or is NULL."""
    return df.withColumns({name: F.coalesce(checked(text, df.columns), F.lit(False)) for name, text in rules.items()})


def rules_by_group(df: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """(keys..., {rule}_all, {rule}_any): whether a rule holds for all, or any, rows of a group; NULLs don't hold."""
    rows = where_rules(df, {f"_{n}": t for n, t in rules.items()})
    return rows.groupBy(*keys).agg(*[f(f"_{n}").alias(f"{n}_{word}") for n in rules for word, f in (("all", F.bool_and), ("any", F.bool_or))])


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Names of the columns in which the pattern is found."""
    return [c for c in df.columns if re.search(pattern, c)]


def across(df: DataFrame, columns: list[str], how: str, skip_null: bool) -> Column:
    """Row-wise 'sum' or 'mean' over columns; a NULL makes it NULL unless skipped, all NULL always do."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    known = F.array_compact(values)
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    got = total if how == "sum" else F.try_divide(total, F.size(known))
    return F.when(F.size(known) > 0 if skip_null else F.size(known) == len(columns), got)
