"""Joins in time and sensor formulas."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.operators.blocks import carry, in_blocks, inside
from gridlake.runtime import require


def range_join(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Inner join of points strictly inside open-ended ranges of the same key; a NULL end is open."""
    inside = (points[key] == ranges[key]) & (points[at] > ranges[start]) & (ranges[end].isNull() | (points[at] < ranges[end]))
    return points.join(ranges, inside).drop(ranges[key])


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], time: str = "time") -> DataFrame:
    """Add to each left row ``columns`` and ``matched_time`` of the right row nearest in time; of two as near the earlier.

    One sort of both sides per key and block of time: the last right row before and the first after are
    carried along, and from block to block.
    """
    require(left, time, *keys)
    require(right, time, *keys, *columns)
    info = F.struct(F.col(time).alias("t"), *columns)
    kind = right.select(info.alias("x")).schema["x"].dataType
    both = left.select(*keys, F.col(time), F.struct(*left.columns).alias("_row"), F.lit(None).cast(kind).alias("_x")).unionByName(
        right.where(F.col(time).isNotNull()).select(*keys, F.col(time), F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType).alias("_row"), info.alias("_x"))
    )
    # Rows of the same time count on both sides; what comes after is seen from the end, in one pass.
    both = carry(in_blocks(both, keys, time), before={"_b": F.max("_x")}, after={"_a": F.min("_x")})
    upto = lambda back: F.last("_x", True).over(inside(time, back).rangeBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"_b": F.coalesce(upto(False), "_b"), "_a": F.coalesce(upto(True), "_a")})
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    before, after = us(F.col(time)) - us(F.col("_b.t")), us(F.col("_a.t")) - us(F.col(time))
    pick = F.when(after.isNull() | (before <= after), F.col("_b")).otherwise(F.col("_a"))
    return both.withColumn("_pick", pick).where("_row IS NOT NULL").select("_row.*", F.col("_pick.t").alias("matched_time"), *[F.col(f"_pick.{c}").alias(c) for c in columns])


def next_known(df: DataFrame, keys: list[str], column: str, time: str = "time") -> DataFrame:
    """NULLs of ``column`` take the next known value of the series."""
    rows = carry(in_blocks(df, keys, time), after={"_later": F.min_by(column, F.when(F.col(column).isNotNull(), F.col(time)))})
    here = F.last(column, ignorenulls=True).over(inside(time, True).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(column, F.coalesce(here, "_later")).select(*df.columns)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Natural join on ``keys`` in which NULL equals NULL; ``how``: inner, left, right or full. Keys come once, from whichever side has them."""
    require(left, *keys)
    require(right, *keys)
    clash = sorted(set(left.columns) & set(right.columns) - set(keys))
    if clash:
        raise ValueError(f"both sides have {', '.join(clash)}")
    other = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys], F.lit(True).alias("_there"))
    same = [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)]
    # A row without left side has its keys from the right, whether they are NULL or not.
    one = [F.coalesce(k, f"_r{i}").alias(k) for i, k in enumerate(keys)]
    return left.join(other, same, how).select(*one, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys])


def member_of(df: DataFrame, column: str, among: DataFrame, negate: bool = False) -> DataFrame:
    """Rows whose ``column`` is (or isn't) among the only column of ``among``; NULL is among NULLs only, as a set has it."""
    (name,) = among.columns
    return df.join(among.select(F.col(name).alias("_m")).distinct(), F.col(column).eqNullSafe(F.col("_m")), "left_anti" if negate else "left_semi")


def keep_one(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """One whole row per key, NULL keys included: the first in ``order``, or the last. Give an order without ties."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    got = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_row"))
    return got.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str


def parse_formula(text: str) -> list[Token]:
    """Tokens of <mi>sensor</mi><mo>+</mo><mn>2</mn>, in reverse Polish order; * and / bind before + and -."""
    out: list[Token] = []
    ops: list[Token] = []
    level = {"+": 1, "-": 1, "*": 2, "×": 2, "/": 2, "÷": 2}
    for kind, body in re.findall(r"<(mi|mo|mn)>(.*?)</\1>", text):
        t = Token(kind, body.strip())
        if kind != "mo":
            out.append(t)
        elif t.text == "(":
            ops.append(t)
        elif t.text == ")":
            while ops and ops[-1].text != "(":
                out.append(ops.pop())
            if not ops:
                raise ValueError("a bracket isn't opened")
            ops.pop()
        elif t.text in level:
            while ops and ops[-1].text != "(" and level[ops[-1].text] >= level[t.text]:
                out.append(ops.pop())
            ops.append(t)
        else:
            raise ValueError(f"unknown operator {t.text!r}")
    while ops:
        if ops[-1].text == "(":
            raise ValueError("a bracket isn't closed")
        out.append(ops.pop())
    return out


def aggregate_formula(df: DataFrame, formula: str, sensor: str = "sensor_id", time: str = "time", value: str = "value") -> DataFrame:
    """(time, value): the formula over its sensors' series, aligned by time in one aggregation.

    A sensor without a value at a time counts as 0 in sums as long as another has one; a product
    or quotient with it is NULL, and so is a division by zero.
    """
    tokens = parse_formula(formula)
    ids = list(dict.fromkeys(t.text for t in tokens if t.kind == "mi"))
    if not ids:
        raise ValueError("the formula has no sensors")
    wide = df.where(F.col(sensor).isin(ids)).groupBy(time).agg(*[F.sum(F.when(F.col(sensor) == s, F.col(value).cast("double"))).alias(f"s{i}") for i, s in enumerate(ids)])
    stack: list[Column] = []
    for t in tokens:
        if t.kind == "mi":
            stack.append(F.col(f"s{ids.index(t.text)}"))
        elif t.kind == "mn":
            stack.append(F.lit(float(t.text)))
        else:
            b, a = stack.pop(), stack.pop()
            zero = lambda x, y: F.coalesce(x, F.when(y.isNotNull(), 0.0))
            if t.text in "+-":
                stack.append(zero(a, b) + zero(b, a) if t.text == "+" else zero(a, b) - zero(b, a))
            else:
                stack.append(a * b if t.text in "*×" else F.try_divide(a, b))
    return wide.select(time, stack[0].alias("value"))


def ratio_correction(df: DataFrame, total: str = "SUM", ratio: str = "RATIO", least: float = 0.7) -> DataFrame:
    """Sums over the share of the period they cover; rows covering less than ``least`` are dropped."""
    return df.where(F.col(ratio) >= least).withColumn(total, F.col(total) / F.col(ratio))
