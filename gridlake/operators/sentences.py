"""Features named and made by sentences of settings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.operators.features import degree_raw, fourier, lag_components, low_pass
from gridlake.operators.predicates import checked

_CALL = re.compile(r"^\s*(fourier|lags|lowpass|heating|cooling|dummies)\s*\((.*)\)\s*$")


def transform_sentences(df: DataFrame, sentences: dict[str, str], keys: list[str], time: str = "time") -> tuple[DataFrame, dict[str, list[str]]]:
    """df with the columns that the sentences make, and their names by sentence; later sentences may use earlier ones' names.

    A sentence is an expression of columns as checked() allows, or one of
    fourier(column, harmonics) of a feature scaled to a turn, lags(column, k, ...), lowpass(column,
    alpha), heating(column, base), cooling(column, base) in degrees, dummies(column, value, ...) with
    a 0 or 1 per value.
    """
    names: dict[str, list[str]] = {}
    for name, text in sentences.items():
        call = _CALL.match(text)
        if not call:
            df = df.withColumn(name, checked(text, df.columns))
            names[name] = [name]
            continue
        kind, (column, *args) = call.group(1), [a.strip() for a in call.group(2).split(",")]
        if column not in df.columns:
            raise ValueError(f"{text!r} has {column!r}, which is no column")
        before = df.columns
        if kind == "fourier":
            df = df.select("*", *fourier(F.col(column).cast("double"), name, int(args[0])))
        elif kind == "lags":
            df = lag_components(df.withColumn(name, F.col(column)), keys, [name], [int(a) for a in args], time).drop(name)
        elif kind == "lowpass":
            df = low_pass(df.withColumn(name, F.col(column)), keys, [name], float(args[0]), time).drop(name).withColumnRenamed(f"{name}_lpf", name)
        elif kind in ("heating", "cooling"):
            df = df.withColumn(name, degree_raw(F.col(column), F.lit(float(args[0])), kind, hysteresis=0.0))
        else:
            df = df.withColumns({f"{name}_{a}": F.coalesce((F.col(column).cast("string") == a).cast("double"), F.lit(0.0)) for a in args})
        names[name] = [c for c in df.columns if c not in before]
    return df, names
