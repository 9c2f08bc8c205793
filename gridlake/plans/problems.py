"""Queries of the general training-data operators (problems 1, 3, 5 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.operators.missing import PLACEHOLDER_NUMBERS, PLACEHOLDER_WORDS, impute_chained
from gridlake.operators.regular import regular_grid
from gridlake.operators.spikes import flag_faults
from gridlake.operators.timestamps import normalise_timestamps, source_zones


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = impute_chained(table(spark, sf_dir, "building_hourly"))
    cells = F.array(*[F.when(F.col(f + "_filled"), F.lit(f)) for f in ("qe", "temperature", "usetype")])
    return filled.select("reading_id", F.explode(F.array_compact(cells)).alias("field"))


def p1_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute_chained(table(spark, sf_dir, "building_hourly"))


def _instants(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    lines = table(spark, sf_dir, "test_ts_hourly").select("series_id", "c0", "received_ts", *columns)
    return normalise_timestamps(lines, source_zones(table(spark, sf_dir, "harmonised_reading")))


def p3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_grid(_instants(spark, sf_dir, "c1"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_grid(spark, sf_dir).where("mark = 'filled'").select("series_id", "slot_us")


def p5_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instants(spark, sf_dir, "line_id").select("line_id", "utc_us", "notation", "ambiguous")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instants(spark, sf_dir, "line_id").where("utc_us IS NOT NULL AND NOT exact").select("line_id", "utc_us")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_faults(table(spark, sf_dir, "building_hourly")).select("reading_id", "field")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_imputed, p3_found, p3_grid, p5_found, p5_utc, p6_found)}


def oracle_sql() -> dict[str, str]:
    numbers = ", ".join(f"{x}::DOUBLE" for x in PLACEHOLDER_NUMBERS)
    words = ", ".join(f"'{x}'" for x in PLACEHOLDER_WORDS)
    number = lambda f: f"SELECT reading_id, '{f}' AS field FROM building_hourly WHERE {f} IS NULL OR isnan({f}) OR {f} IN ({numbers})"
    return {"p1_found": f"{number('qe')} UNION ALL {number('temperature')} UNION ALL SELECT reading_id, 'usetype' AS field FROM building_hourly WHERE usetype IS NULL OR lower(trim(usetype)) IN ({words})"}
