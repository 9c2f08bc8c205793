"""Queries of the llm operators and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm.clusters import cluster_curves, describe_clusters, pairs_together
from gridlake.llm.leaks import find_leaks, remove_leaks
from gridlake.llm.percentiles import merge_counts, percentiles, value_counts
from gridlake.llm.repetition import repetition_report
from gridlake.llm.tokens import encode_corpus
from gridlake.operators.missing import PLACEHOLDER_NUMBERS, PLACEHOLDER_WORDS, no_category, no_number

POINTS = [0.05, 0.25, 0.5, 0.75, 0.95]
VOCABULARY = os.environ.get("GRIDLAKE_BYTE_BPE", "/opt/tokenizers/byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_together(table(spark, sf_dir, "curve_pairs"), cluster_curves(table(spark, sf_dir, "load_curves")))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_curves(table(spark, sf_dir, "load_curves"))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_clusters(cluster_curves(table(spark, sf_dir, "load_curves")))


def _by(spark: SparkSession, sf_dir: str, name: str, key: Column) -> DataFrame:
    rows = table(spark, sf_dir, "building_hourly")
    got = percentiles(value_counts(rows, {name: key}, F.col("qe"), no_number(F.col("qe"))), [name], POINTS)
    return got.select(name, "n", *[F.round(c, 6).alias(c) for c in got.columns[2:]])


def p4_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by(spark, sf_dir, "buildingsubject", F.col("buildingsubject"))


def p4_usetype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by(spark, sf_dir, "usetype", F.when(~no_category(F.col("usetype")), F.col("usetype")))


def p4_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by(spark, sf_dir, "month", F.date_format("reading_ts", "yyyy-MM"))


def p4_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of single days, merged to months."""
    rows = table(spark, sf_dir, "building_hourly")
    days = value_counts(rows, {"day": F.to_date("reading_ts")}, F.col("qe"), no_number(F.col("qe")))
    months = merge_counts(days.withColumn("month", F.date_format("day", "yyyy-MM")), ["month"])
    got = percentiles(months, ["month"], POINTS)
    return got.select("month", "n", *[F.round(c, 6).alias(c) for c in got.columns[2:]])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), VOCABULARY)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p8_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_report(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_shares(spark, sf_dir).where("repetitive").select("doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_members, p2_clusters, p4_building, p4_usetype, p4_month, p4_combined, p7_ids, p8_found, p8_removed, p9_found, p9_shares)}


def oracle_sql() -> dict[str, str]:
    numbers = ", ".join(f"{x}::DOUBLE" for x in PLACEHOLDER_NUMBERS)
    words = ", ".join(f"'{x}'" for x in PLACEHOLDER_WORDS)
    cols = ", ".join(f"round(quantile_cont(qe, {p}), 6) AS p{int(p * 100):02d}" for p in POINTS)
    sql = lambda key, name: f"SELECT {key} AS {name}, count(*) AS n, {cols} FROM building_hourly WHERE qe IS NOT NULL AND NOT isnan(qe) AND qe NOT IN ({numbers}) GROUP BY 1"
    month = "strftime(reading_ts AT TIME ZONE 'UTC', '%Y-%m')"
    return {
        "p4_building": sql("buildingsubject", "buildingsubject"),
        "p4_usetype": sql(f"CASE WHEN usetype IS NOT NULL AND lower(trim(usetype)) NOT IN ({words}) THEN usetype END", "usetype"),
        "p4_month": sql(month, "month"),
        "p4_combined": sql(month, "month"),
        "p9_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS k FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) > 1 AS again FROM g WHERE k IS NOT NULL), c AS (SELECT DISTINCT doc_id, i + unnest(range(5)) AS i FROM h WHERE again), n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
SELECT doc_id FROM d JOIN n USING (doc_id) WHERE n > len(w) / 3.0""",
    }
