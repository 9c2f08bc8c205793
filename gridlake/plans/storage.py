"""Queries that write to the shared folder and read back, and streams run over the driver's tables to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.operators import graph as gr
from gridlake.plans.catalogue import HOURS, hours, query, r, table, triples
from gridlake.runtime import keep_until_exit, shared_dir
from gridlake.sources import series as sr
from gridlake.streaming import series as st

_BACK = f"WITH {HOURS} SELECT {{}} epoch(time)::BIGINT AS start, {r('value', 'value')} FROM h"


def place(spark: SparkSession) -> str:
    """A new folder under the shared one, deleted when the process ends."""
    return keep_until_exit(spark, f"{shared_dir(spark).rstrip('/')}/gridlake-{uuid.uuid4().hex}")


def _points(spark: SparkSession, d: str) -> DataFrame:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return hours(spark, d).select("series_id", iso(F.col("time")).alias("start"), iso(F.col("time") + F.expr("INTERVAL 1 HOUR")).alias("end"), "value", F.lit(True).alias("isReal"))


@query(_BACK.format("series_id AS sensor_id,"))
def source_json(spark, d):
    path = place(spark)
    sr.write_json_series(_points(spark, d).withColumnRenamed("series_id", "id"), path)
    return sr.read_json_series(spark, path).select("sensor_id", "start", "value")


@query(_BACK.format("series_id AS hash,") + " WHERE series_id = 'purchase'")
def source_kpi(spark, d):
    path = place(spark)
    sr.write_json_series(_points(spark, d).withColumnRenamed("series_id", "id"), path)
    return sr.read_kpi_series(spark, path, ["purchase"]).select("hash", "start", "value")


@query(_BACK.format(""))
def source_csv(spark, d):
    path = place(spark)
    _points(spark, d).select("start", "value").write.csv(path, sep=";")
    return sr.read_csv_series(spark, path).select(F.col("time").alias("start"), "value")


@query(_BACK.format(""))
def source_tsv(spark, d):
    path = place(spark)
    _points(spark, d).select("start", "end", "value", "isReal").write.csv(path, sep="\t", header=True)
    return sr.read_tsv_series(spark, path).select("start", "value")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, TRUE AS found FROM orders GROUP BY 1")
def keyed_store(spark, d):
    """Two upserts: the second brings, for each customer, the last of all orders."""
    store = sr.KeyedStore(spark, place(spark), "o_custkey")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    store.upsert(orders.where("o_orderkey % 2 = 0"))
    store.upsert(orders)
    return store.read().withColumn("found", F.lit(True))


@query("SELECT 'http://x.org/c#' || c_custkey AS s, c_mktsegment AS o FROM customer UNION ALL SELECT 'http://x.org/n#' || n_nationkey, n_name FROM nation")
def source_turtle(spark, d):
    path = place(spark)
    names = {"n": "http://x.org/n#", "c": "http://x.org/c#"}
    text = gr.turtle(triples(spark, d), names)
    gr.write_turtle(text, names, path)
    got = gr.read_turtle(spark, path)
    return got.where("p IN ('x:name', 'x:segment')").select("s", "o")


@query("SELECT 'http://x.org/n#' || n_nationkey AS s, n_name AS o FROM nation")
def source_ntriples(spark, d):
    path = place(spark)
    gr.ntriples(triples(spark, d)).write.text(path)
    return gr.read_ntriples(spark, path).where("p = 'x:name'").select("s", "o")


def _run(df: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """Run a stream over what is there; its rows, of several versions of a window the last."""
    path, marks = place(spark), place(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(path)

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return spark.readStream.schema(rows.schema).parquet(f"{d}/event[s].parquet").select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("time"), "value")


@query(f"SELECT event_type AS series_id, epoch(date_trunc('day', ts))::BIGINT AS time, {r('sum(value)', '\"SUM\"')}, {r('avg(value)', '\"AVG\"')}, count(*) AS count FROM events GROUP BY 1, 2")
def stream_resample(spark, d):
    got = _run(st.stream_resample(_stream(spark, d), ["series_id"], "1 day", "2 days"), spark, "update")
    return got.groupBy("series_id", "time").agg(F.max_by(F.struct("SUM", "AVG", "count"), "_batch").alias("x")).select("series_id", "time", "x.*")


@query("SELECT event_type AS series_id, count(*) AS n, count(*) AS folded FROM events WHERE value IS NOT NULL GROUP BY 1")
def stream_low_pass(spark, d):
    got = _run(st.stream_low_pass(_stream(spark, d), "series_id", 0.5), spark, "append")
    return got.groupBy("series_id").agg(F.count("value").alias("n"), F.count("value_lpf").alias("folded"))
