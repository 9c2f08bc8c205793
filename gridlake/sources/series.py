"""Reading and writing series, and a table kept by key."""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POINT = T.StructType([T.StructField("start", T.StringType()), T.StructField("end", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("isReal", T.BooleanType())])


def read_json_series(spark: SparkSession, path: str, sensors: list[str] | None = None) -> DataFrame:
    """(sensor_id, start, end, value, isReal) of JSON files that map a sensor to its points. isReal stays NULL where absent."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", T.MapType(T.StringType(), T.ArrayType(_POINT))).alias("m"))
    flat = raw.select(F.explode("m").alias("sensor_id", "_p")).select("sensor_id", F.inline("_p"))
    flat = flat.where(F.col("sensor_id").isin(sensors)) if sensors is not None else flat
    return flat.withColumns({"start": F.to_timestamp("start"), "end": F.to_timestamp("end")})


def read_tsv_series(spark: SparkSession, path: str) -> DataFrame:
    """The same of tab-separated files with a header, named after the sensor; isReal is FALSE where absent."""
    schema = "start STRING, end STRING, value STRING, isReal STRING"
    rows = spark.read.schema(schema).csv(path, sep="\t", header=True).withColumn("sensor_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.tsv", 1))
    return rows.select("sensor_id", F.to_timestamp("start").alias("start"), F.to_timestamp("end").alias("end"), F.col("value").try_cast("double").alias("value"), F.coalesce(F.col("isReal").try_cast("boolean"), F.lit(False)).alias("isReal"))


def read_csv_series(spark: SparkSession, path: str) -> DataFrame:
    """(time, value) of headerless files of ``time;value``."""
    return spark.read.schema("time STRING, value DOUBLE").csv(path, sep=";").select(F.to_timestamp("time").alias("time"), "value")


def write_json_series(df: DataFrame, path: str, key: str = "id") -> None:
    """One JSON object, and file, per series and month of ``start``, NULLs written; partitioned by the key so that a reader prunes."""
    point = F.struct(*[c for c in df.columns if c != key])
    month = F.coalesce(F.date_format(F.col("start").cast("timestamp"), "yyyy-MM"), F.lit("none"))
    out = df.groupBy(key, month.alias("month")).agg(F.to_json(F.create_map(F.col(key), F.sort_array(F.collect_list(point))), {"ignoreNullFields": "false"}).alias("value"))
    out.write.mode("overwrite").partitionBy(key, "month").text(path)


def read_kpi_series(spark: SparkSession, path: str, hashes: list[str] | None = None) -> DataFrame:
    """(hash, start, end, value, isReal) of JSON files of indicator series, of the given hashes only, in files named after one of them or not."""
    return read_json_series(spark, path, hashes).withColumnRenamed("sensor_id", "hash")


def holiday_client(base: str) -> Callable[[int, str], list[dict]]:
    """A client for holiday_table(): the JSON list at {base}/{year}/{country}, of a public holiday service or a copy of its files."""

    def fetch(year: int, country: str) -> list[dict]:
        with urllib.request.urlopen(f"{base.rstrip('/')}/{year}/{country}", timeout=30) as got:
            return json.load(got)

    return fetch


class KeyedStore:
    """A table of documents, one per key: writing replaces the keys it brings.

    A version is switched by its pointer file. A second writer finds the lock file of the first and
    fails; a lock left by a writer that died has to be removed by hand.
    """

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _pointer(self):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/current.json")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _version(self) -> str | None:
        p, fs = self._pointer()
        return json.loads(self.spark.read.text(f"{self.path}/current.json", wholetext=True).first()[0])["version"] if fs.exists(p) else None

    def read(self) -> DataFrame | None:
        v = self._version()
        return self.spark.read.parquet(f"{self.path}/{v}") if v else None

    def find(self, value: object) -> DataFrame | None:
        got = self.read()
        return got.where(F.col(self.key) == F.lit(value)) if got is not None else None

    def upsert(self, docs: DataFrame) -> None:
        """Of several documents of one key the one that sorts last is kept."""
        p, fs = self._pointer()
        lock = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/writing.lock")
        fs.create(lock, False).close()  # raises if there is one
        try:
            self._replace(docs)
        finally:
            fs.delete(lock, False)

    def _replace(self, docs: DataFrame) -> None:
        rest = [c for c in docs.columns if c != self.key]
        docs = docs.groupBy(self.key).agg(F.max(F.struct(*rest)).alias("_d")).select(self.key, "_d.*") if rest else docs.distinct()
        old, version = self.read(), f"v-{uuid.uuid4().hex}"
        new = docs if old is None else old.join(docs.select(self.key), self.key, "left_anti").unionByName(docs, allowMissingColumns=True)
        new.write.parquet(f"{self.path}/{version}")
        p, fs = self._pointer()
        out = fs.create(p, True)
        out.write(bytearray(json.dumps({"version": version}), "utf-8"))
        out.close()
