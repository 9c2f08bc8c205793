"""Queries of predicates, joins, single rows and composite readers, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import joins as jo
from gridlake.operators import predicates as pr
from gridlake.operators import readers as rd
from gridlake.operators.graph import union
from gridlake.plans.catalogue import HOURS, hours, query, r, table


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def keep_first(spark, d):
    return jo.keep_one(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def keep_last(spark, d):
    return jo.keep_one(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], last=True).select("o_custkey", "o_orderkey")


_SIDES = "l AS (SELECT CASE WHEN o_orderkey % 7 > 0 THEN o_custkey % 50 END AS k, count(*) AS a FROM orders GROUP BY 1), s AS (SELECT CASE WHEN c_custkey % 40 > 0 THEN c_custkey % 40 + 20 END AS k, count(*) AS b FROM customer GROUP BY 1)"


def _sides(spark, d):
    left = table(spark, d, "orders").groupBy(F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey") % 50).alias("k")).agg(F.count("*").alias("a"))
    right = table(spark, d, "customer").groupBy(F.when(F.col("c_custkey") % 40 > 0, F.col("c_custkey") % 40 + 20).alias("k")).agg(F.count("*").alias("b"))
    return left, right


@query(f"WITH {_SIDES} SELECT coalesce(l.k, -1) AS k, coalesce(a, -1) AS a, coalesce(b, -1) AS b FROM l LEFT JOIN s ON l.k IS NOT DISTINCT FROM s.k")
def join_left_natural(spark, d):
    return jo.null_safe_join(*_sides(spark, d), ["k"], "left").na.fill(-1)


@query(f"WITH {_SIDES} SELECT coalesce(s.k, -1) AS k, coalesce(a, -1) AS a, coalesce(b, -1) AS b FROM l RIGHT JOIN s ON l.k IS NOT DISTINCT FROM s.k")
def join_right(spark, d):
    return jo.null_safe_join(*_sides(spark, d), ["k"], "right").na.fill(-1)


@query(f"WITH {_SIDES} SELECT coalesce(l.k, s.k, -1) AS k, coalesce(a, -1) AS a, coalesce(b, -1) AS b FROM l FULL JOIN s ON l.k IS NOT DISTINCT FROM s.k")
def join_full(spark, d):
    return jo.null_safe_join(*_sides(spark, d), ["k"], "full").na.fill(-1)


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def member_semi(spark, d):
    return jo.member_of(table(spark, d, "supplier"), "s_nationkey", table(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey")).select("s_suppkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def member_anti(spark, d):
    return jo.member_of(table(spark, d, "supplier"), "s_nationkey", table(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey"), negate=True).select("s_suppkey")


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def distinct_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))


@query("SELECT n_regionkey, bool_and(coalesce(s_acctbal >= 0, FALSE)) AS solvent_all, bool_or(coalesce(s_acctbal >= 0, FALSE)) AS solvent_any, bool_and(coalesce(length(s_name) > 5 AND s_name LIKE 'Supplier%', FALSE)) AS named_all, bool_or(coalesce(length(s_name) > 5 AND s_name LIKE 'Supplier%', FALSE)) AS named_any FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def dynamic_predicates(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return pr.rules_by_group(rows, ["n_regionkey"], {"solvent": "s_acctbal >= 0", "named": "length(s_name) > 5 AND s_name LIKE 'Supplier%'"})


@query(f"SELECT l_orderkey, l_linenumber, {r('l_extendedprice + l_tax', 'total')}, {r('(l_extendedprice + l_tax) / 2', 'mean')} FROM lineitem")
def columns_by_pattern(spark, d):
    rows = table(spark, d, "lineitem")
    names = pr.columns_like(rows, "price$|tax$")
    return rows.select("l_orderkey", "l_linenumber", pr.across(rows, names, "sum", False).alias("total"), pr.across(rows, names, "mean", True).alias("mean"))


@query("SELECT n_nationkey AS key, n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_regionkey, r_name, 'other' FROM region")
def union_bound(spark, d):
    """A union in which one side has a variable that the other leaves to a default."""
    one = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    two = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return union(one, two).withColumn("kind", F.coalesce("kind", F.lit("other")))


_KINDS = "CASE WHEN series_id IN ('click', 'view') THEN 'AVG' ELSE 'SUM' END"
_SENSOR = f"""{HOURS}, i AS (SELECT series_id, epoch(time) AS a, epoch(time) + 5400 AS z, value AS v FROM h), k AS (SELECT *, unnest(generate_series((a // 3600)::BIGINT, ((z - 1) // 3600)::BIGINT)) AS k FROM i),
p AS (SELECT *, least(z, (k + 1) * 3600) - greatest(a, k * 3600) AS w FROM k), g AS (SELECT series_id, k, {_KINDS} AS how, CASE WHEN {_KINDS} = 'SUM' THEN sum(v * w / (z - a)) ELSE sum(v * w) / sum(w) END AS value FROM p GROUP BY series_id, k),
e AS (SELECT series_id, min(k) AS lo, max(k) AS hi FROM g GROUP BY 1)"""


def _sensors(spark, d):
    h = hours(spark, d)
    readings = h.select(F.col("series_id").alias("sensor"), F.col("time").alias("start"), (F.col("time") + F.expr("INTERVAL 90 MINUTES")).alias("end"), "value", F.lit(None).cast("boolean").alias("isReal"))
    level = F.col("sensor").isin("click", "view")
    meta = readings.select("sensor").distinct().select("sensor", F.when(level, "Temperature").otherwise("EnergyConsumption").alias("property"), F.lit("PT1H").alias("frequency"), F.lit(False).alias("regular"), F.lit(False).alias("cumulative"), F.lit(False).alias("on_change"))
    return readings, meta


@query(f"WITH {_SENSOR} SELECT g.series_id AS sensor, k // 24 * 86400 AS time, how, {r('CASE WHEN how = $$SUM$$ THEN sum(value) ELSE avg(value) END', 'value')}, {r('1 - count(*) / (least(k // 24 * 24 + 24, max(hi) + 1) - greatest(k // 24 * 24, max(lo)))', '\"GAPS\"')}, {r('count(*) / 24.0', '\"RATIO\"')} FROM g JOIN e USING (series_id) GROUP BY g.series_id, k // 24, how")
def sensor_series(spark, d):
    return rd.sensor_series(*_sensors(spark, d))


_AGG = f"""{_SENSOR}, s AS (SELECT g.series_id AS sensor, k // 24 AS day, sum(value) AS v, 1 - count(*) / (least(k // 24 * 24 + 24, max(hi) + 1) - greatest(k // 24 * 24, max(lo))) AS g, count(*) / 24.0 AS r FROM g JOIN e USING (series_id) WHERE how = 'SUM' GROUP BY g.series_id, k // 24),
f(building, aggregator, sensor, sign) AS (VALUES ('b1', 'total', 'purchase', 1), ('b1', 'total', 'signup', 1), ('b1', 'net', 'purchase', 1), ('b1', 'net', 'signup', -1), ('b2', 'one', 'signup', 1)),
o AS (SELECT building, aggregator, sensor, sign, CASE WHEN building = 'b1' THEN (epoch(date_trunc('month', make_timestamp(day * 86400000000)))::BIGINT) ELSE day * 86400 END AS time, CASE WHEN building = 'b1' THEN 'P1M' ELSE 'P1D' END AS frequency, sum(v) AS v, avg(g) AS g, avg(r) AS r FROM s JOIN f USING (sensor) GROUP BY ALL)"""


@query(f"WITH {_AGG}, a AS (SELECT building, aggregator, time, frequency, sum(sign * v) AS v, avg(g) AS g, avg(r) AS r FROM o GROUP BY ALL) SELECT building, aggregator, time, frequency, {r('v / r', 'value')}, {r('g', '\"GAPS\"')}, {r('r', '\"RATIO\"')} FROM a WHERE r >= 0.7")
def device_aggregators(spark, d):
    mi = lambda s: f"<mi>{s}</mi>"
    rows = [("b1", "total", mi("purchase") + "<mo>+</mo>" + mi("signup"), None), ("b1", "net", mi("purchase") + "<mo>-</mo>" + mi("signup"), "P1D"), ("b2", "one", mi("signup"), "P1D")]
    formulas = spark.createDataFrame(rows, "building string, aggregator string, formula string, frequency string")
    return rd.device_aggregators(rd.sensor_series(*_sensors(spark, d)), formulas, ["P1D", "P1M"])


@query(f"WITH {_AGG}, a AS (SELECT building, aggregator, time, sum(sign * v) AS v, avg(r) AS r FROM o GROUP BY ALL) SELECT building, time, {r('sum(CASE WHEN aggregator = $$total$$ THEN v / r END) + sum(CASE WHEN aggregator = $$net$$ THEN v / r END)', 'value')} FROM a WHERE r >= 0.7 GROUP BY ALL")
def aggregators_merged(spark, d):
    wide = rd.merge_aggregators(device_aggregators(spark, d), ["building", "time"], ["total", "net"], values=("value",))
    return rd.collapse_columns(wide, {"value": ["total.value", "net.value"]}, "sum")


_FACTOR = f"{HOURS}, q AS (SELECT date_trunc('day', time) AS time, sum(value) AS e FROM h WHERE series_id = 'purchase' GROUP BY 1), f AS (SELECT date_trunc('day', time) AS time, avg(value) AS f FROM h WHERE series_id = 'view' GROUP BY 1)"


@query(f"WITH {_FACTOR} SELECT epoch(time)::BIGINT AS time, {r('e', '\"SUM_EnergyConsumption\"')}, {r('f', '\"AVG_EnergyConsumption_EnergyEmissionsFactor\"')}, {r('e * f', '\"SUM_EnergyEmissions\"')} FROM q LEFT JOIN f USING (time)")
def emissions(spark, d):
    h = hours(spark, d)
    energy = h.where("series_id = 'purchase'").groupBy(F.date_trunc("day", "time").alias("time")).agg(F.sum("value").alias("SUM_EnergyConsumption"))
    factors = h.where("series_id = 'view'").select(F.lit("EnergyConsumption").alias("property"), F.lit("PT1H").alias("frequency"), F.col("time").alias("start"), "value", F.col("time").alias("registered"))
    return rd.append_emissions(energy, factors, "EnergyConsumption", "P1D")


@query(f"WITH {HOURS} SELECT series_id, epoch(time)::BIGINT AS time, {r('value * 2.5', '\"SUM_EnergyTotal\"')} FROM h")
def aggregatable(spark, d):
    return rd.to_aggregatable(hours(spark, d).select("series_id", "time", F.col("value").alias("SUM_Gas")), "Gas", "EnergyTotal", {"Other": 2.5})
