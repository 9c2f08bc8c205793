"""Queries over a graph of buildings made from the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.operators import graph as gr
from gridlake.operators import registry as rg
from gridlake.plans.catalogue import query, r, table

NS, B = "http://x.org/schema#", "http://x.org/building#"


def _facts(df: DataFrame, subject: Column, kind: str | None, links: dict[str, Column], data: dict[str, Column]) -> DataFrame:
    """Triples of each row: class, links and literals by property; NULLs give none."""
    t = lambda p, o, k: F.struct(subject.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(k).alias("o_type"), F.lit(None).cast("string").alias("datatype"))
    cells = [t(gr.TYPE, F.lit(NS + kind), "uri")] if kind else []
    cells += [t(NS + p, o, "uri") for p, o in links.items()] + [t(NS + p, o, "literal") for p, o in data.items()]
    return df.select(F.inline(F.array(*cells))).where("s IS NOT NULL AND o IS NOT NULL").distinct()


def name(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def graph(spark, d) -> DataFrame:
    """Nations are buildings in regions, suppliers elements of their only space, parts measures, customers indicators with a series per market segment."""
    nation, supplier, part, customer = (table(spark, d, t) for t in ("nation", "supplier", "part", "customer"))
    b = name(B, "n_nationkey")
    space = name(B + "space", "n_nationkey")
    out = _facts(nation, b, "Building", {"hasSpace": space, "hasLocationInfo": name(B + "at", "n_nationkey"), "hasDeviceAggregator": name(B + "agg", "n_nationkey")}, {"buildingName": F.when(F.col("n_nationkey") % 4 > 0, F.col("n_name"))})
    out = out.unionByName(_facts(nation, name(B + "at", "n_nationkey"), None, {"hasAddressProvince": F.when(F.col("n_nationkey") % 3 > 0, name(B + "region", "n_regionkey"))}, {"addressCountry": F.col("n_name")}))
    out = out.unionByName(_facts(nation, name(B + "agg", "n_nationkey"), None, {}, {"deviceAggregatorName": F.lit("total"), "deviceAggregatorFormula": name("<mi>s", "n_nationkey"), "deviceAggregatorFrequency": F.when(F.col("n_nationkey") % 2 > 0, "P1D")}))
    out = out.unionByName(_facts(supplier, name(B + "space", "s_nationkey"), None, {"isAssociatedWithElement": name(B + "element", "s_suppkey")}, {}))
    out = out.unionByName(_facts(part.where("p_partkey % 3 = 0").withColumn("e", F.col("p_partkey") % 50 + 1), name(B + "element", "e"), None, {"isAffectedByMeasure": name(B + "measure", "p_partkey")}, {}))
    out = out.unionByName(_facts(part, name(B + "measure", "p_partkey"), "EnergyEfficiencyMeasure", {"currency": F.lit("usd")}, {"investment": F.col("p_retailprice"), "rate": F.when(F.col("p_partkey") % 2 == 0, 0.9)}))
    project = F.col("p_partkey") % 60
    out = out.unionByName(_facts(part.withColumn("pr", project).withColumn("bu", project % 25), name(B, "bu"), None, {"hasProject": name(B + "project", "pr")}, {}))
    out = out.unionByName(_facts(part.withColumn("pr", project), name(B + "project", "pr"), None, {"includesMeasure": name(B + "measure", "p_partkey")}, {}))
    kpi, series = name(B + "kpi", "c_nationkey"), name(B + "series", "c_custkey")
    out = out.unionByName(_facts(customer, kpi, None, {"hasSeries": series}, {}))
    modelled = customer.where("c_custkey % 2 = 0 AND c_nationkey % 5 > 0")
    out = out.unionByName(_facts(modelled, series, None, {"isEstimatedByModel": name(B + "model", "c_custkey")}, {}))
    return out.unionByName(_facts(modelled, name(B + "model", "c_custkey"), "Model", {}, {"modelDate": F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("c_custkey").cast("int")), "yyyy-MM-dd")}))


@query(f"SELECT '{B}' || n_nationkey AS subject, CASE WHEN n_nationkey % 4 > 0 THEN n_name END AS name, '{B}' AS namespace FROM nation")
def building_list(spark, d):
    return rg.subjects_of(graph(spark, d), NS + "Building", NS + "buildingName")


@query(f"SELECT DISTINCT '{B}' AS namespace FROM nation")
def building_namespaces(spark, d):
    return rg.subjects_of(graph(spark, d), NS + "Building").select("namespace").distinct()


@query(f"SELECT '{B}' || n_nationkey AS subject, CASE WHEN n_nationkey % 3 > 0 THEN '{B}region' || n_regionkey END AS province, n_name AS country FROM nation")
def building_places(spark, d):
    t = graph(spark, d)
    return rg.attributes(t, rg.subjects_of(t, NS + "Building").select("subject"), "subject", {"province": [NS + "hasLocationInfo", NS + "hasAddressProvince"], "country": [NS + "hasLocationInfo", NS + "addressCountry"]})


@query(f"SELECT '{B}kpi' || c_nationkey AS kpi, max(CASE WHEN c_custkey % 2 = 0 AND c_nationkey % 5 > 0 THEN 1 ELSE 0 END) = 1 AS modelled FROM customer GROUP BY 1")
def model_exists(spark, d):
    t = graph(spark, d)
    return rg.with_patterns(t, gr.match(t, [("?kpi", NS + "hasSeries", "?s")]).select("kpi").distinct(), "kpi", [("?model", gr.TYPE, NS + "Model"), ("?s", NS + "isEstimatedByModel", "?model"), ("?kpi", NS + "hasSeries", "?s")], "modelled")


@query(f"SELECT '{B}' || s_nationkey AS building, '{B}element' || s_suppkey AS element, CASE WHEN p_partkey IS NOT NULL THEN '{B}measure' || p_partkey END AS measure FROM supplier LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) p ON p_partkey % 50 + 1 = s_suppkey")
def building_measures(spark, d):
    return rg.measures(graph(spark, d), NS)


@query(f"SELECT '{B}measure' || p_partkey AS measure, {r('CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * 0.9 ELSE p_retailprice END', 'investment', 4)}, CASE WHEN p_partkey % 2 = 0 THEN 0.9::DOUBLE END AS rate, CASE WHEN p_partkey % 2 = 0 THEN 'eur' ELSE 'usd' END AS currency FROM part", digits=4)
def measure_details(spark, d):
    return rg.measure_details(graph(spark, d), NS, {"investment": "investment", "rate": "rate", "currency": "currency"}, "investment", "rate", "currency", "eur")


@query(f"SELECT '{B}' || (p_partkey % 60 % 25) AS building, '{B}project' || (p_partkey % 60) AS project, '{B}measure' || p_partkey AS measure, dense_rank() OVER (PARTITION BY p_partkey % 60 % 25 ORDER BY 'project' || (p_partkey % 60)) AS project_id FROM part")
def measure_projects(spark, d):
    return rg.measure_projects(graph(spark, d), NS)


@query(f"SELECT '{B}' || n_nationkey AS building, 'total' AS aggregator, '<mi>s' || n_nationkey AS formula, NULL::VARCHAR AS property, CASE WHEN n_nationkey % 2 > 0 THEN 'P1D' END AS frequency, NULL::VARCHAR AS how FROM nation")
def aggregator_metadata(spark, d):
    return rg.aggregator_metadata(graph(spark, d), NS)


@query(f"WITH x AS (SELECT c_nationkey AS n, '{B}series' || c_custkey AS series, CASE WHEN c_custkey % 2 = 0 AND c_nationkey % 5 > 0 THEN strftime(DATE '2020-01-01' + c_custkey::INT, '%Y-%m-%d') ELSE '1970-01-01' END AS date FROM customer) SELECT '{B}kpi' || n AS kpi, arg_max(series, (date, series)) AS series FROM x GROUP BY n")
def indicator_series(spark, d):
    return rg.indicator_series(graph(spark, d), NS)


@query(f"WITH v AS (SELECT s_nationkey AS building, count(*)::DOUBLE AS n, sum(s_acctbal)::DOUBLE AS b, sum(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END)::DOUBLE AS e FROM supplier GROUP BY 1), l AS (SELECT building, unnest(['n', 'b', 'e']) AS kpi, unnest([n, b, e]) AS value, n, e FROM v) SELECT building, kpi, {r('value', 'value', 4)}, {r('CASE WHEN kpi <> $$b$$ THEN value WHEN n * e = 0 THEN 0 ELSE value / (n * e) END', 'rated', 4)} FROM l", digits=4)
def kpi_by_building(spark, d):
    v = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("building")).agg(F.count("*").cast("double").alias("n"), F.sum("s_acctbal").cast("double").alias("b"), F.sum((F.col("s_suppkey") % 2 == 0).cast("int")).cast("double").alias("e"))
    long = v.select("building", F.inline(F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).alias("value")) for k in "nbe"])))
    return rg.kpi_by_building(long, spark.createDataFrame([("b", "n"), ("b", "e")], "kpi string, by string"))


@query("SELECT sensorid AS sensor, coalesce(min(addresstimezone), 'UTC') AS tz FROM harmonised_reading WHERE regexp_matches(sensorid, '[0-4]$') GROUP BY 1")
def zone_by_pattern(spark, d):
    facts = table(spark, d, "harmonised_reading").groupBy(F.col("sensorid").alias("sensor")).agg(F.min("addresstimezone").alias("tz"))
    return rg.zones_by_pattern(facts, "[0-4]$")
