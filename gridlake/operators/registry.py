"""What a graph of buildings tells: lists, places, models, measures, aggregators and indicator series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.operators.graph import TYPE, latest, match, optional


def namespace_of(c: Column) -> Column:
    """A name up to its last # or /, with it."""
    return F.regexp_extract(c, r"^(.*[#/])[^#/]*$", 1)


def subjects_of(triples: DataFrame, kind: str, name: str | None = None) -> DataFrame:
    """(subject, namespace[, name]): the subjects of a class, with the literal of the property ``name`` where it is stated."""
    got = match(triples, [("?subject", TYPE, kind)])
    got = optional(got, triples, [("?subject", name, "?name")]) if name else got
    return got.withColumn("namespace", namespace_of(F.col("subject"))).distinct()


def attributes(triples: DataFrame, subjects: DataFrame, key: str, paths: dict[str, list[str]]) -> DataFrame:
    """The subjects with a column per path of properties, NULL where it leads nowhere; a path with several ends gives several rows."""
    got = subjects
    for name, path in paths.items():
        steps = [f"?{key}", *[f"?_{name}{i}" for i in range(len(path) - 1)], f"?{name}"]
        got = optional(got, triples, [(a, p, b) for a, p, b in zip(steps[:-1], path, steps[1:], strict=True)]).select(*got.columns, name)
    return got


def exists(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> bool:
    """Whether the pattern has a solution; the first one ends the search."""
    return not match(triples, patterns).isEmpty()


def with_patterns(triples: DataFrame, subjects: DataFrame, key: str, patterns: list[tuple[str, str, str]], name: str = "exists") -> DataFrame:
    """The subjects with TRUE where the pattern, which binds ``key``, has a solution."""
    hits = match(triples, patterns).select(key).distinct().withColumn(name, F.lit(True))
    return subjects.join(hits, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def zones_by_pattern(sensors: DataFrame, pattern: str, sensor: str = "sensor", zone: str = "tz") -> DataFrame:
    """(sensor, tz) of the sensors in whose name the pattern is found; UTC where no zone is stated."""
    return sensors.where(F.col(sensor).rlike(pattern)).select(sensor, F.coalesce(zone, F.lit("UTC")).alias(zone)).distinct()


def measures(triples: DataFrame, ns: str) -> DataFrame:
    """(building, element, measure): the elements of buildings' spaces and the measures that affect them, NULL for none."""
    got = match(triples, [("?building", TYPE, ns + "Building"), ("?building", ns + "hasSpace", "?space"), ("?space", ns + "isAssociatedWithElement", "?element")])
    return optional(got, triples, [("?element", ns + "isAffectedByMeasure", "?measure")]).select("building", "element", "measure")


def measure_details(triples: DataFrame, ns: str, fields: dict[str, str], amount: str, rate: str, currency: str, into: str) -> DataFrame:
    """(measure, fields...): the measures' stated facts; ``amount`` times the exchange rate, and then in the currency ``into``, where a rate is stated."""
    got = attributes(triples, match(triples, [("?measure", TYPE, ns + "EnergyEfficiencyMeasure")]), "measure", {f: [ns + p] for f, p in fields.items()})
    r = F.col(rate).try_cast("double")
    return got.withColumns({amount: F.col(amount).try_cast("double") * F.coalesce(r, F.lit(1.0)), currency: F.when(r.isNotNull(), into).otherwise(F.col(currency)), rate: r})


def measure_projects(triples: DataFrame, ns: str) -> DataFrame:
    """(building, project, measure, project_id): the projects of buildings and their measures; ids count a building's projects from 1, in the order of their names."""
    got = match(triples, [("?building", TYPE, ns + "Building"), ("?building", ns + "hasProject", "?project"), ("?project", ns + "includesMeasure", "?measure")])
    return got.select("building", "project", "measure", F.dense_rank().over(Window.partitionBy("building").orderBy("project")).alias("project_id"))


def aggregator_metadata(triples: DataFrame, ns: str) -> DataFrame:
    """(building, aggregator, formula, property, frequency, how): the device aggregators of buildings, NULL for what isn't stated."""
    got = match(triples, [("?building", ns + "hasDeviceAggregator", "?subject")])
    paths = {"aggregator": "deviceAggregatorName", "formula": "deviceAggregatorFormula", "property": "hasDeviceAggregatorProperty", "frequency": "deviceAggregatorFrequency", "how": "deviceAggregatorTimeAggregationFunction"}
    return attributes(triples, got, "subject", {n: [ns + p] for n, p in paths.items()}).select("building", *paths)


def indicator_series(triples: DataFrame, ns: str, default_date: str = "1970-01-01") -> DataFrame:
    """(kpi, series): of each indicator the series of its newest model; a series without a model counts as of ``default_date``."""
    base = match(triples, [("?kpi", ns + "hasSeries", "?series")])
    dated = match(triples, [("?kpi", ns + "hasSeries", "?series"), ("?series", ns + "isEstimatedByModel", "?model"), ("?model", ns + "modelDate", "?date")]).select("kpi", "series", "date")
    undated = base.join(dated.select("series"), "series", "left_anti").select("kpi", "series", F.lit(default_date).alias("date"))
    return latest(dated.unionByName(undated), ["kpi"], "date").select("kpi", "series")


def kpi_by_building(values: DataFrame, rated_by: DataFrame) -> DataFrame:
    """(building, kpi, value, rated): each indicator over the product of those it is rated by, 0 for a product of 0.

    values: (building, kpi, value); rated_by: (kpi, by). A rating indicator without a value doesn't count.
    """
    by = rated_by.join(values.select("building", F.col("kpi").alias("by"), F.col("value").alias("_v")), "by").where("_v IS NOT NULL")
    product = by.groupBy("building", "kpi").agg(F.product("_v").alias("_p"))
    ratio = F.when(F.col("_p") == 0, 0.0).otherwise(F.try_divide(F.col("value"), F.coalesce("_p", F.lit(1.0))))
    return values.join(product, ["building", "kpi"], "left").select("building", "kpi", "value", ratio.alias("rated"))
