"""Composite readers: many sensors' series by their metadata, aggregators over sensors, factors joined on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.period import bucket, bucket_seconds, seconds
from gridlake.operators.joins import keep_one
from gridlake.operators.predicates import across, columns_like
from gridlake.operators.resample import align_time_grid
from gridlake.operators.sensors import aggregation_of, interval_ends, intervals_to_grid
from gridlake.runtime import BROADCAST_GROUPS, require


def per_period(periods: list[str], chosen: Column, make) -> Column:  # noqa: ANN001
    """``make`` of each period where it is the one chosen; NULL for any other."""
    out = F.lit(None)
    for p in periods:
        out = F.when(chosen == p, make(p)).otherwise(out)
    return out


def sensor_series(readings: DataFrame, meta: DataFrame, step: str = "PT1H", output: str = "P1D", sensor: str = "sensor", use_estimated: bool = False, tz: str = "UTC") -> DataFrame:
    """(sensor, time, how, value, GAPS, RATIO): every sensor's series on a grid of ``output``, by what its metadata says.

    readings: (sensor, start, end, value, isReal). meta, a row per sensor: (sensor, property,
    frequency, regular, cumulative, on_change). Irregular series become intervals: cumulative ones from
    reading to reading, on-change ones until the next reading or their frequency's end, and are cut at
    the lines of ``step``: sums are shared out by time, levels are time-weighted. Regular ones are
    taken at their start. ``how`` follows from the property. GAPS is the share of the grid's steps
    from a sensor's first to its last that lack a value, per period; RATIO the share of the period
    that has one. Estimated readings count with ``use_estimated`` only (NULL isReal is real). Sensors
    without metadata or readings give no rows.
    """
    require(readings, sensor, "start", "end", "value", "isReal")
    require(meta, sensor, "property", "frequency", "regular", "cumulative", "on_change")
    facts = meta.select(F.col(sensor).alias("_s"), aggregation_of(F.col("property")).alias("how"), "frequency", *[F.coalesce(F.col(c), F.lit(c == "regular")).alias(c) for c in ("regular", "cumulative", "on_change")])
    real = F.lit(True) if use_estimated else F.coalesce("isReal", F.lit(True))
    rows = readings.where(real).select(F.col(sensor).alias("_s"), *[F.col(c).cast("timestamp").alias(c) for c in ("start", "end")], F.col("value").cast("double").alias("value"))
    rows = rows.join(F.broadcast(facts) if facts.count() <= BROADCAST_GROUPS else facts, "_s")
    periods = [r[0] for r in facts.select("frequency").distinct().where("frequency IS NOT NULL").collect()]  # as many as kinds of period
    hold = F.coalesce(per_period(periods, F.col("frequency"), lambda p: F.lit(seconds(p))), F.lit(seconds("P1M")))
    loose = interval_ends(rows.where("NOT regular"), ["_s"], F.col("on_change"), F.col("cumulative"), hold, time="start")
    total = intervals_to_grid(loose.where("how = 'SUM'"), ["_s"], step, "SUM")
    level = intervals_to_grid(loose.where("how = 'AVG'"), ["_s"], step, "AVG")
    fixed = rows.where("regular").groupBy("_s", bucket(F.col("start"), step, "UTC").alias("time"), "how").agg(F.when(F.col("how") == "SUM", F.sum("value")).otherwise(F.avg("value")).alias("value"))
    grid = total.select("_s", "time", F.lit("SUM").alias("how"), "value").unionByName(level.select("_s", "time", F.lit("AVG").alias("how"), "value")).unionByName(fixed)
    b = bucket(F.col("time"), output, tz)
    got = grid.groupBy("_s", "how", b.alias("_b")).agg(F.sum("value").alias("s"), F.avg("value").alias("m"), F.count("value").alias("n"))
    ends = grid.groupBy("_s").agg(F.min("time").alias("_a"), F.max("time").alias("_z"))
    got = got.join(F.broadcast(ends) if facts.count() <= BROADCAST_GROUPS else ends, "_s")
    length = bucket_seconds(F.from_utc_timestamp("_b", tz), output)
    low, high = F.greatest(F.unix_seconds("_b"), F.unix_seconds("_a")), F.least(F.unix_seconds("_b") + length, F.unix_seconds("_z") + seconds(step))
    steps = (high - low) / seconds(step)
    return got.select(F.col("_s").alias(sensor), F.col("_b").alias("time"), "how", F.when(F.col("how") == "SUM", F.col("s")).otherwise(F.col("m")).alias("value"), (1 - F.col("n") / steps).alias("GAPS"), (F.col("n") * seconds(step) / length).alias("RATIO"))


def device_aggregators(series: DataFrame, formulas: DataFrame, periods: list[str], least_ratio: float | None = 0.7, tz: str = "UTC", time: str = "time") -> DataFrame:
    """(building, aggregator, time, frequency, value, GAPS, RATIO): sums and differences of sensors, per building in its largest frequency.

    series: (sensor, time, how, value, GAPS, RATIO) of sensor_series() at the finest step; formulas:
    (building, aggregator, formula, frequency), the formula as in parse_formula() with + and - only, a
    missing frequency counting as a month. Sensors without a value at a time count as 0 as long as
    another has one; GAPS and RATIO are means. With ``least_ratio`` sums are divided by RATIO and rows
    under it are dropped. ``periods`` lists the frequencies that may occur, from short to long.
    """
    require(series, "sensor", time, "how", "value", "GAPS", "RATIO")
    require(formulas, "building", "aggregator", "formula", "frequency")
    order = {p: k for k, p in enumerate(periods)}
    rank = F.coalesce(per_period(periods, F.coalesce("frequency", F.lit("P1M")), lambda p: F.lit(order[p])), F.lit(-1))
    largest = F.max(rank).over(Window.partitionBy("building"))
    terms = formulas.withColumn("_f", largest).where(F.col("formula").isNotNull() & ~F.col("formula").rlike(r"<mo>\s*[^+\-\s]")).select(
        "building", "aggregator", "_f", F.explode(F.regexp_extract_all(F.concat(F.lit("<mo>+</mo>"), "formula"), F.lit(r"<mo>\s*([+\-])\s*</mo>\s*<mi>\s*([^<]*?)\s*</mi>"), F.lit(0))).alias("_t")
    )
    part = terms.select("building", "aggregator", "_f", F.regexp_extract("_t", r"<mi>\s*([^<]*?)\s*</mi>", 1).alias("sensor"), F.when(F.col("_t").rlike(r"<mo>\s*-"), -1.0).otherwise(1.0).alias("_sign"))
    rows = series.join(F.broadcast(part) if part.count() <= BROADCAST_GROUPS else part, "sensor")
    name = F.element_at(F.array(*[F.lit(p) for p in periods]), (F.col("_f") + 1).cast("int"))
    start = per_period(periods, name, lambda p: bucket(F.col(time).cast("timestamp"), p, tz))
    one = rows.groupBy("building", "aggregator", "sensor", "_sign", "how", name.alias("frequency"), start.alias("time")).agg(F.when(F.col("how") == "SUM", F.sum("value")).otherwise(F.avg("value")).alias("v"), F.avg("GAPS").alias("g"), F.avg("RATIO").alias("r"))
    got = one.groupBy("building", "aggregator", "how", "time", "frequency").agg(F.sum(F.col("v") * F.col("_sign")).alias("value"), F.avg("g").alias("GAPS"), F.avg("r").alias("RATIO"))
    if least_ratio is not None:
        got = got.where(F.col("RATIO") >= least_ratio).withColumn("value", F.when(F.col("how") == "SUM", F.col("value") / F.col("RATIO")).otherwise(F.col("value")))
    return got.select("building", "aggregator", "time", "frequency", "value", "GAPS", "RATIO")


def merge_aggregators(long: DataFrame, keys: list[str], names: list[str], column: str = "aggregator", values: tuple[str, ...] = ("value", "GAPS", "RATIO")) -> DataFrame:
    """(keys..., {name}.{value}...): the named aggregators side by side, as a full outer merge would have them, out of one aggregation."""
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col(column) == n, F.col(v))).alias(f"{n}.{v}") for n in names for v in values])


def collapse_columns(df: DataFrame, groups: dict[str, list[str]], how: str) -> DataFrame:
    """Each group's columns as one: their sum or mean, NULL where any is, since a part of the sources would mislead."""
    used = {c for cs in groups.values() for c in cs}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in used], *[across(df, [f"`{c}`" for c in cs], how, skip_null=False).alias(n) for n, cs in groups.items()])


def to_aggregatable(df: DataFrame, old: str, new: str, factors: dict[str, float] | None = None) -> DataFrame:
    """Columns that end with a measured property, times its factor (that of 'Other', or 1), under the new property's name; also its EnergyEmissionsFactor."""
    factor = float((factors or {}).get(old, (factors or {}).get("Other", 1.0)))
    hit = set(columns_like(df, f"{old}(_EnergyEmissionsFactor)?$"))
    return df.select(*[(F.col(c) * factor if c in hit else F.col(c)).alias(c.replace(old, new)) for c in df.columns])


def append_emissions(df: DataFrame, factors: DataFrame, prop: str, frequency: str, time: str = "time", tz: str = "UTC") -> DataFrame:
    """Add AVG_{prop}_EnergyEmissionsFactor and SUM_EnergyEmissions to a series on a grid of ``frequency``.

    factors: (property, frequency, start, value, registered). The factor series of the same frequency
    is taken, else that of the largest smaller one; without any df comes back with NULLs. Of several
    factors of one start the last registered counts. Several columns that end with the property are
    summed, NULLs passed over.
    """
    require(df, time)
    require(factors, "property", "frequency", "start", "value", "registered")
    own = factors.where(F.col("property") == prop)
    known = [r[0] for r in own.select("frequency").distinct().where("frequency IS NOT NULL").collect()]  # as many as kinds of period
    fit = [p for p in known if seconds(p) <= seconds(frequency)]
    name = f"AVG_{prop}_EnergyEmissionsFactor"
    if not fit:
        return df.withColumns({name: F.lit(None).cast("double"), "SUM_EnergyEmissions": F.lit(None).cast("double")})
    best = max(fit, key=seconds)
    one = keep_one(own.where(F.col("frequency") == best).select("start", "value", "registered"), ["start"], [F.col("registered"), F.col("value")], last=True)
    grid = align_time_grid(one.withColumn("_k", F.lit(0)), ["_k"], frequency, ["AVG"], best, "start", "value", None, tz=tz).select(F.col("time").alias(time), F.col("AVG").alias(name))
    columns = columns_like(df, f"{prop}$")
    total = across(df, columns, "sum", skip_null=True) if len(columns) > 1 else F.col(columns[0])
    return df.join(grid, time, "left").withColumn("SUM_EnergyEmissions", total * F.col(name))
