"""Queries of the engine's own operators on the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.period import Period, iso_z
from gridlake.operators import features as fe
from gridlake.operators import fill as fi
from gridlake.operators import graph as gr
from gridlake.operators import joins as jo
from gridlake.operators import kpi as kp
from gridlake.operators import outliers as ou
from gridlake.operators import profiles as pf
from gridlake.operators import resample as rs

# Added before rounding on both sides: means of two-decimal values often end in an exact half.
NUDGE = 1.3e-8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HOURS = "h AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS time, avg(value) AS value, count(*) AS n FROM events GROUP BY 1, 2)"
HOLES = HOURS + ", g AS (SELECT series_id, time, n, CASE WHEN (epoch(time)::BIGINT // 3600) % 5 <> 0 THEN value END AS value FROM h)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of the events: series_id, time, value, n."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("time")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hours(spark, sf_dir).withColumn("value", F.when(F.floor(F.unix_timestamp("time") / 3600) % 5 != 0, F.col("value")))


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Times as seconds and rounded doubles: what two engines write alike."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind.startswith("timestamp"):
            c = F.unix_timestamp(c.cast("timestamp"))
        elif kind == "double":
            c = F.round(c + NUDGE, digits) + F.lit(0.0)
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(sql: str | None = None, digits: int = 6) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir), digits)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


K = ["series_id"]


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE + {NUDGE}::DOUBLE, {digits}) + 0.0::DOUBLE AS {name}"


T = "epoch(time)::BIGINT AS time"

# ---- time steps, resampling, grids


@query(f"""WITH {HOURS}, d AS (SELECT series_id, (epoch(time) - epoch(lag(time) OVER (PARTITION BY series_id ORDER BY time)))::BIGINT AS d FROM h),
i AS (SELECT series_id, CASE WHEN d = 604800 THEN 'P1W' WHEN d % 86400 = 0 THEN 'P' || (d // 86400) || 'D' ELSE 'PT' || (d // 3600) || 'H' END AS iso, count(*) AS n FROM d WHERE d IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, iso) AS rn FROM i) SELECT series_id, iso AS timestep FROM k WHERE rn = 1""")
def detect_time_step(spark, d):
    return rs.detect_time_step(hours(spark, d), K)


_DAY = "SELECT series_id, date_trunc('day', time) AS time, {} AS value, count(*) AS count FROM {} GROUP BY 1, 2"
_RES = f"SELECT series_id, {T}, {r('value', 'value')}, CASE WHEN value IS NOT NULL THEN count = 24 END AS \"isReal\", count FROM x WHERE count > 24 * 0.5"


@query(f"WITH {HOLES}, x AS ({_DAY.format('avg(value) * 24', 'g')}) {_RES}")
def resample_sum(spark, d):
    return rs.resample_and_aggregate(holes(spark, d), K, "P1D", "SUM", min_ratio=50)


@query(f"WITH {HOLES}, x AS ({_DAY.format('sum(value)', 'g')}) {_RES}")
def resample_real_sum(spark, d):
    return rs.resample_and_aggregate(holes(spark, d), K, "P1D", "SUM", min_ratio=50, estimate=False)


@query(f"WITH {HOLES}, x AS ({_DAY.format('avg(value)', 'g')}) {_RES}")
def resample_avg(spark, d):
    return rs.resample_and_aggregate(holes(spark, d), K, "P1D", "AVG", min_ratio=50)


@query(f"WITH {HOLES}, x AS ({_DAY.format('sum(value * n) / sum(CASE WHEN value IS NOT NULL THEN n END)', 'g')}) {_RES}")
def resample_weighted_avg(spark, d):
    return rs.resample_and_aggregate(holes(spark, d), K, "P1D", "WEIGHTED-AVG", weight="n", min_ratio=50)


@query(f"WITH {HOLES} SELECT series_id, min(epoch(time))::BIGINT AS time, {r('avg(value) * count(*)', 'value')}, true AS \"isReal\", count(*) AS count FROM g GROUP BY 1")
def resample_whole(spark, d):
    return rs.resample_and_aggregate(holes(spark, d), K, "", "SUM")


def _align(out: str, length: str) -> str:
    return f"""WITH {HOLES} SELECT series_id, epoch(date_trunc('{out}', time))::BIGINT AS time, {r('coalesce(sum(value), 0)', 'SUM')}, {r('avg(value)', 'AVG')}, {r('min(value)', 'MIN')}, {r('max(value)', 'MAX')},
{r('1 - count(value)::DOUBLE / count(*)', 'GAPS')}, {r(f'count(value) * 3600.0::DOUBLE / ({length})', 'RATIO')} FROM g GROUP BY series_id, date_trunc('{out}', time)"""


_FOUR = ["SUM", "AVG", "MIN", "MAX"]


@query(_align("day", "86400"))
def align_sum(spark, d):
    return rs.align_time_grid(holes(spark, d), K, "P1D", _FOUR, "PT1H")


@query(_align("week", "604800"))
def align_week(spark, d):
    return rs.align_time_grid(holes(spark, d), K, "P1W", _FOUR, "PT1H")


@query(_align("month", "max(day(last_day(time))) * 86400"))
def align_month(spark, d):
    return rs.align_time_grid(holes(spark, d), K, "P1M", _FOUR, "PT1H")


@query(f"""WITH {HOURS}, t AS (SELECT series_id, date_trunc('day', time) AS time, avg(value) AS v FROM h GROUP BY 1, 2), n AS (SELECT series_id, date_trunc('day', time) AS time, count(*) AS n FROM h GROUP BY 1, 2)
SELECT series_id, {T}, {', '.join([r(f'CASE WHEN v < {b} THEN {b} - v ELSE 0 END', f'HDD{b}') for b in (20, 21, 22)] + [r(f'CASE WHEN v > {b} THEN v - {b} ELSE 0 END', f'CDD{b}') for b in (20, 21, 22)])}, 0.0::DOUBLE AS "GAPS", {r('n * 3600 / 86400.0::DOUBLE', 'RATIO')} FROM t JOIN n USING (series_id, time)""")
def align_hdd_cdd(spark, d):
    return rs.align_time_grid(hours(spark, d), K, "P1D", ["HDD", "CDD"], "PT1H")


@query(f"""WITH {HOURS}, e AS (SELECT series_id, min(time) AS a, max(time) AS z FROM h GROUP BY 1), p AS (SELECT series_id, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS time FROM e)
SELECT series_id, {T}, {r('value', 'value')}, n FROM p LEFT JOIN h USING (series_id, time)""")
def pad_grid(spark, d):
    return rs.pad_grid(hours(spark, d), K, "PT1H")


# ---- outliers


@query(f"WITH {HOLES} SELECT series_id, {T}, value < 20 OR value > 80 AS outlier FROM g")
def outlier_minmax(spark, d):
    return ou.min_max_outliers(holes(spark, d), K, 20.0, 80.0).select("series_id", "time", "outlier")


@query(f"""WITH {HOLES}, b AS (SELECT series_id, date_trunc('day', time) + INTERVAL 6 HOUR AS time, avg(value) * 1.5::DOUBLE AS hi FROM h GROUP BY 1, 2)
SELECT g.series_id, epoch(g.time)::BIGINT AS time, CASE WHEN b.hi IS NULL THEN false ELSE g.value > b.hi END AS outlier FROM g ASOF LEFT JOIN b ON g.series_id = b.series_id AND g.time >= b.time""")
def outlier_minmax_series(spark, d):
    h = hours(spark, d)
    bound = h.groupBy("series_id", (F.date_trunc("day", "time") + F.expr("INTERVAL 6 HOURS")).alias("time")).agg((F.avg("value") * 1.5).alias("value"))
    return ou.min_max_outliers(holes(spark, d), K, high_series=bound).select("series_id", "time", "outlier")


@query(f"WITH {HOURS}, z AS (SELECT series_id, time, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM h WINDOW w AS (PARTITION BY series_id)) SELECT series_id, {T}, abs(z) >= 1.5 AS outlier FROM z")
def outlier_zscore(spark, d):
    return ou.zscore_outliers(hours(spark, d), K, 1.5).select("series_id", "time", "outlier")


@query(f"""WITH {HOURS}, z AS (SELECT series_id, time, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z, row_number() OVER o AS rn FROM h WINDOW w AS (PARTITION BY series_id ORDER BY time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), o AS (PARTITION BY series_id ORDER BY time)),
y AS (SELECT series_id, time, CASE WHEN rn = 1 THEN lead(z) OVER (PARTITION BY series_id ORDER BY time) ELSE z END AS z FROM z) SELECT series_id, {T}, abs(z) >= 1.2 AS outlier FROM y""")
def outlier_zscore_rolling(spark, d):
    return ou.zscore_outliers(hours(spark, d), K, 1.2, window="5H").select("series_id", "time", "outlier")


@query("SELECT c_custkey, c_acctbal < 0 OR c_acctbal > 5000 AS inclusive, c_acctbal <= 0 OR c_acctbal >= 5000 AS exclusive FROM customer")
def static_minmax(spark, d):
    c = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", ou.static_min_max(c, 0, 5000).alias("inclusive"), ou.static_min_max(c, 0, 5000, False, False).alias("exclusive"))


@query("SELECT p_partkey, regexp_matches(p_type, '^S') OR regexp_matches(p_type, 'L$') AS hit, NOT (regexp_matches(p_type, '^S') OR regexp_matches(p_type, 'L$')) AS miss FROM part")
def static_regex(spark, d):
    p = ["^S", "L$"]
    return table(spark, d, "part").select("p_partkey", ou.static_regexp(F.col("p_type"), p).alias("hit"), ou.static_regexp(F.col("p_type"), p, True).alias("miss"))


@query(f"""WITH {HOURS}, l AS (SELECT series_id, timezone('Europe/Madrid', timezone('UTC', time)) AS t, value FROM h), x AS (SELECT series_id, t::DATE AS date, hour(t) AS h, sum(value) AS v FROM l GROUP BY ALL),
s AS (SELECT *, sum(v) OVER (PARTITION BY series_id, date) AS total FROM x), y AS (SELECT series_id, date, list((h, round(v / total * 100, 5)) ORDER BY h) AS k, max(total) AS total FROM s GROUP BY ALL),
z AS (SELECT *, quantile_cont(total, 0.1) OVER (PARTITION BY series_id) AS q, {', '.join(f'coalesce(lag(k, {n}) OVER w = k, FALSE) AS s{n}' for n in (1, 3, 7))} FROM y WINDOW w AS (PARTITION BY series_id ORDER BY date)) SELECT series_id, strftime(date, '%Y-%m-%d') AS date, (s1 OR s3 OR s7) AND total > q AS profiled FROM z""")
def profiled_days(spark, d):
    return ou.profiled_days(hours(spark, d), K, "Europe/Madrid")


@query()
def outlier_calendar_model(spark, d):
    return ou.calendar_model_outliers(hours(spark, d), K, window="P1M")


_TOPS = ", ".join(f"max(CASE WHEN isodow(date) = {k + 1} THEN value END) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 44 PRECEDING AND 45 FOLLOWING) AS m{k}" for k in range(7))
_HELD = ", ".join(f"last_value(m{k} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m{k}" for k in range(7))
_ALL = ", ".join(f"m{k}" for k in range(7))


@query(f"""WITH {HOURS}, y AS (SELECT series_id, time::DATE AS date, avg(value) * 24 AS value FROM h GROUP BY ALL), t AS (SELECT *, {_TOPS} FROM y), k AS (SELECT series_id, date, value, {_HELD} FROM t),
l AS (SELECT *, CASE WHEN (greatest({_ALL}) - least({_ALL})) / least({_ALL}) > 0.5 THEN least({_ALL}) ELSE 0 END AS limit_ FROM k) SELECT series_id, strftime(date, '%Y-%m-%d') AS date, {r('value', 'value')}, {r('limit_', '"limit"')}, value <= limit_ AS low FROM l""")
def outlier_low_days(spark, d):
    return ou.low_days(hours(spark, d), K, "UTC")


# ---- filling and integrating

_FILL = f"""WITH {HOLES}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time) AS rn FROM g),
p AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS p, first_value(value IGNORE NULLS) OVER a AS x, last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS pr, first_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS xr,
last_value(CASE WHEN value IS NOT NULL THEN epoch(time) END IGNORE NULLS) OVER b AS pt, first_value(CASE WHEN value IS NOT NULL THEN epoch(time) END IGNORE NULLS) OVER a AS xt
FROM r WINDOW b AS (PARTITION BY series_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_id, {T}, """


@query(_FILL + r("coalesce(value, p)", "value") + " FROM p")
def fill_forward(spark, d):
    return fi.fill_series(holes(spark, d), K, "forward").drop("n")


@query(_FILL + r("coalesce(value, x)", "value") + " FROM p")
def fill_backward(spark, d):
    return fi.fill_series(holes(spark, d), K, "backward").drop("n")


_LINE = "coalesce(value, CASE WHEN xr > pr THEN p + (x - p) * (rn - pr) / (xr - pr) END, p, x)"


@query(_FILL + r(_LINE, "value") + " FROM p")
def fill_linear(spark, d):
    return fi.fill_series(holes(spark, d), K, "linear").drop("n")


@query(_FILL + r(f"CASE WHEN value IS NOT NULL THEN value WHEN xt - pt <= 7200 THEN {_LINE} END", "value") + " FROM p")
def fill_maxgap(spark, d):
    return fi.fill_series(holes(spark, d), K, "linear", max_gap="2H").drop("n")


@query(f"WITH {HOURS}, c AS (SELECT series_id, time, sum(n) OVER (PARTITION BY series_id ORDER BY time) % 1000 AS value FROM h), l AS (SELECT *, lead(value) OVER (PARTITION BY series_id ORDER BY time) AS x FROM c) SELECT series_id, {T}, {r('CASE WHEN x < value THEN CASE WHEN value = 0 THEN 0 ELSE pow(10, ceil(round(log10(value), 12))) END - value + x ELSE x - value END', 'value')} FROM l")
def integrate_cumulative(spark, d):
    from pyspark.sql import Window

    h = hours(spark, d)
    c = h.select("series_id", "time", (F.sum("n").over(Window.partitionBy("series_id").orderBy("time")) % 1000).cast("double").alias("value"))
    return fi.integrate_readings(c, K, "cumulative")


@query(f"WITH {HOURS} SELECT series_id, {T}, {r('lead(value) OVER (PARTITION BY series_id ORDER BY time)', 'value')} FROM h")
def integrate_onchange(spark, d):
    return fi.integrate_readings(hours(spark, d), K, "onChange").drop("n")


@query(f"WITH {HOURS}, f AS (SELECT series_id, time, CASE WHEN epoch(time) - epoch(lag(time) OVER (PARTITION BY series_id ORDER BY time)) > 7200 THEN 1 ELSE 0 END AS b FROM h) SELECT series_id, {T}, (sum(b) OVER (PARTITION BY series_id ORDER BY time))::BIGINT AS island FROM f")
def gap_islands(spark, d):
    return fi.gap_islands(hours(spark, d), K, "PT2H").select("series_id", "time", "island")


# ---- features

_L = "timezone('Europe/Madrid', timezone('UTC', ts))"


@query(f"""WITH l AS (SELECT event_id, {_L} AS l FROM events) SELECT event_id, isodow(l)::BIGINT AS weekday, dayofyear(l)::BIGINT AS "dayYear", isodow(l) >= 6 AS "isWeekend", strftime(l, '%Y-%m-%d') IN ('2024-01-01', '2024-01-06') AS "isHolidays", year(l)::BIGINT AS year, quarter(l)::BIGINT AS quarter,
CASE WHEN strftime(l, '%m%d') >= '1215' OR strftime(l, '%m%d') < '0315' THEN 'Winter' WHEN strftime(l, '%m%d') < '0615' THEN 'Spring' WHEN strftime(l, '%m%d') < '0915' THEN 'Summer' ELSE 'Fall' END AS season,
month(l)::BIGINT AS month, hour(l)::BIGINT AS hour, ceil((hour(l) + 1) / 3.0)::BIGINT AS "hourBy3", ceil((hour(l) + 1) / 8.0)::BIGINT AS "hourBy8", (hour(l) + 24 * (isodow(l) - 1))::BIGINT AS weekhour, minute(l)::BIGINT AS minute, floor(second(l))::BIGINT AS second FROM l""")
def calendar_components(spark, d):
    c = fe.calendar_components(table(spark, d, "events"), "Europe/Madrid", "ts", ["2024-01-01", "2024-01-06"])
    return c.select("event_id", "weekday", "dayYear", "isWeekend", "isHolidays", "year", "quarter", "season", "month", "hour", "hourBy3", "hourBy8", "weekhour", "minute", "second")


@query("""WITH d AS (SELECT unnest(generate_series(date_trunc('month', min(ts)), last_day(max(ts))::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM events)
SELECT strftime(date_trunc('month', d), '%Y-%m-%d') AS month, sum(CASE WHEN isodow(d) >= 6 OR strftime(d, '%Y-%m-%d') IN ('2024-01-01', '2024-01-06') THEN 1 ELSE 0 END)::BIGINT AS "holidaysPerMonth" FROM d GROUP BY 1""")
def holidays_per_month(spark, d):
    return fe.free_days_per_month(table(spark, d, "events").select(F.to_date("ts").alias("date")), ["2024-01-01", "2024-01-06"])


@query("WITH x AS (SELECT event_id, hour(ts) / ((SELECT max(hour(ts)) FROM events) + 1.0::DOUBLE) AS x FROM events) SELECT event_id, " + ", ".join(r(f"{f}(2 * pi() * {i} * x)", f"h_{f}_{i}") for i in (1, 2) for f in ("sin", "cos")) + ", 1.0::DOUBLE AS h_fs_int FROM x")
def fourier(spark, d):
    e = table(spark, d, "events").select("event_id", F.hour("ts").alias("h"))
    return fe.fourier_components(e, ["h"], 2)[0].drop("h")


@query(f"WITH {HOURS} SELECT series_id, {T}, " + ", ".join(r(f"lag(value, {k}) OVER (PARTITION BY series_id ORDER BY time)", f"value_l{k}") for k in (1, 2, 24)) + " FROM h")
def lags(spark, d):
    return fe.lag_components(hours(spark, d), K, ["value"], [1, 2, 24]).drop("n", "value")


@query(f"WITH {HOURS}, o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time) AS rn FROM h) SELECT series_id, {T}, {r('0.5::DOUBLE * pow(0.5::DOUBLE, rn) * sum(value * pow(2.0::DOUBLE, rn)) OVER (PARTITION BY series_id ORDER BY time)', 'value_lpf')} FROM o")
def lpf(spark, d):
    return fe.low_pass(hours(spark, d), K, ["value"], 0.5, chunk="P3D").select("series_id", "time", "value_lpf")


@query(f"SELECT event_id, {r('CASE WHEN value < 40 THEN 40 + 2 - value ELSE 0 END', 'heating')}, {r('least(CASE WHEN value > 50 THEN value - (50 - 2) ELSE 0 END, 30)', 'cooling')} FROM events")
def degree_raw(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", fe.degree_raw(v, F.lit(40.0), "heating").alias("heating"), fe.degree_raw(v, F.lit(50.0), "cooling", most=30.0).alias("cooling"))


_DD = f"WITH {HOURS}, t AS (SELECT series_id, date_trunc('day', time) AS time, avg(value) AS v FROM h GROUP BY 1, 2) SELECT series_id, epoch(date_trunc('{{}}', time))::BIGINT AS time, " + ", ".join(r(f"sum(CASE WHEN v > {b} THEN v - {b} + 2 ELSE 0 END)", f'"degreeDays{b}"') for b in (40, 50)) + " FROM t GROUP BY series_id, date_trunc('{}', time)"


@query(_DD.format("day", "day"))
def degree_days_day(spark, d):
    return fe.degree_days(hours(spark, d), K, "value", [40, 50], "cooling", "UTC")


@query(_DD.format("month", "month"))
def degree_days_month(spark, d):
    return fe.degree_days(hours(spark, d), K, "value", [40, 50], "cooling", "UTC", "P1M")


@query(f"SELECT event_id, {r('(pow(value, 0.3::DOUBLE) - 1) / 0.3::DOUBLE', 'y')}, {r('value', 'x')}, {r('ln(value)', 'l')} FROM events")
def boxcox(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", fe.boxcox(v, 0.3).alias("y"), fe.boxcox_inverse(fe.boxcox(v, 0.3), 0.3).alias("x"), fe.boxcox(v, 0).alias("l"))


@query("""WITH g AS (SELECT unnest(list_transform(range(81), lambda i: -2 + 4 * i / 80.0)) AS l), x AS (SELECT value FROM events WHERE value > 0), n AS (SELECT count(*) AS n, sum(ln(value)) AS s FROM x),
v AS (SELECT l, var_pop(CASE WHEN abs(l) < 1e-9 THEN ln(value) ELSE (pow(value, l) - 1) / l END) AS v FROM g, x GROUP BY l) SELECT round(arg_max(l, -(n / 2.0) * ln(v) + (l - 1) * s), 6) + 0.0 AS lambda FROM v, n""")
def boxcox_lambda(spark, d):
    e = table(spark, d, "events")
    return e.agg(F.lit(fe.boxcox_lambda(e, "value")).alias("lambda"))


@query(f"SELECT event_id, {r('(value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ())', 'value')} FROM events")
def normalise_range(spark, d):
    return fe.normalise_range(table(spark, d, "events").select("event_id", "value"), ["value"])[0]


@query(f"SELECT event_id, {r('(value - avg(value) OVER ()) / stddev_samp(value) OVER ()', 'value')} FROM events")
def normalise_zscore(spark, d):
    return fe.normalise_zscore(table(spark, d, "events").select("event_id", "value"), ["value"])[0]


@query(f"""WITH {HOLES}, l AS (SELECT *, timezone('Europe/Madrid', timezone('UTC', time))::DATE AS day FROM g) SELECT series_id, {T},
{r('CASE WHEN count(value) OVER w = count(*) OVER w THEN value / sum(value) OVER w END', 'value')} FROM l WINDOW w AS (PARTITION BY series_id, day)""")
def normalise_daily(spark, d):
    return fe.normalise_daily(holes(spark, d), K, "value", "Europe/Madrid").drop("n")


# ---- load curves


@query("WITH d AS (SELECT event_type AS series_id, ts::DATE AS day, hour(ts) // 6 AS part, sum(value) AS v FROM events GROUP BY 1, 2, 3) SELECT series_id, strftime(day, '%Y-%m-%d') AS date, " + ", ".join(r(f"sum(CASE WHEN part = {k} THEN v END) / sum(v)", f"part_{k:02d}") for k in range(4)) + " FROM d GROUP BY series_id, day")
def load_curve_pivot(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("time"), "value")
    return pf.load_curve_matrix(e, K, "UTC", 4, relative=True)


_CURVE = "WITH d AS (SELECT event_type AS series_id, ts::DATE AS day, hour(ts) // 6 AS part, sum(value) AS v FROM events GROUP BY 1, 2, 3), m AS (SELECT series_id, day, " + ", ".join(f"sum(CASE WHEN part = {k} THEN v END) / sum(v) AS p{k}" for k in range(4)) + " FROM d GROUP BY 1, 2), c AS (SELECT series_id AS s, " + ", ".join(f"avg(p{k}) AS c{k}" for k in range(4)) + " FROM m GROUP BY 1), "


@query(_CURVE + "x AS (SELECT series_id, day, s, sqrt(" + " + ".join(f"pow(p{k} - c{k}, 2)" for k in range(4)) + ") AS dist FROM m, c WHERE " + " AND ".join(f"p{k} IS NOT NULL" for k in range(4)) + f"), y AS (SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY dist, s) AS rn FROM x) SELECT series_id, strftime(day, '%Y-%m-%d') AS date, s, {r('dist', 'distance')} FROM y WHERE rn = 1")
def centroid_classify(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("time"), "value")
    m = pf.load_curve_matrix(e, K, "UTC", 4, relative=True)
    parts = [c for c in m.columns if c.startswith("part_")]
    centres = m.groupBy(F.col("series_id").alias("s")).agg(*[F.avg(c).alias(c) for c in parts])
    return pf.nearest_centroid(m, centres, parts, "s").where(F.col("s").isNotNull()).select("series_id", "date", "s", "distance")


@query()
def clustering(spark, d):
    c = table(spark, d, "load_curves")
    return pf.cluster_days(c.select("buildingsubject", "curve_id", "qe"), "buildingsubject", "curve_id", "qe")


# ---- indicators

_C, _B, _A, _F = "l_quantity", "l_quantity * 1.1", "(p_size)", "l_tax"


@query(f"""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {r('l_quantity', '"EnergyUse"')}, {r('l_quantity / p_size', '"EnergyUseIntensity"')}, {r('l_quantity * 1.1::DOUBLE - l_quantity', '"EnergyUseSavings"')}, {r('(l_quantity * 1.1::DOUBLE - l_quantity) * 100 / l_quantity', '"EnergyUseSavingsRelative"')},
{r('(l_quantity * 1.1::DOUBLE - l_quantity) / p_size', '"EnergyUseSavingsIntensity"')}, {r('l_quantity * l_tax', '"EnergyEmissions"')}, {r('(l_quantity * 1.1::DOUBLE - l_quantity) * l_tax', '"EnergyEmissionsSavings"')} FROM lineitem JOIN part ON l_partkey = p_partkey""")
def kpi_rows(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    c, b, a, f = F.col("l_quantity"), F.col("l_quantity") * 1.1, F.col("p_size").cast("double"), F.col("l_tax")
    names = ["EnergyUse", "EnergyUseIntensity", "EnergyUseSavings", "EnergyUseSavingsRelative", "EnergyUseSavingsIntensity", "EnergyEmissions", "EnergyEmissionsSavings"]
    return x.select("l_orderkey", "l_linenumber", *[kp.indicator(n, c, b, a, f).alias(n) for n in names])


def _longitudinal(trunc: str, length: str, name: str) -> str:
    return f"""SELECT series_id, 'EnergyUse' AS indicator, '{name}' AS frequency, strftime(date_trunc('{trunc}', time), '%Y-%m-%dT%H:%M:%SZ') AS start, strftime(date_trunc('{trunc}', time) + INTERVAL 1 {trunc} - INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%SZ') AS "end",
{r(f'avg(value) * ({length})', 'value')}, count(*) = ({length}) AS "isReal", sha256(series_id || '~EnergyUse~{name}') AS id FROM h GROUP BY series_id, date_trunc('{trunc}', time) HAVING count(*) > ({length}) * 0.75"""


@query(f"WITH {HOURS} {_longitudinal('day', '24', 'P1D')} UNION ALL {_longitudinal('month', 'max(day(last_day(time))) * 24', 'P1M')}")
def kpi_longitudinal(spark, d):
    return kp.longitudinal_indicators(hours(spark, d), K, {"EnergyUse": F.col("value")}, ["P1D", "P1M"])


# ---- joins and formulas


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY")
def range_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("o_end"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    return jo.range_join(li, o, "o_orderkey", "l_shipdate", "o_orderdate", "o_end").select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "o_custkey")


@query(f"""WITH {HOURS}, m AS (SELECT series_id, time, value AS coef FROM h WHERE (epoch(time)::BIGINT // 3600) % 7 = 0),
x AS (SELECT h.series_id, h.time, b.coef AS bc, b.time AS bt FROM h ASOF LEFT JOIN m b ON h.series_id = b.series_id AND h.time >= b.time), y AS (SELECT x.*, a.coef AS ac, a.time AS nt FROM x ASOF LEFT JOIN m a ON x.series_id = a.series_id AND x.time <= a.time)
SELECT series_id, {T}, {r('CASE WHEN nt IS NULL OR epoch(time) - epoch(bt) <= epoch(nt) - epoch(time) THEN bc ELSE ac END', 'coef')} FROM y""")
def nearest_asof(spark, d):
    h = hours(spark, d)
    m = h.where(F.floor(F.unix_timestamp("time") / 3600) % 7 == 0).select("series_id", "time", F.col("value").alias("coef"))
    return jo.nearest_join(h, m, K, ["coef"]).select("series_id", "time", "coef")


@query(_FILL + r("x", "value") + " FROM p")
def next_known(spark, d):
    return jo.next_known(holes(spark, d), K, "value").drop("n")


@query(f"""WITH {HOURS}, w AS (SELECT time, sum(CASE WHEN series_id = 'click' THEN value END) AS a, sum(CASE WHEN series_id = 'view' THEN value END) AS b FROM h WHERE series_id IN ('click', 'view') GROUP BY 1)
SELECT {T}, {r('coalesce(a, CASE WHEN b IS NOT NULL THEN 0 END) + coalesce(b * 2, CASE WHEN a IS NOT NULL THEN 0 END)', 'value')} FROM w""")
def formula_aggregator(spark, d):
    return jo.aggregate_formula(hours(spark, d), "<mi>click</mi><mo>+</mo><mi>view</mi><mo>*</mo><mn>2</mn>", "series_id")


@query(f"""WITH {HOLES}, a AS (SELECT series_id, date_trunc('day', time) AS time, sum(value) AS s, count(value) * 3600 / 86400.0::DOUBLE AS q FROM g GROUP BY 1, 2) SELECT series_id, {T}, {r('s / q', '"SUM"')} FROM a WHERE q >= 0.7""")
def ratio_correction(spark, d):
    return jo.ratio_correction(rs.align_time_grid(holes(spark, d), K, "P1D", ["SUM"], "PT1H")).select("series_id", "time", "SUM")


# ---- graph


def triples(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as a graph."""
    none = spark.createDataFrame([], gr.SCHEMA)
    uri = lambda kind, c: F.concat(F.lit(f"http://x.org/{kind}#"), F.col(c).cast("string"))
    n = table(spark, d, "nation").select(uri("n", "n_nationkey").alias("s"), "n_name", uri("r", "n_regionkey").alias("r"))
    c = table(spark, d, "customer").select(uri("c", "c_custkey").alias("s"), "c_mktsegment", uri("n", "c_nationkey").alias("n"), "c_acctbal")
    g = gr.add_item(none, n, "s", ["x:Nation"], {"x:name": "n_name"}, {"x:in": "r"})
    return gr.add_item(g, c, "s", ["x:Customer"], {"x:segment": "c_mktsegment", "x:balance": "c_acctbal"}, {"x:of": "n"})


@query("SELECT 'http://x.org/c#' || c_custkey AS c, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def graph_bgp(spark, d):
    return gr.match(triples(spark, d), [("?n", "x:in", "http://x.org/r#1"), ("?c", "x:of", "?n"), ("?n", "x:name", "?name")]).select("c", "name")


@query("SELECT 'http://x.org/n#' || n_nationkey AS n, n_name AS name, CASE WHEN c_mktsegment IS NOT NULL THEN 'http://x.org/c#' || c_custkey END AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING'")
def graph_optional(spark, d):
    t = triples(spark, d)
    return gr.optional(gr.match(t, [("?n", "x:name", "?name")]), t, [("?c", "x:of", "?n"), ("?c", "x:segment", "BUILDING")]).select("n", "name", "c")


@query("SELECT 'http://x.org/n#' || n_nationkey AS x, n_name AS name, NULL::VARCHAR AS segment FROM nation UNION ALL SELECT 'http://x.org/c#' || c_custkey, NULL, c_mktsegment FROM customer")
def graph_union(spark, d):
    t = triples(spark, d)
    return gr.union(gr.match(t, [("?x", "x:name", "?name")]), gr.match(t, [("?x", "x:segment", "?segment")])).select("x", "name", "segment")


@query("WITH x AS (SELECT 'http://x.org/n#' || c_nationkey AS n, 'http://x.org/c#' || c_custkey AS c, c_acctbal AS b FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY b DESC, c DESC) AS rn FROM x) SELECT n, c FROM k WHERE rn = 1")
def graph_latest(spark, d):
    got = gr.match(triples(spark, d), [("?c", "x:of", "?n"), ("?c", "x:balance", "?b")]).withColumn("b", F.col("b").cast("double"))
    return gr.latest(got, ["n"], "b").select("n", "c")


@query("SELECT '<http://x.org/n#' || n_nationkey || '> <x:name> \"' || n_name || '\" .' AS value FROM nation")
def graph_ntriples(spark, d):
    return gr.ntriples(triples(spark, d).where("p = 'x:name'"))


@query("""SELECT 'n:' || n_nationkey || ' <x:in> <http://x.org/r#' || n_regionkey || '> ;\n    <x:name> "' || n_name || '" ;\n    a <x:Nation> .' AS value FROM nation
UNION ALL SELECT 'c:' || c_custkey || ' <x:balance> "' || c_acctbal || '"^^<http://www.w3.org/2001/XMLSchema#double> ;\n    <x:of> n:' || c_nationkey || ' ;\n    <x:segment> "' || c_mktsegment || '" ;\n    a <x:Customer> .' FROM customer""")
def graph_turtle(spark, d):
    return gr.turtle(triples(spark, d), {"n": "http://x.org/n#", "c": "http://x.org/c#"})


@query("SELECT c_custkey, 'xorg/c' || c_custkey AS id, 'http://x.org/c#' || c_custkey AS uri FROM customer")
def uri_identifier(spark, d):
    short = F.concat(F.lit("c:"), F.col("c_custkey").cast("string"))
    full = gr.expand(short, {"c": "http://x.org/c#"})
    return table(spark, d, "customer").select("c_custkey", gr.uri_identifier(full).alias("id"), full.alias("uri"))


@query("SELECT l_suppkey, " + ", ".join(f"sum(CASE WHEN l_returnflag = '{v}' THEN 1 ELSE 0 END)::BIGINT AS \"{v}\"" for v in "ANR") + " FROM lineitem GROUP BY 1")
def onehot_groups(spark, d):
    return gr.dummy_matrix(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"])


@query("WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS p FROM part) SELECT p_partkey, unnest(list_transform(range(1, len(p) + 1), lambda k: array_to_string(list_slice(p, 1, k), ' '))) AS path FROM s")
def hierarchy_explode(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(gr.hierarchy_paths(F.col("p_name"), " ")).alias("path"))


@query("SELECT DISTINCT l_linenumber::BIGINT AS hours, l_linenumber || ' hour' || CASE WHEN l_linenumber = 1 THEN '' ELSE 's' END || ', 30 mins' AS text FROM lineitem")
def period_text(spark, d):
    names: Column = F.lit(None).cast("string")
    for k in range(1, 8):
        names = F.when(F.col("l_linenumber") == k, Period.parse(f"PT{k}H30M").text()).otherwise(names)
    return table(spark, d, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("hours"), names.alias("text")).distinct()


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def iso8601z(spark, d):
    return table(spark, d, "events").select("event_id", iso_z(F.col("ts")).alias("iso"))


def queries() -> dict:
    from gridlake.plans import models, profiles, registry, relational, sensors, storage  # noqa: F401 - they add their queries

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return SQL
