"""Timestamps in mixed notations and zones to one instant in UTC.

Each value may be read in several ways. A mixture of readings is fitted per source and notation by
expectation-maximisation: every reading a value admits has a likelihood (how long before its
delivery the instant would lie), the shares of the readings are re-estimated from the posteriors,
and the most probable reading wins. The convention of day and month is the prior of the shares,
with the weight of so many lines. Values are reduced to counts per source, notation and
likelihoods before the iterations, so these touch a few numbers per source and never the rows.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.runtime import BROADCAST_GROUPS, cut, require

# Offsets in minutes of the zone abbreviations loggers write.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "COT": -300, "BRT": -180, "ART": -180,
}
# Roots of zone names that are places in the Americas.
AMERICAS = r"^(America/|US/|Canada/|Brazil/|Mexico/|Chile/|Cuba$|Jamaica$|Navajo$|EST5EDT$|CST6CDT$|MST7MDT$|PST8PDT$)"
# Month names by number.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_OFF = r"(?:\s*(Z|[A-Z]{2,5}|[+\-]\d{2}:?\d{2}|[+\-]\d{2}))?(?:\[[^\]]*\])?$"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AP])\.?M\.?)?"
# Notation -> its pattern, and its groups as year|month|day|hour|minute|second|fraction|A or P|zone.
NOTATIONS = {
    "iso": (r"^(\d{4})-(\d{2})-(\d{2})[T ]\s*" + _TIME + _OFF, "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "epoch": (r"^(\d{10}|\d{13}|\d{16})$", "$1||||||||"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})" + _OFF, "$1|$2|$3|$4|$5|$6|||$7"),
    "week": (r"^(\d{4})-W(\d{2})-(\d)[T ]" + _TIME + _OFF, "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "ordinal": (r"^(\d{4})-(\d{3})[T ]" + _TIME + _OFF, "$1||$2|$3|$4|$5|$6|$7|$8"),
    "named": (r"^(\d{1,2})[\- ]([A-Z]{3})[A-Z]*[\- ](\d{4}|\d{2})\s+" + _TIME + _OFF, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "dotted": (r"^(\d{1,2})[.\-](\d{1,2})[.\-](\d{4}|\d{2})\s+" + _TIME + _OFF, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "slashed": (r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})\s+" + _TIME + _OFF, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
}
TWO_WAYS = ("slashed", "dotted")  # notations whose day and month may be either way round
EXACT = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\+00:00$"


def zone_names(spark: SparkSession) -> DataFrame:
    """(spelt, zone): every zone of the public zone table under its lower-case spelling.

    The table has some 600 rows whatever the data, so it may be broadcast.
    """
    names = sorted(zoneinfo.available_timezones() - {"localtime", "Factory"})
    rows = [(n.lower(), n) for n in names if "/" in n or len(n) > 1] + [("z", "UTC"), ("utc", "UTC"), ("gmt", "UTC")]
    return spark.createDataFrame(list(dict(rows).items()), "spelt string, zone string")


def source_zones(meta: DataFrame, source: str = "sensorid", zone: str = "addresstimezone") -> DataFrame:
    """One (source, zone) row per source whose zone can be understood.

    Case, blanks and underscores don't matter. Where a source is registered several times the
    spelling that is understood wins, of several zones the alphabetically first. Sources that are
    NULL or have no usable zone get no row.
    """
    spelt = F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.col(zone), r"[\s\u00a0]+", " "))), " ", "_")
    shift = r"^(?:utc|gmt)?([+\-])(\d{1,2})(?::?(\d{2}))?$"
    part = lambda k: F.regexp_extract("spelt", shift, k)
    fixed = F.when(F.col("spelt").rlike(shift) & (F.lpad(part(2), 2, "0") <= "17"), F.concat(part(1), F.lpad(part(2), 2, "0"), F.lit(":"), F.rpad(part(3), 2, "0")))
    return (
        meta.select(F.col(source).alias("source"), spelt.alias("spelt"))
        .where("source IS NOT NULL AND spelt IS NOT NULL")
        .join(F.broadcast(zone_names(meta.sparkSession)), "spelt", "left")
        .select("source", "zone", fixed.alias("fixed"))
        .groupBy("source")
        .agg(F.coalesce(F.min("zone"), F.min("fixed")).alias("zone"))
        .where("zone IS NOT NULL")
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: keeps generated code small where it is used often."""
    return F.transform(F.array(value), body)[0]


def _parsed(text: Column) -> Column:
    """Struct of the ways ``text`` can be read: mdy, dmy (TWO_WAYS), one (all else), off, badzone, abs, family.

    Wall clocks are microseconds as if in UTC. Nothing matches: all are NULL. One regular
    expression rewrites a notation to fields in a common order; the rest is arithmetic.
    """
    clean = F.upper(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\s\u00a0\u2000-\u200b\u202f\u3000\ufeff]+", " "), "[\u2212\u2010-\u2013]", "-")))
    names = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m.upper(), i + 1)])
    epoch = F.lit("1970-01-01").cast("date")

    def split(v: Column) -> Column:
        fields = None
        for name, (pattern, order) in NOTATIONS.items():
            hit = F.when if fields is None else fields.when
            fields = hit(v.rlike(pattern), F.concat(F.lit(name + "|"), F.regexp_replace(v, pattern, order)))
        return F.split(fields, r"\|")

    def numbers(f: Column) -> Column:
        num = lambda k: F.when(f[k] != "", f[k]).try_cast("int")
        fam, zone = f[0], f[9]
        digits = F.regexp_replace(zone, "[^0-9]", "")
        east = F.substring(digits, 1, 2).try_cast("int") * 60 + F.when(F.length(digits) == 4, F.substring(digits, 3, 2).try_cast("int")).otherwise(0)
        h, mi, s = num(4), num(5), F.coalesce(num(6), F.lit(0))
        h = F.when(f[8] == "", h).when((h >= 1) & (h <= 12), h % 12 + F.when(f[8] == "P", 12).otherwise(0))
        micros = F.coalesce(F.rpad(F.substring(f[7], 1, 6), 6, "0").try_cast("bigint"), F.lit(0).cast("bigint"))
        count = F.when(fam == "epoch", f[1].try_cast("bigint"))
        return F.struct(
            fam.alias("fam"),
            (count * F.when(F.length(f[1]) == 10, 1_000_000).when(F.length(f[1]) == 13, 1000).otherwise(1)).alias("abs"),
            F.when(fam != "epoch", num(1) + F.when(num(1) < 100, 2000).otherwise(0)).alias("y"),
            F.when(fam == "named", F.try_element_at(months, f[2])).when(fam != "epoch", num(2)).alias("m"),
            F.when(fam != "epoch", num(3)).alias("d"),
            F.when((h <= 23) & (mi <= 59) & (s <= 59), (h * 3600 + mi * 60 + s).cast("bigint") * 1_000_000 + micros).alias("clock"),
            F.when(F.length(digits) >= 2, F.when(zone.startswith("-"), -east).otherwise(east)).otherwise(F.try_element_at(names, zone)).alias("off"),
            (zone != "").alias("zoned"),
        )

    def ways(x: Column) -> Column:
        fam, y, m, d = x["fam"], F.when(x["y"] >= 1, x["y"]), x["m"], x["d"]

        def date(month: Column, day: Column) -> Column:
            """Days since 1970; NULL where month or day don't exist. The first of a month always does."""
            first = F.make_date(y, F.when((month >= 1) & (month <= 12), month), F.lit(1))
            return F.when((day >= 1) & (day <= F.dayofmonth(F.last_day(first))), F.datediff(first, epoch) + day - 1)

        at = lambda days: days.cast("bigint") * 86_400_000_000 + x["clock"]
        january4 = F.make_date(y, F.lit(1), F.lit(4))
        weeks = F.weekofyear(F.make_date(y, F.lit(12), F.lit(28)))
        week = F.when((m >= 1) & (m <= weeks) & (d >= 1) & (d <= 7), F.datediff(F.trunc(january4, "week"), epoch) + (m - 1) * 7 + d - 1)
        ordinal = F.when((d >= 1) & (d <= F.dayofyear(F.make_date(y, F.lit(12), F.lit(31)))), F.datediff(january4, epoch) + d - 4)
        return F.struct(
            fam.alias("family"), x["abs"].alias("abs"), x["off"].alias("off"),
            F.coalesce(x["zoned"] & x["off"].isNull(), F.lit(False)).alias("badzone"),
            F.when(fam.isin(*TWO_WAYS), at(date(d, m))).alias("mdy"),
            F.when(fam.isin(*TWO_WAYS), at(date(m, d))).alias("dmy"),
            F.when(fam == "week", at(week)).when(fam == "ordinal", at(ordinal)).when(~fam.isin("epoch", *TWO_WAYS), at(date(m, d))).alias("one"),
        )

    return _let(clean, lambda v: _let(split(v), lambda f: _let(numbers(f), ways)))


def readings(df: DataFrame, text: str) -> DataFrame:
    """Add _family, _abs, _off, _badzone, _mdy, _dmy, _one of _parsed() to the rows.

    A generator of one row evaluates the parse once; a projection would be merged into its users.
    """
    names = ("family", "abs", "off", "badzone", "mdy", "dmy", "one")
    return df.select("*", F.inline(F.array(_parsed(F.col(text)))).alias(*["_" + n for n in names]))


def _shares(bins: Column, prior: tuple[float, float], strength: float, rounds: int) -> Column:
    """Struct (other, none) of the shares after ``rounds`` of expectation-maximisation over bins (usual, other, n) of log-likelihoods."""
    total = F.aggregate(bins, F.lit(0.0), lambda acc, b: acc + b["n"])
    start = F.struct(F.lit(prior[0]).alias("other"), F.lit(prior[1]).alias("none"))

    def expect(p: Column) -> Column:
        def add(acc: Column, b: Column) -> Column:
            post = _posterior(b["usual"], b["other"], p)
            return F.struct((acc["other"] + b["n"] * post["other"]).alias("other"), (acc["none"] + b["n"] * post["none"]).alias("none"))

        return F.aggregate(bins, F.struct(F.lit(0.0).alias("other"), F.lit(0.0).alias("none")), add)

    def step(p: Column, _: Column) -> Column:
        return _let(expect(p), lambda e: F.struct(((strength * prior[0] + e["other"]) / (strength + total)).alias("other"), ((strength * prior[1] + e["none"]) / (strength + total)).alias("none")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def _posterior(usual: Column, other: Column, share: Column) -> Column:
    """Struct (usual, other, none) of the readings' probabilities, given log-likelihoods (NULL: impossible) and shares.

    That a value denotes nothing competes only where its usual reading is impossible.
    """
    lik = lambda x: F.coalesce(F.exp(x.cast("double")), F.lit(0.0))
    parts = F.struct(((1 - share["other"] - share["none"]) * lik(usual)).alias("u"), (share["other"] * lik(other)).alias("o"), F.when(usual.isNull(), share["none"]).otherwise(0.0).alias("n"))
    return _let(parts, lambda w: F.struct(*[F.try_divide(w[k], w["u"] + w["o"] + w["n"]).alias(n) for k, n in (("u", "usual"), ("o", "other"), ("n", "none"))]))


def normalise_timestamps(
    df: DataFrame,
    zones: DataFrame,
    text: str = "c0",
    source: str = "series_id",
    received: str | None = "received_ts",
    rounds: int = 12,
    doubt: float = 0.01,
    prior: tuple[float, float] = (1e-4, 1e-2),
    strength: float = 1000.0,
) -> DataFrame:
    """Add utc_us, notation, posterior, ambiguous and exact to every row.

    ``zones``: (source, zone) of source_zones(). utc_us is NULL where the text denotes no instant
    (NULL, empty, words, impossible dates, a date without time). Without zone information the text
    is wall-clock time in the source's zone, UTC where there is none; an hour that occurs twice is
    the first one, a skipped one is read with the offset before the change.

    Dates of day and month in numbers have two readings. The usual one begins with the month in
    dates with slashes of sources in the Americas, else with the day. A value takes the reading
    (usual, other, or none: it denotes nothing) of the highest posterior under the shares of its
    source and notation; ``prior`` are the shares of 'other' and 'none' before any data, which weigh
    as much as ``strength`` lines. A reading's likelihood falls with the days until its delivery as
    (1 + days) ** -1.5, and is e ** -5 if it lies more than a day after its delivery. So a line alone
    never overturns the convention, a date that the usual reading makes impossible denotes nothing,
    but some seven lines of a source that can't have been delivered before they were measured turn
    the source's notation around. ``posterior`` is the probability of the reading taken;
    ``ambiguous`` marks rows with two possible instants whose posterior is under 1 - ``doubt``.

    Extra columns are kept; rows with a NULL source are read in UTC, with the prior shares. The parse
    is written once to the shared folder and read for the fit and for the result.
    """
    require(df, text, source, *([received] if received else []))
    own = list(df.columns)
    rows = readings(df.select(F.struct(*own).alias("_row"), F.col(text).alias("_text"), F.col(source).alias("_source"), (F.col(received) if received else F.lit(None)).cast("timestamp").alias("_received")), "_text")
    info = zones.select(F.col("source").alias("_source"), "zone", F.col("zone").rlike(AMERICAS).alias("_us"))
    rows = cut(rows.select("_row", "_source", "_family", "_abs", "_off", "_badzone", "_mdy", "_dmy", "_one", F.unix_micros("_received").alias("_seen"), F.coalesce(F.col("_text").rlike(EXACT), F.lit(False)).alias("_exact")))
    info = cut(info.where("_source IS NOT NULL"))

    def known(left: DataFrame, right: DataFrame) -> DataFrame:
        """left with the columns of its source: a row per source, sent to all tasks only up to a size."""
        return left.join(F.broadcast(right) if right.count() <= BROADCAST_GROUPS else right, "_source", "left")

    def with_likelihoods(two: DataFrame) -> DataFrame:
        us = (F.col("_family") == "slashed") & F.coalesce("_us", F.lit(False))
        days = lambda w: (F.col("_seen") - w) / 86_400_000_000.0
        fit = lambda w: F.when(w.isNull(), F.lit(None)).when(days(w) < -1, -5).otherwise(F.coalesce(F.round(-1.5 * F.log1p(F.greatest(days(w), F.lit(0.0)))), F.lit(0.0))).cast("int")
        two = two.withColumns({"_usual": F.when(us, F.col("_mdy")).otherwise(F.col("_dmy")), "_other": F.when(us, F.col("_dmy")).otherwise(F.col("_mdy"))})
        return two.withColumns({"_lu": fit(F.col("_usual")), "_lo": fit(F.col("_other"))})

    bins = (
        with_likelihoods(known(rows.where("_source IS NOT NULL AND coalesce(_mdy, _dmy) IS NOT NULL").select("_source", "_family", "_mdy", "_dmy", "_seen"), info))
        .groupBy("_source", "_family", "_lu", "_lo").agg(F.count("*").cast("double").alias("n"))
        .groupBy("_source", "_family").agg(F.collect_list(F.struct(F.col("_lu").alias("usual"), F.col("_lo").alias("other"), "n")).alias("bins"))
    )  # at most some 200 bins a source and notation
    shares = bins.select("_source", F.struct("_family", _shares(F.col("bins"), prior, strength, rounds).alias("share")).alias("e")).groupBy("_source").agg(F.map_from_entries(F.collect_list("e")).alias("_shares"))
    rows = with_likelihoods(known(rows, cut(info.join(shares, "_source", "full"))))
    share = F.coalesce(F.try_element_at("_shares", F.col("_family")), F.struct(F.lit(prior[0]).alias("other"), F.lit(prior[1]).alias("none")))
    rows = rows.select("*", F.inline(F.array(F.when(F.col("_family").isin(*TWO_WAYS), _posterior(F.col("_lu"), F.col("_lo"), share)).otherwise(F.struct(F.lit(1.0).alias("usual"), F.lit(0.0).alias("other"), F.lit(0.0).alias("none"))))).alias("_pu", "_po", "_pn"))
    most = F.greatest("_pu", "_po", "_pn")
    wall = F.coalesce("_one", F.when(F.col("_pu") == most, F.col("_usual")).when(F.col("_po") == most, F.col("_other")))
    zone = F.coalesce("zone", F.lit("UTC"))
    local = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))
    utc = F.coalesce("_abs", F.when(~F.col("_badzone"), F.coalesce(wall - F.col("_off").cast("bigint") * 60_000_000, local)))
    return rows.select(
        *[F.col("_row")[c].alias(c) for c in own],
        utc.alias("utc_us"),
        F.col("_family").alias("notation"),
        F.when(utc.isNotNull(), most).alias("posterior"),
        F.coalesce(utc.isNotNull() & (F.col("_mdy") != F.col("_dmy")) & (most < 1 - doubt), F.lit(False)).alias("ambiguous"),
        F.col("_exact").alias("exact"),
    )
