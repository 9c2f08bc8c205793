"""Imputation, timestamps, grids and faults: small cases, brute force and edge cases."""

import math
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.operators.missing import impute_chained, no_category, no_number
from gridlake.operators.regular import regular_grid
from gridlake.operators.spikes import flag_faults
from gridlake.operators.timestamps import normalise_timestamps, source_zones

BUILDING = "reading_id bigint, sensorid string, buildingsubject string, usetype string, reading_ts timestamp, qe double, temperature double, extra string"


def reading_rows(hours=24 * 28, sensors=2, seed=0):
    rng, rows = np.random.default_rng(seed), []
    for s in range(sensors):
        for h in range(hours):
            t = datetime.fromtimestamp(1_680_000_000 // 3600 * 3600 + h * 3600, UTC)
            q = (5 + 3 * math.sin(2 * math.pi * t.hour / 24)) * 10**s * (1 + 0.03 * rng.normal())
            rows.append([len(rows) + 1, f"s{s}", "b", "Office" if s else "School", t, round(q, 2), round(15 + 6 * math.sin(2 * math.pi * t.hour / 24 + 4) + 0.3 * rng.normal(), 1), "x"])
    return rows


def test_missing_masks(spark):
    df = spark.createDataFrame([(None, None), (float("nan"), " N/D "), (-999.9, ""), (0.0, "Office"), (float("inf"), "unknown")], "v double, w string")
    got = df.select(no_number(F.col("v")).alias("n"), no_category(F.col("w")).alias("c")).collect()
    assert [r.n for r in got] == [True, True, True, False, False] and [r.c for r in got] == [True, True, True, False, True]


def test_imputation_marks_and_restores(spark):
    rows = reading_rows()
    true = {r[0]: (r[5], r[6]) for r in rows}
    for r in rows:
        if r[0] % 17 == 0:
            r[5] = [None, float("nan"), -999.0][r[0] % 3]
        if r[0] % 13 == 0:
            r[6] = [None, 9999.0][r[0] % 2]
        if r[0] % 11 == 0:
            r[3] = [None, "n/d"][r[0] % 2]
    got = impute_chained(spark.createDataFrame(rows, BUILDING), residual=False).collect()
    assert len(got) == len(rows)
    for g in got:
        i = g.reading_id
        assert g.qe_filled == (i % 17 == 0) and g.temperature_filled == (i % 13 == 0) and g.usetype_filled == (i % 11 == 0)
        assert g.usetype == ("School" if i <= len(rows) // 2 else "Office")
        if not g.qe_filled:
            assert g.qe == true[i][0]
    q = [abs(g.qe - true[g.reading_id][0]) / true[g.reading_id][0] for g in got if g.qe_filled]
    t = [abs(g.temperature - true[g.reading_id][1]) for g in got if g.temperature_filled]
    assert np.median(q) < 0.06 and np.median(t) < 0.6


def test_imputation_keeps_variation(spark):
    rows = reading_rows()
    for r in rows:
        if r[0] % 5 == 0:
            r[6] = None
    df = spark.createDataFrame(rows, BUILDING)
    a, b = (sorted((r.reading_id, r.temperature) for r in impute_chained(df).where("temperature_filled").collect()) for _ in range(2))
    flat = sorted((r.reading_id, r.temperature) for r in impute_chained(df, residual=False).where("temperature_filled").collect())
    assert a == b and a != flat and np.std([x[1] for x in a]) >= np.std([x[1] for x in flat]) * 0.99


def test_imputation_edge_cases(spark):
    assert impute_chained(spark.createDataFrame([], BUILDING)).count() == 0
    t = datetime(2023, 1, 1, tzinfo=UTC)
    rows = [(1, None, None, None, None, None, None, None), (2, "s", "b", "Office", t, 5.0, None, "a"), (2, "s", "b", None, t, None, None, "a"), (3, "r", "b", None, t, None, None, "a")]
    got = {(r.reading_id, r.usetype, r.qe, r.temperature, r.qe_filled, r.temperature_filled) for r in impute_chained(spark.createDataFrame(rows, BUILDING), residual=False).collect()}
    assert {g[0] for g in got} == {1, 2, 3} and all(g[1] == "Office" and g[3] is None and not g[5] for g in got)
    assert all(abs(g[2] - 5) < 1e-6 for g in got)


LINES = "line_id bigint, series_id string, c0 string, c1 double, received_ts timestamp, utc_us bigint, zone string"


def instants(spark, texts, zone=None, received=None):
    rows = [(i, "s", t, 1.0, received, None, None) for i, t in enumerate(texts)]
    meta = spark.createDataFrame([("s", zone)], "sensorid string, addresstimezone string")
    df = spark.createDataFrame(rows, LINES).drop("utc_us")
    return [None if r.utc_us is None else datetime.fromtimestamp(r.utc_us / 1e6, UTC) for r in normalise_timestamps(df, source_zones(meta)).orderBy("line_id").collect()]


def test_notations(spark):
    want = datetime(2024, 3, 5, 14, 7, 9, tzinfo=UTC)
    texts = [
        "2024-03-05 14:07:09+00:00", "2024-03-05T14:07:09Z", "2024-03-05t14:07:09z", "20240305T140709Z", "20240305140709", "1709647629", "1709647629000", "2024-W10-2T14:07:09Z", "2024-065T14:07:09Z",
        "05-Mar-2024 14:07:09", "05 Mar 2024 15:07:09 CET", "2024-03-05 15:07:09+0100", "2024-03-05T15:07:09+01:00[Europe/Madrid]", "  2024-03-05 14:07:09\t", "2024-03-05T09:07:09.000000−05:00",
    ]
    assert instants(spark, texts) == [want] * len(texts)
    assert instants(spark, ["05.03.24 14:07", "5/3/2024 2:07 PM", "05/03/2024 14:07"]) == [want.replace(second=0)] * 3
    assert instants(spark, ["3/5/2024 8:07 AM", "03/05/2024 08:07"], "America/Chicago") == [want.replace(second=0)] * 2
    assert instants(spark, ["2024-03-05 14:07:09,250"])[0].microsecond == 250_000


def test_no_instant(spark):
    texts = [None, "", "  ", "n/a", "clock not set", "--:--", "2024-05-17", "2024-02-30 10:00:00+00:00", "2023-13-04T07:00:00Z", "0000-00-00 00:00:00", "2024-11-31 23:61:00", "25/12/2024 13:00 PM", "2024-367T00:00:00Z", "2024-W54-1T00:00:00Z", "x" * 100_000, "2024-03-05 24:01:00", "99999999999999999999"]
    assert instants(spark, texts) == [None] * len(texts)
    assert instants(spark, ["25/12/2024 10:10"], "America/Bogota") == [None]  # the month comes first there


@pytest.mark.parametrize("zone", ["Europe/Madrid", "america/new york", "US/Eastern", "Asia/Kolkata", " EUROPE/BERLIN ", "Australia/Sydney", None, "nowhere", "UTC+3", "+01:00"])
def test_wall_clocks_like_zoneinfo(spark, zone):
    name = {None: "UTC", "nowhere": "UTC", "america/new york": "America/New_York", " EUROPE/BERLIN ": "Europe/Berlin", "UTC+3": "Etc/GMT-3", "+01:00": "Etc/GMT-1"}.get(zone, zone)
    walls = [datetime(2024, m, d, h, 30) for m, d in ((3, 31), (10, 27), (3, 10), (11, 3), (4, 7), (7, 1)) for h in range(5)]
    # zoneinfo with fold=0: the first of two, and the offset before a skipped hour.
    assert instants(spark, [w.strftime("%Y-%m-%d %H:%M:%S") for w in walls], zone) == [w.replace(tzinfo=ZoneInfo(name)).astimezone(UTC) for w in walls]


def test_ambiguity_is_marked_and_columns_clash(spark):
    df = spark.createDataFrame([(1, "s", "3/4/2024 10:00", 1.0, datetime(2024, 3, 4, 12, tzinfo=UTC), 7, "mine"), (2, None, "2024-01-01T00:00:00Z", 1.0, None, 8, "mine")], LINES).drop("utc_us")
    got = normalise_timestamps(df, source_zones(spark.createDataFrame([("s", "Europe/Madrid")], "sensorid string, addresstimezone string")), doubt=1e-12).orderBy("line_id").collect()
    assert got[0].ambiguous and got[0].zone == "mine" and not got[1].ambiguous and got[1].utc_us == 1704067200000000
    assert normalise_timestamps(df.limit(0), source_zones(spark.createDataFrame([], "sensorid string, addresstimezone string"))).count() == 0


@pytest.mark.parametrize("sep, family", [("/", "slashed"), (".", "dotted")])
def test_deliveries_can_turn_a_notation_around(spark, sep, family):
    """Month first in Europe: one line is only marked, twenty that can't have been delivered before they were measured are read so."""
    true = [datetime(2024, m, d, 10, tzinfo=UTC) for m in range(1, 6) for d in range(m + 2, m + 6)]
    zones = source_zones(spark.createDataFrame([("s", "Europe/London")], "sensorid string, addresstimezone string"))
    lines = [(i, "s", t.strftime(f"%m{sep}%d{sep}%Y %H:%M"), 1.0, t) for i, t in enumerate(true)] + [(99, "s", f"06{sep}25{sep}2024 10:00", 1.0, None)]
    schema = "line_id bigint, series_id string, c0 string, c1 double, received_ts timestamp"
    read = lambda rows: {r.line_id: r for r in normalise_timestamps(spark.createDataFrame(rows, schema), zones).collect()}
    many, one = read(lines), read([lines[0], lines[-1]])
    assert {r.notation for r in many.values()} == {family}
    summer = lambda t: 3600 * (t >= datetime(2024, 3, 31, 1, tzinfo=UTC))
    assert all(many[i].utc_us == (t.timestamp() - summer(t)) * 1e6 for i, t in enumerate(true)) and many[99].utc_us is not None
    wrong = true[0].replace(month=true[0].day, day=true[0].month)
    assert one[0].utc_us == (wrong.timestamp() - summer(wrong)) * 1e6 and one[0].ambiguous and one[99].utc_us is None


def brute_grid(points, hold=3600):
    points = sorted(points)
    out = {}
    for (t, v), nxt in zip(points, [p[0] for p in points[1:]] + [points[-1][0] + 1e-6], strict=True):
        h = int(t // 3600)
        while h * 3600 < nxt:
            a, b = max(t, h * 3600), min(nxt, h * 3600 + 3600)
            s = out.setdefault(h, [0.0, 0.0, 0.0])
            s[0] += v * (b - a)
            s[1] += b - a
            s[2] += max(0.0, min(b, t + hold) - a)
            h += 1
    return {h * 3600: (s[0] / s[1], s[2] / 3600) for h, s in out.items()}


def test_grid_against_brute_force(spark):
    rng = np.random.default_rng(3)
    t = np.unique(np.cumsum(rng.integers(1, 9000, 200))) + 1_700_000_000
    points = [(int(x), float(v)) for x, v in zip(t, rng.normal(size=len(t)), strict=True)]
    df = spark.createDataFrame([("a", x * 1_000_000, v) for x, v in points], "series_id string, utc_us bigint, c1 double")
    got = {r.slot_us // 1_000_000: r for r in regular_grid(df, chunk_us=4 * 3_600_000_000).collect()}
    want = brute_grid(points)
    assert set(got) == set(want)
    for h, (v, c) in want.items():
        assert abs(got[h].value - v) < 1e-6 and abs(got[h].coverage - c) < 1e-6
        assert (got[h].mark == "observed") == any(h <= x < h + 3600 for x, _ in points)


def test_grid_edge_cases(spark):
    schema = "series_id string, utc_us bigint, c1 double, value string, mark string"
    assert regular_grid(spark.createDataFrame([], schema)).count() == 0
    rows = [("a", None, 1.0, "", ""), ("a", 0, None, "", ""), ("a", 0, float("nan"), "", ""), (None, 0, 1.0, "", ""), ("b", 10, 2.0, "", ""), ("b", 10, 4.0, "", "")]
    assert [(r.series_id, r.slot_us, r.value, r.readings, r.mark) for r in regular_grid(spark.createDataFrame(rows, schema)).collect()] == [("b", 0, 3.0, 2, "observed")]


def faults(spark, rows, **kw):
    return {(r.reading_id, r.field): r.fault for r in flag_faults(spark.createDataFrame(rows, BUILDING), **kw).collect()}


@pytest.mark.parametrize("chunk", [2016, 504])
def test_faults(spark, chunk):
    rows = reading_rows(24 * 40)
    for i in (200, 201, 500, 1300):
        rows[i][5] *= 20
    rows[700][5] = -3.0
    rows[300][6] = 45.0
    rows[310][6] = -80.0
    for i in range(400, 415):
        rows[i][6] = 11.1
    for i in range(600, 900):
        rows[i][5] = round(rows[i][5] * 4, 2) if rows[i][5] > 0 else rows[i][5]  # a lasting change
    for i in range(240, 264):
        rows[i][6] += 9  # a warm spell
    rows[100][5] = None
    rows[101][5] = -999.0
    rows.append([9999, *rows[500][1:]])  # delivered again
    want = {(201, "qe"): "spike", (202, "qe"): "spike", (501, "qe"): "spike", (9999, "qe"): "spike", (1301, "qe"): "spike", (701, "qe"): "impossible", (301, "temperature"): "spike", (311, "temperature"): "impossible"}
    want |= {(i + 1, "temperature"): "stuck" for i in range(400, 415)}
    assert faults(spark, rows, chunk_hours=chunk) == want


def test_faults_do_not_depend_on_blocks(spark):
    """Months with a change of level, three outages at zero, quiet nights, spikes and a stuck stretch: the same flags in any blocks."""
    rng = np.random.default_rng(4)
    rows = reading_rows(6000)
    for i, r in enumerate(rows):
        r[5] = float(round((3 + np.sin(i / 24 * 2 * np.pi) + 0.1 * rng.normal()) * (8 if i > 3000 else 1), 3))
        if r[4].hour < 3 and i > 4000:
            r[5] = 0.0
    for a, z in ((500, 560), (1990, 2010), (3500, 3530)):
        for i in range(a, z):
            rows[i][5] = 0.0
    for i in (300, 2015, 2016, 2017, 4500):
        rows[i][5] *= 6
    for i in range(2500, 2515):
        rows[i][5] = 2.75
    one = faults(spark, rows, chunk_hours=100_000)
    assert {i for (i, f), kind in one.items() if kind == "stuck" and f == "qe"} == {i + 1 for a, z in ((500, 560), (1990, 2010), (3500, 3530), (2500, 2515)) for i in range(a, z)}
    assert {i for (i, _), kind in one.items() if kind == "spike"} == {301, 2016, 2017, 2018, 4501}
    assert all(faults(spark, rows, chunk_hours=n) == one for n in (504, 2016))


def test_faults_edge_cases(spark):
    assert faults(spark, []) == {}
    t = datetime(2023, 1, 1, tzinfo=UTC)
    rows = [(1, None, "b", "u", t, -1.0, 5.0, ""), (2, "s", "b", "u", None, 5.0, 70.0, ""), (3, "s", "b", "u", t, None, float("nan"), ""), (4, "s", "b", "u", t, 1.0, 1.0, "")]
    assert faults(spark, rows) == {(1, "qe"): "impossible", (2, "temperature"): "impossible"}
    night = reading_rows(24 * 20, 1)
    for r in night:
        if r[4].hour < 11:
            r[5] = 0.0  # draws nothing every night
    assert faults(spark, night) == {}


def test_outages_at_zero_do_not_excuse_each_other(spark):
    rows = reading_rows(24 * 40)
    for r in rows:
        r[5] = max(r[5], 0.5)
    off = {*range(200, 248), *range(500, 560)}
    for i in off:
        rows[i][5] = 0.0
    assert faults(spark, rows) == {(i + 1, "qe"): "stuck" for i in off}
    weekends = reading_rows(24 * 40, 1)
    for r in weekends:
        r[5] = 0.0 if r[4].weekday() >= 5 else max(r[5], 0.5)
    assert faults(spark, weekends) == {}
