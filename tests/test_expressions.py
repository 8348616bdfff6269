"""Boundary tables for the scalar rules (constants of the reference behaviour)."""

from __future__ import annotations

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from shiprisk.functions import expressions as X


def one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_vendor_tier_boundaries(spark):
    rates = [0.4999, 0.50, 0.575, 0.6499, 0.65, 0.95]
    got = one(spark, X.vendor_tier("r"), [(r,) for r in rates], "r double")
    assert got == ["POOR", "AVERAGE", "AVERAGE", "AVERAGE", "EXCELLENT", "EXCELLENT"]


def test_adjusted_probability_rules(spark):
    rows = [(0.5, 0.4), (0.5, 0.5), (0.5, 0.65), (0.05, 0.9), (0.95, 0.1), (0.5, 0.575)]
    got = one(spark, X.adjusted_probability("p", "r"), rows, "p double, r double")

    def ref(p, r):
        if r >= 0.65:
            a = p - 0.10
        elif r >= 0.50:
            a = p + (r - 0.50) / (0.65 - 0.50) * (-0.10)
        else:
            a = p + 0.15
        return max(0.0, min(1.0, a))
    assert got == [ref(p, r) for p, r in rows]


def test_country_risk_category_strict(spark):
    # score exactly 8 and exactly 15 fall to the lower class
    rows = [(5.0, 2, 1.0, 0.0), (5.0, 2, 1.0, 0.0001)]  # 3 + 5 = 8 ; a bit over 8
    got = one(spark, X.country_risk_category(X.country_risk_score("l", "t", "g", "p")), rows,
              "l double, t int, g double, p double")
    assert got == ["LOW", "MEDIUM"]
    rows = [(3.0, 4, 1.0, 0.0), (3.0, 4, 1.0, 0.01)]  # 4 + 6 + 5 = 15 ; over 15
    got = one(spark, X.country_risk_category(X.country_risk_score("l", "t", "g", "p")), rows,
              "l double, t int, g double, p double")
    assert got == ["MEDIUM", "HIGH"]


def test_risk_band_half_up(spark):
    rows = [(0.695, None), (0.3949, None), (None, 0.40), (0.70, 0.1), (0.0, 0.9)]
    pct = X.risk_percent("a", "r")
    got = [(r[0], r[1]) for r in spark.createDataFrame(rows, "a double, r double")
           .select(pct, X.risk_band(pct)).collect()]
    assert got == [(70, "HIGH RISK"), (39, "LOW RISK"), (40, "MODERATE"), (70, "HIGH RISK"), (0, "LOW RISK")]


def test_weekday_monday_zero_and_null_defaults(spark):
    rows = [(dt.date(2024, 1, 1),), (dt.date(2024, 1, 7),), (dt.date(2024, 1, 6),), (None,)]
    df = spark.createDataFrame(rows, "d date")
    got = df.select(X.day_of_week("d"), X.month_of("d"), X.is_weekend(X.day_of_week("d"))).collect()
    assert [tuple(r) for r in got] == [(0, 1, 0), (6, 1, 1), (5, 1, 1), (0, 1, 0)]


def test_safe_numeric_defaults(spark):
    rows = [("12",), ("bad",), (None,), ("NaN",), (" 3.5 ",), ("",)]
    got = one(spark, X.safe_numeric("x", 2.0), rows, "x string")
    assert got == [12.0, 2.0, 2.0, 2.0, 3.5, 2.0]
    assert one(spark, X.safe_int("x", 1.0), [("7.9",), ("x",)], "x string") == [7, 1]


def test_parse_order_date(spark):
    rows = [("1/31/2018 22:56",), ("13/1/2018 0:00",), ("unknown",), (None,)]
    got = one(spark, X.parse_order_date("x"), rows, "x string")
    assert got[0] == dt.datetime(2018, 1, 31, 22, 56)
    assert got[1:] == [None, None, None]


def test_sanitize_text(spark):
    rows = [("J&T Express",), ("Kuehne+Nagel",), ("  São-Paulo_2  ",), ("$$$",), ("\tA b\n",)]
    got = one(spark, X.sanitize_text("x"), rows, "x string")
    assert got == ["JT Express", "KuehneNagel", "So-Paulo_2", "", "A b"]


def test_weather_score_rounding_matches_python(spark):
    random.seed(7)
    rows = [(random.uniform(0, 40), random.uniform(0, 90), random.uniform(0, 12)) for _ in range(2000)]
    rows += [(6.28, 10.466666666666667, 1.57), (0.0, 0.0, 0.0), (100.0, 100.0, 100.0), (None, 7.0, None)]
    got = one(spark, X.weather_risk_score("p", "w", "s"), rows, "p double, w double, s double")

    def ref(p, w, s):
        p, w, s = p or 0.0, w or 0.0, s or 0.0
        return round(min(min(p / 30.0, 1.0) * 0.50 + min(w / 70.0, 1.0) * 0.35 + min(s / 10.0, 1.0) * 0.15, 1.0), 4)
    assert got == [ref(*r) for r in rows]


def test_round_half_even_exact_ties(spark):
    vals = [0.03125, 0.5, 1.5, 2.5, 0.35, 0.25, 2.675, 1e-9, 123.45]
    for d in (0, 1, 2, 4):
        got = one(spark, X.round_half_even_exact("x", d), [(v,) for v in vals], "x double")
        assert got == [round(v, d) for v in vals], d


def test_geo_region_first_match(spark):
    rows = [(35.0, 139.0), (1.3, 103.8), (19.0, 72.8), (25.2, 55.3), (51.5, -0.1), (-33.9, 18.4),
            (-33.8, 151.2), (40.7, -74.0), (-23.5, -46.6), (25.0, 65.0), (-20.0, 100.0), (70.0, 170.0)]
    got = one(spark, X.geo_region("a", "b"), rows, "a double, b double")
    assert got == ["east_asia", "sea", "south_asia", "middle_east", "europe", "africa", "australia",
                   "north_america", "south_america", "south_asia", "other", "east_asia"]


def test_geodesic_km(spark):
    got = one(spark, X.geodesic_km("a", "b", "c", "d"), [(0.0, 0.0, 0.0, 90.0), (10.0, 10.0, 10.0, 10.0)],
              "a double, b double, c double, d double")
    assert math.isclose(got[0], math.pi / 2 * 6371.0088, rel_tol=1e-12)
    assert got[1] == 0.0


def test_result_fields(spark):
    rows = [(True, "", 0.0), (False, None, None), (True, "ROUTE", 0.845)]
    df = spark.createDataFrame(rows, "d boolean, r string, v double")
    got = df.select(X.headline("d"), X.reason_display("r"), X.on_time_rate_display("v")).collect()
    assert [tuple(x) for x in got] == [("Delay Likely", "None detected", "N/A"),
                                       ("On-Time Expected", "None detected", "N/A"),
                                       ("Delay Likely", "ROUTE", "85%")]


def test_cross_border_null_text(spark):
    rows = [("US", "US"), (None, None), ("US", None), ("us", "US")]
    got = one(spark, X.cross_border_flag("a", "b"), rows, "a string, b string")
    assert got == [0, 0, 1, 1]
    assert one(spark, F.lit(1), [(1,)], "x int") == [1]


def test_score_assemble_boundaries(spark):
    from shiprisk.models.assemble import score_assemble
    rows = [("a", 0.5, 0.35, 1, 0.9), ("b", 0.4999, 3.0, 2, 0.9), ("c", 0.9, -1.0, 3, 0.55),
            ("d", 0.7, 2.25, 0, 0.3), ("e", 1.0, 0.05, 0, 0.5)]
    df = spark.createDataFrame(rows, "shipment_id string, raw_p double, raw_days double, reason_index int, "
                                     "vendor_on_time_rate double")
    got = {r.shipment_id: r for r in score_assemble(df).collect()}
    assert (got["a"].delay_predicted, got["a"].estimated_delay_days, got["a"].delay_reason) == (True, 0.3, "VENDOR")
    assert (got["b"].delay_predicted, got["b"].estimated_delay_days, got["b"].delay_reason) == (False, 0.0, "")
    assert got["c"].estimated_delay_days == 0.0 and got["c"].delay_reason == "CUSTOMS"
    assert got["d"].estimated_delay_days == round(2.25, 1) and got["d"].vendor_tier == "POOR"
    assert got["d"].adjusted_delay_probability == min(1.0, 0.7 + 0.15)
    assert got["e"].adjusted_delay_probability == 1.0 and got["e"].vendor_tier == "AVERAGE"
    assert got["e"].estimated_delay_days == round(0.05, 1)
    assert got["a"].vendor_tier == "EXCELLENT" and got["a"].adjusted_delay_probability == 0.5 - 0.10
