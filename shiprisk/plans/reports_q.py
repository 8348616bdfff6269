"""Registered aggregate, metric, validation and report queries
(A1, A4-A11, F1, F2, F5, L1, Q1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import aggregates as A
from ..operators import metrics as M
from ..operators import quality as Q
from ..schemas import NUMERIC_FEATURES
from ..sources import testdata as td
from .catalog import register
from .expressions_q import _TRAIN_FIX, _TRAIN_SQL, training_table

AS_OF = "1998-01-01"


@register("table_counts", ["vendor_stats", "route_stats", "country_risk", "holiday_calendar", "trade_lanes",
                           "weather_historical"], """
SELECT t.table_name, t.row_count,
       (SELECT min(row_count) > 0 FROM (
          SELECT count(*) AS row_count FROM vendor_stats UNION ALL SELECT count(*) FROM route_stats
          UNION ALL SELECT count(*) FROM country_risk UNION ALL SELECT count(*) FROM holiday_calendar
          UNION ALL SELECT count(*) FROM trade_lanes) r) AS all_ready
FROM (SELECT 'vendor_stats' AS table_name, count(*) AS row_count FROM vendor_stats
      UNION ALL SELECT 'route_stats', count(*) FROM route_stats
      UNION ALL SELECT 'country_risk', count(*) FROM country_risk
      UNION ALL SELECT 'holiday_calendar', count(*) FROM holiday_calendar
      UNION ALL SELECT 'trade_lanes', count(*) FROM trade_lanes
      UNION ALL SELECT 'weather_historical', count(*) FROM weather_historical) t""")
def q_table_counts(spark, sf):
    """A1: rows per table; ready when the five required tables have rows."""
    tables = {"vendor_stats": td.vendor_stats(spark, sf), "route_stats": td.route_stats(spark, sf),
              "country_risk": td.country_risk(spark, sf), "holiday_calendar": td.holiday_calendar(spark, sf),
              "trade_lanes": td.trade_lanes(spark, sf), "weather_historical": td.weather_historical(spark, sf)}
    return A.table_counts(tables, must_have_rows=list(tables)[:5])


_SCALER_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(CAST({f} AS DOUBLE)) AS mean, "
    f"CASE WHEN min({f}) = max({f}) THEN CAST(1 AS DOUBLE) ELSE stddev_pop(CAST({f} AS DOUBLE)) END AS std FROM train"
    for f in NUMERIC_FEATURES)


@register("fit_scaler", _TRAIN_FIX,
          f"WITH train AS ({_TRAIN_SQL}), s AS ({_SCALER_SQL}) SELECT feature, round(mean, 6) AS mean, "
          f"round(std, 6) AS std FROM s")
def q_fit_scaler(spark, sf):
    """A4: mean and population std per numeric feature (constant -> 1); output to 6 places
    (the last bits of a float sum depend on the summation order)."""
    st = A.fit_scaler(training_table(spark, sf), NUMERIC_FEATURES)
    return st.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("class_weights", _TRAIN_FIX, f"""
WITH train AS ({_TRAIN_SQL})
SELECT delay_flag, count(*) AS n_c,
       CAST((SELECT count(*) FROM train) AS DOUBLE)
         / ((SELECT count(DISTINCT delay_flag) FROM train) * count(*)) AS weight
FROM train GROUP BY delay_flag""")
def q_class_weights(spark, sf):
    """A5: balanced class weights of the delay label."""
    return A.class_weights(training_table(spark, sf), "delay_flag")


@register("accuracy", ["given_scores"], """
SELECT avg(CASE WHEN (raw_p >= 0.5) = (delay_flag = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM given_scores""")
def q_accuracy(spark, sf):
    """Share of rows where the thresholded score equals the label."""
    g = td.given_scores(spark, sf).select((F.col("raw_p") >= 0.5).alias("pred"), (F.col("delay_flag") == 1).alias("y"))
    return M.accuracy(g, "pred", "y")


@register("roc_auc", ["given_scores"], """
WITH s AS (SELECT raw_p AS score, sum(delay_flag) AS pos, sum(1 - delay_flag) AS neg FROM given_scores GROUP BY raw_p),
c AS (SELECT pos, neg, COALESCE(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS below FROM s)
SELECT CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / CAST(2 * sum(pos) * sum(neg) AS DOUBLE) AS auc FROM c""")
def q_roc_auc(spark, sf):
    """Exact mid-rank AUC of the given score against the label."""
    return M.roc_auc(td.given_scores(spark, sf), "raw_p", "delay_flag")


_ROUND1 = X.sql_round_half_even_exact("raw_days", 1)


@register("mae_rmse", ["given_scores"], f"""
SELECT round(avg(abs(greatest(0.0, {_ROUND1}) - delay_days)), 9) AS mae,
       round(sqrt(avg((greatest(0.0, {_ROUND1}) - delay_days) * (greatest(0.0, {_ROUND1}) - delay_days))), 9) AS rmse
FROM given_scores WHERE delay_flag = 1 AND delay_days IS NOT NULL AND delay_days > 0""")
def q_mae_rmse(spark, sf):
    """On the delayed subset (F2), max(0, round(pred, 1)) against true days."""
    m = M.mae_rmse(Q.delayed_subset(td.given_scores(spark, sf)), "raw_days", "delay_days")
    return m.select(F.round("mae", 9).alias("mae"), F.round("rmse", 9).alias("rmse"))  # float sum order varies


@register("build_vendor_stats", ["shipments"], """
SELECT vendor_name,
       avg(CASE WHEN real_days <= scheduled_days THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS on_time_rate,
       avg(greatest(CAST(0 AS DOUBLE), CAST(real_days AS DOUBLE) - CAST(scheduled_days AS DOUBLE))) AS avg_delay_days,
       CAST(count(*) AS INTEGER) AS total_shipments
FROM shipments GROUP BY vendor_name""")
def q_build_vendor_stats(spark, sf):
    """vendor_stats from delivered shipments."""
    return A.build_vendor_stats(td.shipments(spark, sf))


@register("build_route_stats", ["shipments"], """
SELECT origin_city AS origin, destination_city AS destination,
       avg(greatest(CAST(0 AS DOUBLE), CAST(real_days AS DOUBLE) - CAST(scheduled_days AS DOUBLE))) AS avg_delay_days,
       CAST(count(*) AS INTEGER) AS historical_count
FROM shipments GROUP BY origin_city, destination_city""")
def q_build_route_stats(spark, sf):
    """A10: route_stats from delivered shipments."""
    return A.build_route_stats(td.shipments(spark, sf))


@register("geocode_failures", ["shipments"], """
SELECT count(*) FILTER (WHERE CAST(split_part(city, '_', 2) AS INTEGER) % 7 = 3) AS failed, count(*) AS total
FROM (SELECT DISTINCT origin_city AS city, origin_country AS country FROM shipments) p""")
def q_geocode_failures(spark, sf):
    """Cities whose geocode failed, over all (city, country) pairs."""
    from .sources_q import _geo_pairs
    return A.geocode_failures(_geo_pairs(spark, sf))


def _san(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '[^A-Za-z0-9\s_\-]', '', 'g'), '^\s+|\s+$', '', 'g')"


def _len_ok(expr: str, lo: int, hi: int) -> str:
    return f"(length({expr}) >= {lo} AND length({expr}) <= {hi})"


_CHECKS = [
    ("shipment_id_length", _len_ok(_san("shipment_id"), 1, 64)),
    ("vendor_name_length", _len_ok(_san("vendor_name"), 1, 128)),
    ("origin_city_length", _len_ok(_san("origin_city"), 1, 64)),
    ("destination_city_length", _len_ok(_san("destination_city"), 1, 64)),
    ("origin_country_length", _len_ok("origin_country", 2, 64)),
    ("destination_country_length", _len_ok("destination_country", 2, 64)),
    ("departure_before_as_of", f"(planned_departure_date IS NOT NULL AND planned_departure_date >= DATE '{AS_OF}')"),
    ("scheduled_transit_days_range", "(scheduled_transit_days > 0 AND scheduled_transit_days <= 365)"),
    ("cargo_weight_kg_range", "(cargo_weight_kg > 0 AND cargo_weight_kg <= 50000)"),
    ("cargo_volume_m3_range", "(cargo_volume_m3 > 0 AND cargo_volume_m3 <= 200)"),
    ("distance_km_range", "(distance_km > 0 AND distance_km <= 25000)"),
    ("num_stops_range", "(COALESCE(num_stops, 1) >= 0 AND COALESCE(num_stops, 1) <= 50)"),
    ("carrier_type_value", "(carrier_type IN ('FTL', 'LTL', 'Intermodal', 'Ocean', 'Air'))"),
    ("is_hazmat_present", "(is_hazmat IS NOT NULL)"),
    ("priority_level_value", "(priority_level IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL'))"),
    ("temperature_sensitive_present", "(temperature_sensitive IS NOT NULL)"),
]
_ERRORS = "list_filter([" + ", ".join(
    f"CASE WHEN COALESCE({cond}, false) THEN NULL ELSE '{name}' END" for name, cond in _CHECKS) + "], lambda x: x IS NOT NULL)"


@register("validate_shipments", ["requests"], f"""
SELECT shipment_id AS raw_shipment_id, {_san("shipment_id")} AS shipment_id, {_san("vendor_name")} AS vendor_name,
       {_san("origin_city")} AS origin_city, {_san("destination_city")} AS destination_city,
       {_ERRORS} AS errors, len({_ERRORS}) = 0 AS is_valid
FROM requests""")
def q_validate_shipments(spark, sf):
    """every request row with its broken rules (as-of date is a parameter)."""
    r = td.typed_shipments(spark, sf).withColumn("raw_shipment_id", F.col("shipment_id"))
    v = Q.validate_shipments(r, AS_OF)
    return v.select("raw_shipment_id", "shipment_id", "vendor_name", "origin_city", "destination_city",
                    "errors", "is_valid")


@register("delayed_subset", _TRAIN_FIX, f"""
SELECT shipment_id, delay_days FROM ({_TRAIN_SQL}) t
WHERE delay_flag = 1 AND delay_days IS NOT NULL AND delay_days > 0""")
def q_delayed_subset(spark, sf):
    """the regressor's training rows."""
    return Q.delayed_subset(training_table(spark, sf)).select("shipment_id", "delay_days")


@register("point_lookup", ["vendor_stats"], """
SELECT on_time_rate, avg_delay_days, total_shipments FROM vendor_stats
WHERE vendor_name = 'Supplier#000000003'""")
def q_point_lookup(spark, sf):
    """equality lookup in the vendor table (built from all shipments), first row or none."""
    return Q.point_lookup(td.vendor_stats(spark, sf), {"vendor_name": "Supplier#000000003"}).select(
        "on_time_rate", "avg_delay_days", "total_shipments")


@register("first_row", ["vendor_stats", "route_stats", "weather_historical"], """
SELECT 'vendor Supplier#000000003' AS probe,
       EXISTS (SELECT 1 FROM vendor_stats WHERE vendor_name = 'Supplier#000000003') AS found
UNION ALL SELECT 'vendor Supplier#000000007',
       EXISTS (SELECT 1 FROM vendor_stats WHERE vendor_name = 'Supplier#000000007')
UNION ALL SELECT 'route CITY_3 CITY_5',
       EXISTS (SELECT 1 FROM route_stats WHERE origin = 'CITY_3' AND destination = 'CITY_5')
UNION ALL SELECT 'route CITY_35 CITY_5',
       EXISTS (SELECT 1 FROM route_stats WHERE origin = 'CITY_35' AND destination = 'CITY_5')
UNION ALL SELECT 'weather CITY_3 day 13',
       EXISTS (SELECT 1 FROM weather_historical WHERE origin_city = 'CITY_3' AND departure_date LIKE '%-13')""")
def q_first_row(spark, sf):
    """L1: LIMIT 1 existence probes on tables built from the shipments (each reads at most one match)."""
    w = td.weather_historical(spark, sf)
    probes = [
        ("vendor Supplier#000000003", td.vendor_stats(spark, sf), {"vendor_name": "Supplier#000000003"}),
        ("vendor Supplier#000000007", td.vendor_stats(spark, sf), {"vendor_name": "Supplier#000000007"}),
        ("route CITY_3 CITY_5", td.route_stats(spark, sf), {"origin": "CITY_3", "destination": "CITY_5"}),
        ("route CITY_35 CITY_5", td.route_stats(spark, sf), {"origin": "CITY_35", "destination": "CITY_5"}),
        ("weather CITY_3 day 13", w.where(F.col("departure_date").endswith("-13")), {"origin_city": "CITY_3"}),
    ]
    parts = []
    for name, dim, where in probes:
        hit = Q.point_lookup(dim, where)  # limit(1)
        parts.append(hit.agg((F.count(F.lit(1)) > 0).alias("found")).select(F.lit(name).alias("probe"), "found"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("country_risk_report", ["shipments", "country_risk"], """
SELECT q.code AS country_code, c.lpi_score, c.customs_tier, c.geopolitical_risk, c.port_congestion,
       CASE WHEN (5.0 - lpi_score) * 2 + customs_tier * 1.5 + geopolitical_risk * 5.0 + port_congestion * 0.5 > 15
            THEN 'HIGH'
            WHEN (5.0 - lpi_score) * 2 + customs_tier * 1.5 + geopolitical_risk * 5.0 + port_congestion * 0.5 > 8
            THEN 'MEDIUM' ELSE 'LOW' END AS risk_category
FROM (SELECT DISTINCT upper(lower(destination_country)) AS code FROM shipments) q
JOIN country_risk c ON c.country_code = q.code""")
def q_country_risk_report(spark, sf):
    """Q1: per requested code (upper-cased): the four measures and a category; unknown codes give no row."""
    from ..plans.reports import country_risk_report
    asked = td.shipments(spark, sf).select(F.lower("destination_country").alias("code")).distinct()
    return country_risk_report(asked, td.country_risk(spark, sf))
