"""Registered lookup queries (J1-J9, J12) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich as E
from ..sources import files as FS
from ..sources import testdata as td
from .catalog import register

# Oracle: the scoring-path lookups as plain SQL left joins with COALESCE.
_ENRICH_SQL = """
SELECT r.shipment_id, r.vendor_name, r.origin_city, r.destination_city,
       r.origin_country, r.destination_country, r.planned_departure_date,
       COALESCE(r.cargo_weight_kg, 1.0) AS cargo_weight_kg,
       COALESCE(r.cargo_volume_m3, 1.0) AS cargo_volume_m3,
       COALESCE(r.distance_km, 1.0) AS distance_km,
       CAST(COALESCE(r.num_stops, 0) AS INTEGER) AS num_stops,
       CAST(COALESCE(r.scheduled_transit_days, 2) AS INTEGER) AS planned_transit_days,
       CAST(COALESCE(isodow(r.planned_departure_date) - 1, 0) AS INTEGER) AS departure_day_of_week,
       CAST(COALESCE(month(r.planned_departure_date), 1) AS INTEGER) AS departure_month,
       CAST(COALESCE(isodow(r.planned_departure_date) - 1, 0) IN (5, 6) AS INTEGER) AS departure_is_weekend,
       CAST(COALESCE(r.is_hazmat, false) AS INTEGER) AS is_hazmat,
       CAST(COALESCE(r.temperature_sensitive, false) AS INTEGER) AS temperature_sensitive,
       COALESCE(w.weather_risk_score, 0.1) AS weather_risk_score,
       COALESCE(v.on_time_rate, 0.5) AS vendor_on_time_rate,
       COALESCE(v.avg_delay_days, 2.0) AS vendor_avg_delay_days,
       COALESCE(rs.avg_delay_days, 2.0) AS route_avg_delay_days,
       CAST(COALESCE(r.origin_country, 'US') <> COALESCE(r.destination_country, 'US') AS INTEGER) AS is_cross_border,
       COALESCE(co.lpi_score, 3.0) AS origin_lpi_score,
       COALESCE(cd.lpi_score, 3.0) AS destination_lpi_score,
       CAST(COALESCE(co.customs_tier, 2) AS INTEGER) AS origin_customs_tier,
       CAST(COALESCE(cd.customs_tier, 2) AS INTEGER) AS destination_customs_tier,
       COALESCE(co.geopolitical_risk, 0.2) AS origin_geopolitical_risk,
       COALESCE(cd.geopolitical_risk, 0.2) AS destination_geopolitical_risk,
       COALESCE(cd.port_congestion, 1.0) AS destination_port_congestion,
       CASE WHEN EXISTS (SELECT 1 FROM holiday_calendar h
                         WHERE upper(trim(h.country_code)) = upper(trim(upper(r.origin_country)))
                           AND h.holiday_date = r.planned_departure_date) THEN 1 ELSE 0 END AS is_origin_holiday,
       0 AS is_destination_holiday,
       COALESCE(l.avg_customs_days, 2.5) AS lane_avg_customs_days,
       COALESCE(r.carrier_type, 'FTL') AS carrier_type,
       COALESCE(r.priority_level, 'MEDIUM') AS priority_level
FROM requests r
LEFT JOIN vendor_stats v ON v.vendor_name = r.vendor_name
LEFT JOIN route_stats rs ON rs.origin = r.origin_city AND rs.destination = r.destination_city
LEFT JOIN country_risk co ON upper(trim(co.country_code)) = upper(trim(upper(r.origin_country)))
LEFT JOIN country_risk cd ON upper(trim(cd.country_code)) = upper(trim(upper(r.destination_country)))
LEFT JOIN trade_lanes l ON upper(trim(l.origin_country)) = upper(trim(upper(r.origin_country)))
                       AND upper(trim(l.destination_country)) = upper(trim(upper(r.destination_country)))
LEFT JOIN weather_historical w ON w.origin_city = r.origin_city
                              AND w.departure_date = strftime(r.planned_departure_date, '%Y-%m-%d')
"""
_ENRICH_FIX = ["requests", "vendor_stats", "route_stats", "country_risk", "trade_lanes",
               "holiday_calendar", "weather_historical"]


_PREPARED: dict = {}


def _dims(spark, sf, **options):
    """The dimension tables, prepared for the lookups once per session and options."""
    key = (spark.sparkContext.applicationId, sf, tuple(sorted(options.items())))
    if key not in _PREPARED:
        dims = dict(vendors=td.vendor_stats(spark, sf), routes=td.route_stats(spark, sf),
                    risk=td.country_risk(spark, sf), lanes=td.trade_lanes(spark, sf),
                    holidays=td.holiday_calendar(spark, sf), weather=td.weather_historical(spark, sf))
        _PREPARED[key] = E.prepare_dimensions(FS.scratch_path(spark, "prepared"), **options, **dims)
    return _PREPARED[key]


@register("enrich_shipments", _ENRICH_FIX, _ENRICH_SQL)
def q_enrich_shipments(spark, sf):
    """J12 (flagship): scoring-path enrichment of every shipment."""
    return E.enrich_shipments(td.typed_shipments(spark, sf), **_dims(spark, sf))


@register("join_vendor", ["shipments", "vendor_stats"], """
SELECT s.shipment_id, s.vendor_name,
       COALESCE(v.on_time_rate, 0.5) AS vendor_on_time_rate,
       COALESCE(v.avg_delay_days, 2.0) AS vendor_avg_delay_days,
       COALESCE(v.total_shipments, 0) AS vendor_total_shipments
FROM shipments s LEFT JOIN vendor_stats v ON v.vendor_name = s.vendor_name
""")
def q_join_vendor(spark, sf):
    sh = td.shipments(spark, sf).select("shipment_id", "vendor_name")
    return E.join_vendor(sh, td.vendor_stats(spark, sf))


@register("join_route", ["shipments", "route_stats"], """
SELECT s.shipment_id, s.origin_city, s.destination_city,
       COALESCE(r.avg_delay_days, 2.0) AS route_avg_delay_days,
       COALESCE(r.historical_count, 0) AS route_historical_count
FROM shipments s LEFT JOIN route_stats r ON r.origin = s.origin_city AND r.destination = s.destination_city
""")
def q_join_route(spark, sf):
    sh = td.shipments(spark, sf).select("shipment_id", "origin_city", "destination_city")
    return E.join_route(sh, td.route_stats(spark, sf))


@register("join_country_risk_origin", ["shipments", "country_risk"], """
SELECT s.shipment_id, s.origin_country,
       COALESCE(c.lpi_score, 3.0) AS origin_lpi_score,
       COALESCE(c.customs_tier, 2) AS origin_customs_tier,
       COALESCE(c.geopolitical_risk, 0.2) AS origin_geopolitical_risk
FROM shipments s LEFT JOIN country_risk c ON c.country_code = s.origin_country
""")
def q_join_country_risk_origin(spark, sf):
    """J3 as in the training path: no case change, exact key."""
    sh = td.shipments(spark, sf).select("shipment_id", "origin_country")
    return E.join_country_risk(sh, td.country_risk(spark, sf), "origin_country", "origin",
                               strict_case=True, upper_fact=False)


@register("join_country_risk_destination", ["shipments", "country_risk"], """
SELECT s.shipment_id, s.destination_country,
       COALESCE(c.lpi_score, 3.0) AS destination_lpi_score,
       COALESCE(c.customs_tier, 2) AS destination_customs_tier,
       COALESCE(c.geopolitical_risk, 0.2) AS destination_geopolitical_risk,
       COALESCE(c.port_congestion, 1.0) AS destination_port_congestion
FROM shipments s LEFT JOIN country_risk c ON c.country_code = s.destination_country
""")
def q_join_country_risk_destination(spark, sf):
    sh = td.shipments(spark, sf).select("shipment_id", "destination_country")
    return E.join_country_risk(sh, td.country_risk(spark, sf), "destination_country", "destination",
                               strict_case=True, upper_fact=False)


@register("join_trade_lane", ["shipments", "trade_lanes"], """
SELECT s.shipment_id, s.origin_country, s.destination_country,
       COALESCE(l.avg_customs_days, 2.5) AS lane_avg_customs_days
FROM shipments s LEFT JOIN trade_lanes l
  ON l.origin_country = s.origin_country AND l.destination_country = s.destination_country
""")
def q_join_trade_lane(spark, sf):
    sh = td.shipments(spark, sf).select("shipment_id", "origin_country", "destination_country")
    return E.join_trade_lane(sh, td.trade_lanes(spark, sf), strict_case=True, upper_fact=False)


@register("join_weather", ["shipments", "weather_historical"], """
SELECT s.shipment_id, s.origin_city, s.planned_departure_date,
       COALESCE(w.weather_risk_score, 0.1) AS weather_risk_score
FROM shipments s LEFT JOIN weather_historical w
  ON w.origin_city = s.origin_city AND w.departure_date = strftime(s.planned_departure_date, '%Y-%m-%d')
""")
def q_join_weather(spark, sf):
    sh = td.shipments(spark, sf).select("shipment_id", "origin_city", "planned_departure_date")
    return E.join_weather(sh, td.weather_historical(spark, sf))


@register("join_weather_first_load", ["shipments", "weather_historical"], """
WITH loads AS (SELECT origin_city, departure_date, weather_risk_score * CAST(0.5 AS DOUBLE) AS weather_risk_score, 0 AS load_seq
               FROM weather_historical WHERE right(departure_date, 1) IN ('1', '4', '7')
               UNION ALL SELECT origin_city, departure_date, weather_risk_score, 1 FROM weather_historical),
w AS (SELECT * FROM loads QUALIFY row_number() OVER (PARTITION BY origin_city, departure_date ORDER BY load_seq) = 1)
SELECT s.shipment_id, s.origin_city, s.planned_departure_date,
       COALESCE(w.weather_risk_score, 0.1) AS weather_risk_score
FROM shipments s LEFT JOIN w
  ON w.origin_city = s.origin_city AND w.departure_date = strftime(s.planned_departure_date, '%Y-%m-%d')
""")
def q_join_weather_first_load(spark, sf):
    """J6 on a table where days were fetched twice with other values: prepared once, the first load wins."""
    w = td.weather_historical(spark, sf).withColumn("load_seq", F.lit(1))
    early = w.where(F.substring("departure_date", -1, 1).isin("1", "4", "7"))
    early = early.withColumn("weather_risk_score", F.col("weather_risk_score") * 0.5).withColumn("load_seq", F.lit(0))
    weather = E.prepare(w.unionByName(early), "weather", FS.scratch_path(spark, "weather-twice"))
    sh = td.shipments(spark, sf).select("shipment_id", "origin_city", "planned_departure_date")
    return E.join_weather(sh, weather)


@register("holiday_flag", ["shipments", "holiday_calendar"], """
SELECT s.shipment_id, s.origin_country, s.planned_departure_date,
       CASE WHEN EXISTS (SELECT 1 FROM holiday_calendar h WHERE h.country_code = upper(s.origin_country)
                         AND h.holiday_date = s.planned_departure_date) THEN 1 ELSE 0 END AS is_origin_holiday
FROM shipments s
""")
def q_holiday_flag(spark, sf):
    sh = td.shipments(spark, sf).select("shipment_id", "origin_country", "planned_departure_date")
    return E.holiday_flag(sh, td.holiday_calendar(spark, sf), strict_case=True)


@register("join_vendor_by_city_proxy", ["shipments", "vendor_stats"], """
SELECT s.shipment_id, s.destination_city,
       COALESCE(v.on_time_rate, 0.5) AS vendor_on_time_rate,
       COALESCE(v.avg_delay_days, 2.0) AS vendor_avg_delay_days,
       COALESCE(v.total_shipments, 0) AS vendor_total_shipments
FROM shipments s LEFT JOIN vendor_stats v ON v.vendor_name = s.destination_city
""")
def q_join_vendor_by_city_proxy(spark, sf):
    """Training path keys the vendor table by the destination city."""
    sh = td.shipments(spark, sf).select("shipment_id", "destination_city")
    return E.join_vendor(sh, td.vendor_stats(spark, sf), vendor_key="destination_city")


@register("missing_weather_pairs", ["shipments", "weather_historical"], """
SELECT DISTINCT s.origin_city AS city, s.origin_country AS country,
       strftime(s.planned_departure_date, '%Y-%m-%d') AS departure_date
FROM shipments s
WHERE NOT EXISTS (SELECT 1 FROM weather_historical w WHERE w.origin_city = s.origin_city
                  AND w.departure_date = strftime(s.planned_departure_date, '%Y-%m-%d'))
""")
def q_missing_weather_pairs(spark, sf):
    """Pending (city, country, date) pairs against the fetched weather."""
    sh = td.shipments(spark, sf)
    pairs = sh.select(F.col("origin_city").alias("city"), F.col("origin_country").alias("country"),
                      F.date_format("planned_departure_date", "yyyy-MM-dd").alias("departure_date")).distinct()
    return E.missing_weather_pairs(pairs, td.weather_historical(spark, sf))
