"""Explicit schemas for every table the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


VENDOR_STATS = _schema(
    ("vendor_name", S, False), ("on_time_rate", D, False),
    ("avg_delay_days", D, False), ("total_shipments", I, False))

ROUTE_STATS = _schema(
    ("origin", S, False), ("destination", S, False),
    ("avg_delay_days", D, False), ("historical_count", I, False))

COUNTRY_RISK = _schema(
    ("country_code", S, False), ("lpi_score", D, False), ("customs_tier", I, False),
    ("geopolitical_risk", D, False), ("port_congestion", D, False))

HOLIDAY_CALENDAR = _schema(
    ("country_code", S, False), ("holiday_date", T.DateType(), False),
    ("holiday_name", S, False), ("risk_weight", D, False))

TRADE_LANES = _schema(
    ("origin_country", S, False), ("destination_country", S, False),
    ("avg_customs_days", D, False), ("lane_type", S, False), ("confidence", D, False))

PREDICTIONS = _schema(
    ("shipment_id", S, False), ("delay_predicted", B, False),
    ("delay_probability", D, False), ("estimated_delay_days", D, False),
    ("delay_reason", S, True), ("vendor_tier", S, True),
    ("prediction_timestamp", T.TimestampType(), True))

WEATHER_HISTORICAL = _schema(
    ("origin_city", S, False), ("departure_date", S, False),
    ("precipitation_mm", D, True), ("windspeed_max_kmh", D, True),
    ("snowfall_cm", D, True), ("weather_risk_score", D, False))

# Table name -> (schema, key columns, check rules as SQL predicates).
DIMENSIONS = {
    "vendor_stats": (VENDOR_STATS, ["vendor_name"], [
        "on_time_rate >= 0.0 AND on_time_rate <= 1.0",
        "avg_delay_days >= 0.0",
        "total_shipments >= 0"]),
    "route_stats": (ROUTE_STATS, ["origin", "destination"], [
        "avg_delay_days >= 0.0",
        "historical_count >= 0"]),
    "country_risk": (COUNTRY_RISK, ["country_code"], [
        "lpi_score >= 1.0 AND lpi_score <= 5.0",
        "customs_tier >= 1 AND customs_tier <= 4",
        "geopolitical_risk >= 0.0 AND geopolitical_risk <= 1.0",
        "port_congestion >= 0.0"]),
    "holiday_calendar": (HOLIDAY_CALENDAR, ["country_code", "holiday_date"], [
        "risk_weight >= 0.0 AND risk_weight <= 1.0"]),
    "trade_lanes": (TRADE_LANES, ["origin_country", "destination_country"], [
        "avg_customs_days >= 0.0",
        "confidence >= 0.0 AND confidence <= 1.0"]),
    "weather_historical": (WEATHER_HISTORICAL, ["origin_city", "departure_date"], []),
}

# Raw order CSV: every column read as text, then safely cast.
RAW_ORDER_COLUMNS = {
    "shipping_mode": "Shipping Mode",
    "real_days_text": "Days for shipping (real)",
    "sched_days_text": "Days for shipment (scheduled)",
    "quantity_text": "Order Item Quantity",
    "price_text": "Order Item Product Price",
    "order_date_text": "order date (DateOrders)",
    "origin_city": "Order City",
    "destination_city": "Customer City",
    "origin_country": "Order Country",
    "destination_country": "Customer Country",
}
RAW_ORDERS = _schema(*[(c, S, True) for c in RAW_ORDER_COLUMNS.values()])

# One scoring request per row (validated by F1).
SHIPMENT_REQUEST = _schema(
    ("shipment_id", S, True), ("vendor_name", S, True),
    ("origin_city", S, True), ("origin_country", S, True),
    ("destination_city", S, True), ("destination_country", S, True),
    ("planned_departure_date", T.DateType(), True),
    ("scheduled_transit_days", I, True), ("cargo_weight_kg", D, True),
    ("cargo_volume_m3", D, True), ("distance_km", D, True), ("num_stops", I, True),
    ("carrier_type", S, True), ("is_hazmat", B, True),
    ("priority_level", S, True), ("temperature_sensitive", B, True))

# Weather service payload: parallel daily arrays.
WEATHER_PAYLOAD = T.StructType([
    T.StructField("city", S),
    T.StructField("daily", T.StructType([
        T.StructField("time", T.ArrayType(S)),
        T.StructField("precipitation_sum", T.ArrayType(D)),
        T.StructField("windspeed_10m_max", T.ArrayType(D)),
        T.StructField("snowfall_sum", T.ArrayType(D)),
    ])),
])

NUMERIC_FEATURES = [
    "cargo_weight_kg", "cargo_volume_m3", "distance_km", "num_stops",
    "planned_transit_days", "departure_day_of_week", "departure_month",
    "departure_is_weekend", "is_hazmat", "temperature_sensitive",
    "weather_risk_score", "vendor_on_time_rate",
    "vendor_avg_delay_days", "route_avg_delay_days", "is_cross_border",
    "origin_lpi_score", "destination_lpi_score", "origin_customs_tier",
    "destination_customs_tier", "origin_geopolitical_risk",
    "destination_geopolitical_risk", "destination_port_congestion",
    "is_origin_holiday", "is_destination_holiday", "lane_avg_customs_days",
]
CATEGORICAL_FEATURES = ["carrier_type", "priority_level"]
