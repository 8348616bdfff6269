"""Raw orders -> labelled training table (J13) and its pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import expressions as X
from . import enrich as E


def parse_raw_orders(raw: DataFrame, date_format: str = C.RAW_DATE_FORMAT) -> DataFrame:
    """Casts, maps, clips and date parts of the raw order text (no lookups).

    Missing country columns become the constant country; missing text
    values become the text of a missing value, as a str() of one would.
    """
    def country(name: str):
        if name in raw.columns:
            return F.coalesce(F.col(name), F.lit(C.NULL_TEXT))
        return F.lit(C.RAW_DEFAULT_COUNTRY)

    real = X.safe_numeric("real_days_text", C.RAW_DEFAULT_REAL_DAYS)
    sched = X.safe_numeric("sched_days_text", C.RAW_DEFAULT_SCHED_DAYS)
    weight = X.cargo_weight_from_price(X.safe_numeric("price_text", C.RAW_DEFAULT_PRICE))
    ts = X.parse_order_date("order_date_text", date_format)
    base = raw.select(
        "shipment_id",
        X.map_carrier_type("shipping_mode").alias("carrier_type"),
        X.map_priority("shipping_mode").alias("priority_level"),
        X.delay_days(real, sched).alias("delay_days"),
        X.delay_flag(real, sched).alias("delay_flag"),
        X.safe_int("quantity_text", C.RAW_DEFAULT_QUANTITY).alias("quantity"),
        weight.alias("cargo_weight_kg"),
        ts.alias("planned_departure_date"),
        sched.alias("planned_transit_days"),
        F.lit(0).alias("is_hazmat"),
        F.lit(0).alias("temperature_sensitive"),
        F.lit(C.TRAINING_NUM_STOPS).alias("num_stops"),
        F.lit(C.TRAINING_DISTANCE_KM).alias("distance_km"),
        F.coalesce("origin_city", F.lit(C.NULL_TEXT)).alias("origin_city"),
        F.coalesce("destination_city", F.lit(C.NULL_TEXT)).alias("destination_city"),
        country("origin_country").alias("origin_country"),
        country("destination_country").alias("destination_country"),
    )
    dow = X.day_of_week(F.col("planned_departure_date"))
    return base.select(
        *base.columns,
        X.cargo_volume_from_weight("cargo_weight_kg").alias("cargo_volume_m3"),
        dow.alias("departure_day_of_week"),
        X.month_of("planned_departure_date").alias("departure_month"),
        X.is_weekend(dow).alias("departure_is_weekend"),
        X.cross_border_flag("origin_country", "destination_country").alias("is_cross_border"),
    )


TRAINING_COLUMNS = [
    "shipment_id", "carrier_type", "priority_level", "delay_days", "delay_flag", "quantity",
    "cargo_weight_kg", "cargo_volume_m3", "distance_km", "num_stops", "is_hazmat",
    "temperature_sensitive", "planned_departure_date", "planned_transit_days",
    "origin_city", "destination_city", "origin_country", "destination_country",
    "departure_day_of_week", "departure_month", "departure_is_weekend", "is_cross_border",
    "origin_lpi_score", "origin_customs_tier", "origin_geopolitical_risk",
    "destination_lpi_score", "destination_customs_tier", "destination_geopolitical_risk",
    "destination_port_congestion", "lane_avg_customs_days", "weather_risk_score",
    "vendor_on_time_rate", "vendor_avg_delay_days", "route_avg_delay_days",
    "is_origin_holiday", "is_destination_holiday",
]


def build_training_table(raw: DataFrame, risk: DataFrame, lanes: DataFrame, weather: DataFrame,
                         vendors: DataFrame, routes: DataFrame,
                         date_format: str = C.RAW_DATE_FORMAT) -> DataFrame:
    """Raw orders -> one labelled feature row per order.

    Training-path lookups: countries as given (no case change), the vendor
    table keyed by the destination city (J8), holiday flags fixed at 0.
    Every lookup is a left join against a one-row-per-key table, so the
    row count equals the raw row count.
    """
    x = parse_raw_orders(raw, date_format)
    x = E.join_country_risk(x, risk, "origin_country", "origin", strict_case=True, upper_fact=False)
    x = E.join_country_risk(x, risk, "destination_country", "destination", strict_case=True, upper_fact=False)
    x = E.join_trade_lane(x, lanes, strict_case=True, upper_fact=False)
    x = E.join_weather(x, weather)
    x = E.join_vendor(x, vendors, vendor_key="destination_city")
    x = E.join_route(x, routes)
    return x.select(
        *[c for c in TRAINING_COLUMNS if c not in ("is_origin_holiday", "is_destination_holiday")],
        F.lit(0).alias("is_origin_holiday"), F.lit(0).alias("is_destination_holiday"))
