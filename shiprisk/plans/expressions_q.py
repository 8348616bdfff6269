"""Registered scalar-expression queries (P1-P19) and the training table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import enrich as EN
from ..operators import training as TR
from ..sources import testdata as td
from .catalog import register

_MODE_CARRIER = ("CASE shipping_mode WHEN 'Standard Class' THEN 'FTL' WHEN 'Second Class' THEN 'LTL' "
                 "WHEN 'First Class' THEN 'FTL' WHEN 'Same Day' THEN 'Intermodal' ELSE 'FTL' END")
_MODE_PRIORITY = ("CASE shipping_mode WHEN 'Same Day' THEN 'CRITICAL' WHEN 'First Class' THEN 'HIGH' "
                  "WHEN 'Second Class' THEN 'MEDIUM' WHEN 'Standard Class' THEN 'LOW' ELSE 'MEDIUM' END")
_REAL = "COALESCE(TRY_CAST(real_days_text AS DOUBLE), CAST(0 AS DOUBLE))"
_SCHED = "COALESCE(TRY_CAST(sched_days_text AS DOUBLE), CAST(0 AS DOUBLE))"
_QTY = "CAST(trunc(COALESCE(TRY_CAST(quantity_text AS DOUBLE), CAST(1 AS DOUBLE))) AS INTEGER)"
_PRICE = "COALESCE(TRY_CAST(price_text AS DOUBLE), CAST(2 AS DOUBLE))"
_TS = "try_strptime(order_date_text, '%-m/%-d/%Y %-H:%M')"
_DOW = f"CAST(COALESCE(isodow({_TS}) - 1, 0) AS INTEGER)"


@register("map_carrier_type", ["shipments"],
          f"SELECT shipment_id, shipping_mode, {_MODE_CARRIER} AS carrier_type FROM shipments")
def q_map_carrier_type(spark, sf):
    sh = td.shipments(spark, sf)
    return sh.select("shipment_id", "shipping_mode", X.map_carrier_type("shipping_mode").alias("carrier_type"))


@register("map_priority", ["shipments"],
          f"SELECT shipment_id, shipping_mode, {_MODE_PRIORITY} AS priority_level FROM shipments")
def q_map_priority(spark, sf):
    sh = td.shipments(spark, sf)
    return sh.select("shipment_id", "shipping_mode", X.map_priority("shipping_mode").alias("priority_level"))


@register("safe_numeric", ["raw_orders"], f"""
SELECT shipment_id, {_REAL} AS real_days, {_SCHED} AS scheduled_days, {_QTY} AS quantity, {_PRICE} AS price
FROM raw_orders""")
def q_safe_numeric(spark, sf):
    r = td.raw_orders(spark, sf)
    return r.select("shipment_id",
                    X.safe_numeric("real_days_text", 0.0).alias("real_days"),
                    X.safe_numeric("sched_days_text", 0.0).alias("scheduled_days"),
                    X.safe_int("quantity_text", 1.0).alias("quantity"),
                    X.safe_numeric("price_text", 2.0).alias("price"))


@register("delay_labels", ["raw_orders"], f"""
SELECT shipment_id, greatest(CAST(0 AS DOUBLE), {_REAL} - {_SCHED}) AS delay_days,
       CAST({_REAL} > {_SCHED} AS INTEGER) AS delay_flag
FROM raw_orders""")
def q_delay_labels(spark, sf):
    r = td.raw_orders(spark, sf)
    real, sched = X.safe_numeric("real_days_text", 0.0), X.safe_numeric("sched_days_text", 0.0)
    return r.select("shipment_id", X.delay_days(real, sched).alias("delay_days"),
                    X.delay_flag(real, sched).alias("delay_flag"))


@register("cargo_proxies", ["raw_orders"], f"""
SELECT shipment_id,
       least(greatest({_PRICE} * 0.5, CAST(1 AS DOUBLE)), CAST(50000 AS DOUBLE)) AS cargo_weight_kg,
       least(greatest({_PRICE} * 0.5, CAST(1 AS DOUBLE)), CAST(50000 AS DOUBLE)) / 500.0 AS cargo_volume_m3,
       CAST(500 AS DOUBLE) AS distance_km, 1 AS num_stops, 0 AS is_hazmat, 0 AS temperature_sensitive
FROM raw_orders""")
def q_cargo_proxies(spark, sf):
    r = td.raw_orders(spark, sf)
    w = X.cargo_weight_from_price(X.safe_numeric("price_text", 2.0))
    return r.select("shipment_id", w.alias("cargo_weight_kg"), X.cargo_volume_from_weight(w).alias("cargo_volume_m3"),
                    F.lit(500.0).alias("distance_km"), F.lit(1).alias("num_stops"),
                    F.lit(0).alias("is_hazmat"), F.lit(0).alias("temperature_sensitive"))


@register("parse_order_date", ["raw_orders"],
          f"SELECT shipment_id, order_date_text, {_TS} AS planned_departure_date FROM raw_orders")
def q_parse_order_date(spark, sf):
    r = td.raw_orders(spark, sf)
    return r.select("shipment_id", "order_date_text",
                    X.parse_order_date("order_date_text").alias("planned_departure_date"))


@register("date_features", ["raw_orders"], f"""
SELECT shipment_id, {_DOW} AS departure_day_of_week,
       CAST(COALESCE(month({_TS}), 1) AS INTEGER) AS departure_month,
       CAST({_DOW} IN (5, 6) AS INTEGER) AS departure_is_weekend
FROM raw_orders""")
def q_date_features(spark, sf):
    r = td.raw_orders(spark, sf).withColumn("d", X.parse_order_date("order_date_text"))
    dow = X.day_of_week("d")
    return r.select("shipment_id", dow.alias("departure_day_of_week"),
                    X.month_of("d").alias("departure_month"), X.is_weekend(dow).alias("departure_is_weekend"))


@register("cross_border_flag", ["raw_orders"], """
SELECT shipment_id, origin_country, destination_country,
       CAST(COALESCE(origin_country, 'nan') <> COALESCE(destination_country, 'nan') AS INTEGER) AS is_cross_border
FROM raw_orders""")
def q_cross_border_flag(spark, sf):
    r = td.raw_orders(spark, sf)
    return r.select("shipment_id", "origin_country", "destination_country",
                    X.cross_border_flag("origin_country", "destination_country").alias("is_cross_border"))


@register("date_key", ["shipments"], """
SELECT shipment_id, strftime(planned_departure_date, '%Y-%m-%d') AS departure_date FROM shipments""")
def q_date_key(spark, sf):
    sh = td.shipments(spark, sf)
    return sh.select("shipment_id", X.date_key("planned_departure_date").alias("departure_date"))


@register("sanitize_text", ["shipments"], r"""
SELECT shipment_id, vendor_name,
       regexp_replace(regexp_replace(concat(' <', vendor_name, '> & ', origin_city, ' '), '[^A-Za-z0-9\s_\-]', '', 'g'),
                      '^\s+|\s+$', '', 'g') AS sanitized
FROM shipments""")
def q_sanitize_text(spark, sf):
    sh = td.shipments(spark, sf)
    messy = F.concat(F.lit(" <"), "vendor_name", F.lit("> & "), "origin_city", F.lit(" "))
    return sh.select("shipment_id", "vendor_name", X.sanitize_text(messy).alias("sanitized"))


@register("upper_country", ["shipments"], """
SELECT shipment_id, upper(lower(origin_country)) AS origin_country_key FROM shipments""")
def q_upper_country(spark, sf):
    sh = td.shipments(spark, sf)
    return sh.select("shipment_id", X.upper_country(F.lower("origin_country")).alias("origin_country_key"))


@register("weather_risk_score", ["events_ts"], f"""
SELECT event_id, value / 5.0 AS precipitation_mm, value / 3.0 AS windspeed_max_kmh, value / 20.0 AS snowfall_cm,
       {X.sql_weather_risk_score("value / 5.0", "value / 3.0", "value / 20.0")} AS weather_risk_score
FROM events_ts""")
def q_weather_risk_score(spark, sf):
    ev = td.events(spark, sf).select("event_id", (F.col("value") / 5.0).alias("precipitation_mm"),
                                     (F.col("value") / 3.0).alias("windspeed_max_kmh"),
                                     (F.col("value") / 20.0).alias("snowfall_cm"))
    return ev.withColumn("weather_risk_score",
                         X.weather_risk_score("precipitation_mm", "windspeed_max_kmh", "snowfall_cm"))


_SCORE = "(5.0 - c.lpi_score) * 2 + c.customs_tier * 1.5 + c.geopolitical_risk * 5.0 + c.port_congestion * 0.5"


@register("country_risk_score", ["shipments", "country_risk"], f"""
SELECT s.shipment_id, s.destination_country, {_SCORE} AS risk_score,
       CASE WHEN {_SCORE} > 15 THEN 'HIGH' WHEN {_SCORE} > 8 THEN 'MEDIUM' ELSE 'LOW' END AS risk_category
FROM shipments s JOIN country_risk c ON c.country_code = s.destination_country""")
def q_country_risk_score(spark, sf):
    """Risk score and class of every shipment's destination country (known countries)."""
    sh = td.shipments(spark, sf).select("shipment_id", "destination_country")
    cr = td.country_risk(spark, sf).withColumnRenamed("country_code", "destination_country")
    s = X.country_risk_score("lpi_score", "customs_tier", "geopolitical_risk", "port_congestion")
    return sh.join(cr, "destination_country").select(
        "shipment_id", "destination_country", s.alias("risk_score"), X.country_risk_category(s).alias("risk_category"))


_TIER_SQL = """
SELECT g.shipment_id, g.raw_p, COALESCE(v.on_time_rate, 0.5) AS vendor_on_time_rate,
       CASE WHEN COALESCE(v.on_time_rate, 0.5) >= 0.65 THEN 'EXCELLENT'
            WHEN COALESCE(v.on_time_rate, 0.5) >= 0.50 THEN 'AVERAGE' ELSE 'POOR' END AS vendor_tier,
       greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE),
         CASE WHEN COALESCE(v.on_time_rate, 0.5) >= 0.65 THEN g.raw_p + -0.1
              WHEN COALESCE(v.on_time_rate, 0.5) >= 0.50
                THEN g.raw_p + (COALESCE(v.on_time_rate, 0.5) - 0.5) / (CAST(0.65 AS DOUBLE) - CAST(0.5 AS DOUBLE)) * -0.1
              ELSE g.raw_p + 0.15 END)) AS adjusted_probability
FROM given_scores g LEFT JOIN vendor_stats v ON v.vendor_name = g.vendor_name"""


def _tiers(spark, sf):
    from ..operators import enrich as E
    g = td.given_scores(spark, sf).select("shipment_id", "vendor_name", "raw_p")
    j = E.join_vendor(g, td.vendor_stats(spark, sf))
    return j.select("shipment_id", "raw_p", "vendor_on_time_rate",
                    X.vendor_tier("vendor_on_time_rate").alias("vendor_tier"),
                    X.adjusted_probability("raw_p", "vendor_on_time_rate").alias("adjusted_probability"))


@register("vendor_tier_adjust", ["given_scores", "vendor_stats"], _TIER_SQL)
def q_vendor_tier_adjust(spark, sf):
    return _tiers(spark, sf)


@register("risk_band", ["given_scores", "vendor_stats"], f"""
SELECT shipment_id, CAST(floor(COALESCE(adjusted_probability, raw_p) * 100 + 0.5) AS INTEGER) AS risk_pct,
       CASE WHEN floor(COALESCE(adjusted_probability, raw_p) * 100 + 0.5) >= 70 THEN 'HIGH RISK'
            WHEN floor(COALESCE(adjusted_probability, raw_p) * 100 + 0.5) >= 40 THEN 'MODERATE'
            ELSE 'LOW RISK' END AS risk_band
FROM ({_TIER_SQL}) t""")
def q_risk_band(spark, sf):
    t = _tiers(spark, sf)
    pct = X.risk_percent("adjusted_probability", "raw_p")
    return t.select("shipment_id", pct.alias("risk_pct"), X.risk_band(pct).alias("risk_band"))


@register("result_fields", ["given_scores", "vendor_stats"], """
SELECT g.shipment_id,
       CASE WHEN g.raw_p >= 0.5 THEN 'Delay Likely' ELSE 'On-Time Expected' END AS headline,
       CASE WHEN g.raw_p >= 0.5 THEN ['WEATHER', 'VENDOR', 'ROUTE', 'CUSTOMS'][g.reason_index + 1]
            ELSE 'None detected' END AS reason_text,
       CASE WHEN COALESCE(v.on_time_rate, 0.5) = 0 THEN 'N/A'
            ELSE concat(CAST(CAST(floor(COALESCE(v.on_time_rate, 0.5) * 100 + 0.5) AS BIGINT) AS VARCHAR), '%') END AS on_time_text
FROM given_scores g LEFT JOIN vendor_stats v ON v.vendor_name = g.vendor_name""")
def q_result_fields(spark, sf):
    g = td.given_scores(spark, sf)
    j = EN.join_vendor(g, td.vendor_stats(spark, sf))
    delayed = F.col("raw_p") >= 0.5
    reason = F.when(delayed, F.element_at(F.array(*[F.lit(r) for r in X.C.REASON_LABELS]), F.col("reason_index") + 1))
    return j.select("shipment_id", X.headline(delayed).alias("headline"),
                    X.reason_display(reason).alias("reason_text"),
                    X.on_time_rate_display("vendor_on_time_rate").alias("on_time_text"))


@register("boolean_to_int", ["requests"], """
SELECT shipment_id, CAST(COALESCE(is_hazmat, false) AS INTEGER) AS is_hazmat,
       CAST(COALESCE(temperature_sensitive, false) AS INTEGER) AS temperature_sensitive
FROM requests""")
def q_boolean_to_int(spark, sf):
    r = td.typed_shipments(spark, sf)
    return r.select("shipment_id", X.boolean_to_int("is_hazmat").alias("is_hazmat"),
                    X.boolean_to_int("temperature_sensitive").alias("temperature_sensitive"))


def _sparse(col: str, every: int):
    """Null out a request field on some rows (missing request fields)."""
    return F.when(F.col("l_partkey") % every != 0, F.col(col))


@register("feature_defaults", ["requests"], """
SELECT shipment_id,
       COALESCE(CASE WHEN l_partkey % 3 <> 0 THEN cargo_weight_kg END, 1.0) AS cargo_weight_kg,
       COALESCE(CASE WHEN l_partkey % 4 <> 0 THEN cargo_volume_m3 END, 1.0) AS cargo_volume_m3,
       COALESCE(CASE WHEN l_partkey % 5 <> 0 THEN distance_km END, 1.0) AS distance_km,
       CAST(COALESCE(CASE WHEN l_partkey % 6 <> 0 THEN num_stops END, 0) AS INTEGER) AS num_stops,
       CAST(COALESCE(CASE WHEN l_partkey % 7 <> 0 THEN scheduled_transit_days END, 2) AS INTEGER) AS planned_transit_days,
       COALESCE(CASE WHEN l_partkey % 8 <> 0 THEN carrier_type END, 'FTL') AS carrier_type,
       COALESCE(CASE WHEN l_partkey % 9 <> 0 THEN priority_level END, 'MEDIUM') AS priority_level
FROM requests""")
def q_feature_defaults(spark, sf):
    r = td.typed_shipments(spark, sf)
    d = X.C.SCORING_DEFAULTS
    return r.select(
        "shipment_id",
        X.with_default(_sparse("cargo_weight_kg", 3), d["cargo_weight_kg"]).alias("cargo_weight_kg"),
        X.with_default(_sparse("cargo_volume_m3", 4), d["cargo_volume_m3"]).alias("cargo_volume_m3"),
        X.with_default(_sparse("distance_km", 5), d["distance_km"]).alias("distance_km"),
        X.with_default(_sparse("num_stops", 6), d["num_stops"]).cast("int").alias("num_stops"),
        X.with_default(_sparse("scheduled_transit_days", 7), d["scheduled_transit_days"]).cast("int")
         .alias("planned_transit_days"),
        X.with_default(_sparse("carrier_type", 8), d["carrier_type"]).alias("carrier_type"),
        X.with_default(_sparse("priority_level", 9), d["priority_level"]).alias("priority_level"))


@register("fill_remaining_nulls", ["given_scores"], """
SELECT shipment_id,
       COALESCE(CASE WHEN reason_index = 1 THEN NULL ELSE raw_p END, 0.0) AS raw_p,
       COALESCE(CASE WHEN reason_index = 2 THEN NULL ELSE raw_days END, 0.0) AS raw_days
FROM given_scores""")
def q_fill_remaining_nulls(spark, sf):
    g = td.given_scores(spark, sf)
    holes = g.select("shipment_id",
                     F.when(F.col("reason_index") != 1, F.col("raw_p")).alias("raw_p"),
                     F.when(F.col("reason_index") != 2, F.col("raw_days")).alias("raw_days"))
    return holes.fillna(0.0)


_TRAIN_SQL = f"""
SELECT b.shipment_id, b.carrier_type, b.priority_level, b.delay_days, b.delay_flag, b.quantity,
       b.cargo_weight_kg, b.cargo_volume_m3, b.distance_km, b.num_stops, b.is_hazmat, b.temperature_sensitive,
       b.planned_departure_date, b.planned_transit_days, b.origin_city, b.destination_city,
       b.origin_country, b.destination_country, b.departure_day_of_week, b.departure_month,
       b.departure_is_weekend, b.is_cross_border,
       COALESCE(co.lpi_score, 3.0) AS origin_lpi_score,
       COALESCE(co.customs_tier, 2) AS origin_customs_tier,
       COALESCE(co.geopolitical_risk, 0.2) AS origin_geopolitical_risk,
       COALESCE(cd.lpi_score, 3.0) AS destination_lpi_score,
       COALESCE(cd.customs_tier, 2) AS destination_customs_tier,
       COALESCE(cd.geopolitical_risk, 0.2) AS destination_geopolitical_risk,
       COALESCE(cd.port_congestion, 1.0) AS destination_port_congestion,
       COALESCE(l.avg_customs_days, 2.5) AS lane_avg_customs_days,
       COALESCE(w.weather_risk_score, 0.1) AS weather_risk_score,
       COALESCE(v.on_time_rate, 0.5) AS vendor_on_time_rate,
       COALESCE(v.avg_delay_days, 2.0) AS vendor_avg_delay_days,
       COALESCE(r.avg_delay_days, 2.0) AS route_avg_delay_days,
       0 AS is_origin_holiday, 0 AS is_destination_holiday
FROM (
  SELECT shipment_id, {_MODE_CARRIER} AS carrier_type, {_MODE_PRIORITY} AS priority_level,
         greatest(CAST(0 AS DOUBLE), {_REAL} - {_SCHED}) AS delay_days,
         CAST({_REAL} > {_SCHED} AS INTEGER) AS delay_flag, {_QTY} AS quantity,
         least(greatest({_PRICE} * 0.5, CAST(1 AS DOUBLE)), CAST(50000 AS DOUBLE)) AS cargo_weight_kg,
         least(greatest({_PRICE} * 0.5, CAST(1 AS DOUBLE)), CAST(50000 AS DOUBLE)) / 500.0 AS cargo_volume_m3,
         CAST(500 AS DOUBLE) AS distance_km, 1 AS num_stops, 0 AS is_hazmat, 0 AS temperature_sensitive,
         {_TS} AS planned_departure_date, {_SCHED} AS planned_transit_days,
         COALESCE(origin_city, 'nan') AS origin_city, COALESCE(destination_city, 'nan') AS destination_city,
         COALESCE(origin_country, 'nan') AS origin_country, COALESCE(destination_country, 'nan') AS destination_country,
         {_DOW} AS departure_day_of_week, CAST(COALESCE(month({_TS}), 1) AS INTEGER) AS departure_month,
         CAST({_DOW} IN (5, 6) AS INTEGER) AS departure_is_weekend,
         CAST(COALESCE(origin_country, 'nan') <> COALESCE(destination_country, 'nan') AS INTEGER) AS is_cross_border
  FROM raw_orders) b
LEFT JOIN country_risk co ON co.country_code = b.origin_country
LEFT JOIN country_risk cd ON cd.country_code = b.destination_country
LEFT JOIN trade_lanes l ON l.origin_country = b.origin_country AND l.destination_country = b.destination_country
LEFT JOIN weather_historical w ON w.origin_city = b.origin_city
                              AND w.departure_date = strftime(b.planned_departure_date, '%Y-%m-%d')
LEFT JOIN vendor_stats v ON v.vendor_name = b.destination_city
LEFT JOIN route_stats r ON r.origin = b.origin_city AND r.destination = b.destination_city"""
_TRAIN_FIX = ["raw_orders", "country_risk", "trade_lanes", "weather_historical", "vendor_stats", "route_stats"]


def training_table(spark, sf):
    from .enrichment import _dims
    dims = {k: d for k, d in _dims(spark, sf, strict_case=True).items() if k != "holidays"}
    return TR.build_training_table(td.raw_orders(spark, sf), **dims)


@register("build_training_table", _TRAIN_FIX, _TRAIN_SQL)
def q_build_training_table(spark, sf):
    """The whole raw -> labelled training table."""
    return training_table(spark, sf)
