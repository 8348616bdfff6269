"""DuckDB SQL for the derived inputs (the same rules as sources/testdata.py).

Only used by the independent oracle: each oracle query is
``WITH <needed fixtures> SELECT ...`` over the driver's raw tables.
"""

from __future__ import annotations

from ..functions.expressions import sql_weather_risk_score

FIXTURES: dict[str, str] = {}
DEPENDS: dict[str, list[str]] = {}


def _fx(name: str, sql: str, deps: list[str] | None = None) -> None:
    FIXTURES[name] = sql
    DEPENDS[name] = deps or []


_fx("shipments", """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                 CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS shipment_id,
       s_name AS vendor_name,
       concat('CITY_', CAST(l_suppkey % 40 AS VARCHAR)) AS origin_city,
       concat('CITY_', CAST(o_custkey % 40 AS VARCHAR)) AS destination_city,
       sn.n_name AS origin_country,
       cn.n_name AS destination_country,
       CAST(o_orderdate AS DATE) AS planned_departure_date,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Same Day' WHEN '2-HIGH' THEN 'First Class'
            WHEN '3-MEDIUM' THEN 'Second Class' WHEN '4-NOT SPECIFIED' THEN 'Standard Class' END AS shipping_mode,
       CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1
            WHEN '3-MEDIUM' THEN 2 ELSE 4 END AS scheduled_days,
       greatest(0, l_linenumber - 1 - l_suppkey % 4) AS real_days,
       l_quantity AS quantity,
       l_extendedprice AS product_price,
       l_linenumber, l_partkey, l_suppkey
FROM lineitem
JOIN orders   ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN customer ON o_custkey = c_custkey
JOIN nation sn ON s_nationkey = sn.n_nationkey
JOIN nation cn ON c_nationkey = cn.n_nationkey
""")

_fx("requests", """
SELECT shipment_id, vendor_name, origin_city, origin_country, destination_city, destination_country,
       planned_departure_date,
       CAST(scheduled_days + 1 AS INTEGER) AS scheduled_transit_days,
       product_price * 0.5 AS cargo_weight_kg,
       quantity * 4.0 AS cargo_volume_m3,
       CAST(l_partkey % 250 AS DOUBLE) * 100.0 + 50.0 AS distance_km,
       CAST(l_linenumber - 1 AS INTEGER) AS num_stops,
       CASE l_partkey % 5 WHEN 0 THEN 'FTL' WHEN 1 THEN 'LTL' WHEN 2 THEN 'Intermodal'
            WHEN 3 THEN 'Ocean' ELSE 'Air' END AS carrier_type,
       (l_partkey % 11 = 0) AS is_hazmat,
       CASE l_suppkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH'
            ELSE 'CRITICAL' END AS priority_level,
       (l_suppkey % 3 = 0) AS temperature_sensitive,
       l_partkey, l_suppkey, l_linenumber,
       CAST((l_partkey * 37) % 1000 AS DOUBLE) / 999.0 AS raw_p,
       CAST(real_days AS DOUBLE) * 0.9 + 0.03 AS raw_days,
       CAST(l_suppkey % 4 AS INTEGER) AS reason_index
FROM shipments
""", ["shipments"])

_fx("raw_orders", """
SELECT shipment_id, shipping_mode,
       CASE WHEN l_linenumber = 7 THEN 'bad' ELSE CAST(real_days AS VARCHAR) END AS real_days_text,
       CASE WHEN l_linenumber = 6 THEN 'n/a' ELSE CAST(scheduled_days AS VARCHAR) END AS sched_days_text,
       CASE WHEN l_linenumber = 5 THEN 'many' ELSE CAST(quantity AS VARCHAR) END AS quantity_text,
       CASE WHEN l_linenumber = 4 THEN NULL ELSE CAST(product_price AS VARCHAR) END AS price_text,
       CASE WHEN l_linenumber = 3 AND l_suppkey % 2 = 0 THEN 'unknown'
            ELSE strftime(CAST(planned_departure_date AS TIMESTAMP), '%-m/%-d/%Y %-H:%M') END AS order_date_text,
       origin_city, destination_city, origin_country, destination_country
FROM shipments
""", ["shipments"])

_fx("vendor_stats", """
SELECT vendor_name,
       avg(CASE WHEN real_days <= scheduled_days THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS on_time_rate,
       avg(greatest(CAST(0 AS DOUBLE), CAST(real_days AS DOUBLE) - CAST(scheduled_days AS DOUBLE))) AS avg_delay_days,
       CAST(count(*) AS INTEGER) AS total_shipments
FROM shipments WHERE l_suppkey % 10 <> 7 GROUP BY vendor_name
""", ["shipments"])

_fx("route_stats", """
SELECT origin_city AS origin, destination_city AS destination,
       avg(greatest(CAST(0 AS DOUBLE), CAST(real_days AS DOUBLE) - CAST(scheduled_days AS DOUBLE))) AS avg_delay_days,
       CAST(count(*) AS INTEGER) AS historical_count
FROM shipments
WHERE CAST(split_part(origin_city, '_', 2) AS INTEGER) <= 30
GROUP BY origin_city, destination_city
""", ["shipments"])

_fx("country_risk", """
SELECT n_name AS country_code,
       CAST(1 AS DOUBLE) + CAST(n_nationkey % 9 AS DOUBLE) * 0.5 AS lpi_score,
       CAST(1 + n_nationkey % 4 AS INTEGER) AS customs_tier,
       CAST(n_nationkey % 11 AS DOUBLE) / 10.0 AS geopolitical_risk,
       CAST(n_nationkey % 7 AS DOUBLE) * 1.5 AS port_congestion
FROM nation WHERE n_nationkey % 5 <> 4
""")

_fx("trade_lanes", """
SELECT a.n_name AS origin_country, b.n_name AS destination_country,
       CAST(1 AS DOUBLE) + CAST((a.n_nationkey * b.n_nationkey) % 20 AS DOUBLE) / 10.0 AS avg_customs_days,
       'INTERNATIONAL' AS lane_type,
       CAST(1 AS DOUBLE) - CAST(a.n_nationkey % 5 AS DOUBLE) / 10.0 AS confidence
FROM nation a JOIN nation b
  ON a.n_nationkey <> b.n_nationkey AND (a.n_nationkey + b.n_nationkey) % 3 <> 0
""")

_fx("holiday_calendar", """
SELECT n_name AS country_code,
       CAST(make_date(CAST(y AS INTEGER), 1, 1) + to_days(CAST(n_nationkey * 10 AS INTEGER)) AS DATE) AS holiday_date,
       concat('HOLIDAY_', CAST(n_nationkey AS VARCHAR)) AS holiday_name,
       CAST(1 AS DOUBLE) AS risk_weight
FROM nation, range(1995, 2002) t(y)
""")

_fx("weather_historical", f"""
SELECT origin_city, departure_date, precipitation_mm, windspeed_max_kmh, snowfall_cm,
       {sql_weather_risk_score("precipitation_mm", "windspeed_max_kmh", "snowfall_cm")} AS weather_risk_score
FROM (
  SELECT DISTINCT origin_city, strftime(planned_departure_date, '%Y-%m-%d') AS departure_date,
         CAST(day(planned_departure_date) % 40 AS DOUBLE) AS precipitation_mm,
         CAST(month(planned_departure_date) * 7 AS DOUBLE) AS windspeed_max_kmh,
         CAST((day(planned_departure_date) * month(planned_departure_date)) % 15 AS DOUBLE) AS snowfall_cm
  FROM shipments
  WHERE planned_departure_date IS NOT NULL AND day(planned_departure_date) <> 13
) w
""", ["shipments"])

_fx("given_scores", """
SELECT shipment_id, vendor_name, real_days, scheduled_days, planned_departure_date,
       CAST((l_partkey * 37) % 1000 AS DOUBLE) / 999.0 AS raw_p,
       CAST(real_days AS DOUBLE) * 0.9 + 0.03 AS raw_days,
       CAST(l_suppkey % 4 AS INTEGER) AS reason_index,
       CAST(real_days > scheduled_days AS INTEGER) AS delay_flag,
       CAST(greatest(0, real_days - scheduled_days) AS DOUBLE) AS delay_days
FROM shipments
""", ["shipments"])

_fx("city_coordinates", """
SELECT city,
       CAST(CAST(split_part(city, '_', 2) AS INTEGER) * 37 % 150 AS DOUBLE) - 70.0 AS lat,
       CAST(CAST(split_part(city, '_', 2) AS INTEGER) * 83 % 350 AS DOUBLE) - 170.0 AS lon
FROM (SELECT origin_city AS city FROM shipments UNION SELECT destination_city FROM shipments) c
""", ["shipments"])

_fx("city_dictionary", """
SELECT lower(city) AS name, CAST(split_part(city, '_', 2) AS INTEGER) AS ordinal, lat, lon
FROM city_coordinates WHERE CAST(split_part(city, '_', 2) AS INTEGER) < 20
""", ["city_coordinates"])

_fx("events_ts", """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, props FROM events
""")


def with_fixtures(names: list[str], body: str) -> str:
    """``WITH`` clause holding ``names`` and their dependencies, then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPENDS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n].strip()})" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":  # merge the body's own CTEs into one WITH clause
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
