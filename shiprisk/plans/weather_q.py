"""Registered weather queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import sql_weather_risk_score
from ..operators import aggregates as A
from ..operators import weather as W
from ..sources import testdata as td
from .catalog import register

AS_OF = "1999-12-31"


def weather_payload(spark, sf, load_seq: int = 1, wind_shift: float = 0.0, where=None):
    """Service-shaped payload per (city, year): sorted parallel daily arrays.

    Built from the stored daily weather; precipitation is missing (null) on
    days divisible by 10. One payload covers at most one city-year (366
    entries), so no group grows with the table.
    """
    w = td.weather_historical(spark, sf)
    if where is not None:
        w = w.where(where)
    day = F.dayofmonth(F.to_date("departure_date"))
    rows = w.select("origin_city", F.substring("departure_date", 1, 4).alias("year"), F.struct(
        F.col("departure_date").alias("t"),
        F.when(day % 10 != 0, F.col("precipitation_mm")).alias("p"),
        (F.col("windspeed_max_kmh") + wind_shift).alias("w"),
        F.col("snowfall_cm").alias("s")).alias("d"))
    g = rows.groupBy("origin_city", "year").agg(F.array_sort(F.collect_list("d")).alias("days"))
    return g.select(
        F.col("origin_city").alias("city"), F.lit(load_seq).alias("load_seq"),
        F.struct(F.transform("days", lambda x: x["t"]).alias("time"),
                 F.transform("days", lambda x: x["p"]).alias("precipitation_sum"),
                 F.transform("days", lambda x: x["w"]).alias("windspeed_10m_max"),
                 F.transform("days", lambda x: x["s"]).alias("snowfall_sum")).alias("daily"))


_P0 = "CASE WHEN day(CAST(departure_date AS DATE)) % 10 = 0 THEN 0.0 ELSE precipitation_mm END"


@register("explode_daily_weather", ["weather_historical"], f"""
SELECT origin_city, departure_date, {_P0} AS precipitation_mm, windspeed_max_kmh, snowfall_cm,
       {sql_weather_risk_score(_P0, "windspeed_max_kmh", "snowfall_cm")} AS weather_risk_score
FROM weather_historical""")
def q_explode_daily_weather(spark, sf):
    """Payload arrays -> daily scored rows."""
    return W.explode_daily_weather(weather_payload(spark, sf))


_W2 = ("CASE WHEN CAST(split_part(origin_city, '_', 2) AS INTEGER) % 3 = 0 "
       "THEN windspeed_max_kmh + 5.0 ELSE windspeed_max_kmh END")


@register("weather_ingest", ["weather_historical"], f"""
SELECT origin_city, departure_date, {_P0} AS precipitation_mm, {_W2} AS windspeed_max_kmh, snowfall_cm,
       {sql_weather_risk_score(_P0, _W2, "snowfall_cm")} AS weather_risk_score
FROM weather_historical""")
def q_weather_ingest(spark, sf):
    """Q4: an early load for some cities plus a full refetch; first load wins per day."""
    k = td.city_ordinal(F.col("origin_city"))
    early = weather_payload(spark, sf, load_seq=0, wind_shift=5.0, where=k % 3 == 0)
    late = weather_payload(spark, sf, load_seq=1)
    return W.weather_ingest(early.unionByName(late))


_PAIRS_SQL = """
SELECT DISTINCT origin_city AS city, origin_country AS country,
       strftime(try_strptime(order_date_text, '%-m/%-d/%Y %-H:%M'), '%Y-%m-%d') AS departure_date
FROM raw_orders WHERE try_strptime(order_date_text, '%-m/%-d/%Y %-H:%M') IS NOT NULL"""


@register("distinct_city_dates", ["raw_orders"], _PAIRS_SQL)
def q_distinct_city_dates(spark, sf):
    """A2 (with F3): distinct (city, country, date) of parsable orders."""
    from ..functions import expressions as X
    from ..operators import quality as Q
    r = td.raw_orders(spark, sf).select(F.col("origin_city").alias("city"), F.col("origin_country").alias("country"),
                                        X.parse_order_date("order_date_text").alias("d"))
    r = Q.drop_unparsed_dates(r, "d").withColumn("departure_date", X.date_key("d"))
    return A.distinct_city_dates(r)


@register("fetch_ranges", ["raw_orders"], f"""
SELECT city, country, min(departure_date) AS start_date, max(departure_date) AS end_date
FROM ({_PAIRS_SQL}) p GROUP BY city, country""")
def q_fetch_ranges(spark, sf):
    """A3: first and last date per (city, country)."""
    return A.fetch_ranges(q_distinct_city_dates(spark, sf))


@register("weather_backfill_plan", ["raw_orders", "weather_historical"], f"""
SELECT city, country, min(departure_date) AS start_date, max(departure_date) AS end_date
FROM ({_PAIRS_SQL}) p
WHERE departure_date <= '{AS_OF}'
  AND NOT EXISTS (SELECT 1 FROM weather_historical w WHERE w.origin_city = p.city AND w.departure_date = p.departure_date)
GROUP BY city, country""")
def q_weather_backfill_plan(spark, sf):
    """Q3: pending fetch ranges (as-of date is a parameter, for reproducibility)."""
    return W.weather_backfill_plan(td.raw_orders(spark, sf), td.weather_historical(spark, sf), AS_OF)


@register("not_after_as_of", ["raw_orders"], f"""
SELECT city, country, departure_date FROM ({_PAIRS_SQL}) p WHERE departure_date <= '{AS_OF}'""")
def q_not_after_as_of(spark, sf):
    """keep ISO dates on or before the as-of date."""
    from ..operators import quality as Q
    return Q.not_after_as_of(q_distinct_city_dates(spark, sf), "departure_date", AS_OF)


@register("drop_unparsed_dates", ["raw_orders"], """
SELECT shipment_id, try_strptime(order_date_text, '%-m/%-d/%Y %-H:%M') AS parsed_date FROM raw_orders
WHERE try_strptime(order_date_text, '%-m/%-d/%Y %-H:%M') IS NOT NULL""")
def q_drop_unparsed_dates(spark, sf):
    """rows whose order date does not parse are dropped."""
    from ..functions import expressions as X
    from ..operators import quality as Q
    r = td.raw_orders(spark, sf).select("shipment_id", X.parse_order_date("order_date_text").alias("parsed_date"))
    return Q.drop_unparsed_dates(r, "parsed_date")
