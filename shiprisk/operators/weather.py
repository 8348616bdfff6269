"""Weather backfill and ingest (N1, Q3, Q4 pieces)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import aggregates as A
from . import enrich as E
from . import quality as Q


def explode_daily_weather(payload: DataFrame, city: str = "city", keep: tuple[str, ...] = ()) -> DataFrame:
    """Parallel daily arrays -> one row per day, nulls -> 0, scored.

    ``arrays_zip`` keeps the arrays aligned by position; ``inline`` turns the
    zipped structs into rows inside the same task (no shuffle). ``keep``
    columns are carried through.
    """
    d = payload.select(
        F.col(city).alias("origin_city"), *keep,
        F.inline(F.arrays_zip(
            F.col("daily.time").alias("t"),
            F.col("daily.precipitation_sum").alias("p"),
            F.col("daily.windspeed_10m_max").alias("w"),
            F.col("daily.snowfall_sum").alias("s"))))
    p, w, s = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("p", "w", "s"))
    return d.select(
        "origin_city", F.col("t").alias("departure_date"), *keep,
        p.alias("precipitation_mm"), w.alias("windspeed_max_kmh"), s.alias("snowfall_cm"),
        X.weather_risk_score(p, w, s).alias("weather_risk_score"))


def weather_backfill_plan(orders: DataFrame, done: DataFrame, as_of: str | _dt.date,
                          date_format: str | None = None) -> DataFrame:
    """Q3: which (city, country) date ranges still need fetching.

    parse date (bad -> dropped) -> ISO text -> distinct (city, country, date)
    -> not after ``as_of`` -> minus the (city, date) pairs already stored ->
    first and last pending date per (city, country).
    """
    parsed = orders.select(
        F.col("origin_city").alias("city"), F.col("origin_country").alias("country"),
        (X.parse_order_date("order_date_text", date_format) if date_format
         else X.parse_order_date("order_date_text")).alias("parsed_date"))
    parsed = Q.drop_unparsed_dates(parsed, "parsed_date")
    pairs = A.distinct_city_dates(parsed.withColumn("departure_date", X.date_key("parsed_date")))
    pairs = Q.not_after_as_of(pairs, "departure_date", as_of)
    pending = E.missing_weather_pairs(pairs, done)
    return A.fetch_ranges(pending)


def weather_ingest(payload: DataFrame, load_order: str = "load_seq") -> DataFrame:
    """Q4: payload -> daily rows -> one row per (city, date), first load wins.

    A refetched range repeats days already stored; keep-first is an
    aggregate (map-side combined), so a city with most of the rows does not
    land in one task.
    """
    rows = explode_daily_weather(payload, keep=(load_order,))
    first = Q.dedupe_keep_first(rows, ["origin_city", "departure_date"], [load_order])
    return first.drop(load_order)
