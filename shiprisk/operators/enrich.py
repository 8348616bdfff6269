"""Dimension lookups (J1-J9, J12): left equi joins with a default on miss.

Join strategy: no broadcast hints on dimensions whose size grows with the
data (vendor_stats grows with suppliers, weather with city-days). The
planner broadcasts a side only when its estimated size is under
``spark.sql.autoBroadcastJoinThreshold``; with AQE on, a side whose
*measured* shuffle output is small is switched to a broadcast at run time,
and larger sides stay sort-merge joins. Every dimension is reduced to one
row per key, so a left join never fans out. ``prepare`` does that once, when a
table is loaded, and stores the result: both sides of a join are then bare
shuffles, whose skewed partitions AQE can split; an aggregate between shuffle
and join would switch that off. A lookup given a table that is not prepared
reduces it at every call, storing those that grow. Country and lane tables are
bounded by the number of countries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import expressions as X
from ..session import cut_lineage
from .quality import dedupe_keep_first


@dataclass(frozen=True)
class Prepared:
    """A stored dimension with one row per key, as ``prepare`` made it; lookups join it as it is."""

    rows: DataFrame
    kind: str
    options: tuple


KEYS = {"vendors": ["vendor_name"], "routes": ["origin", "destination"], "risk": ["country_code"],
        "lanes": ["origin_country", "destination_country"], "holidays": ["country_code", "holiday_date"],
        "weather": ["origin_city", "departure_date"]}


def _normalised(dim: DataFrame, kind: str, options: tuple) -> DataFrame:
    """Key columns as the lookup of this kind compares them; ``options`` are that lookup's own."""
    if kind == "vendors" and options[0]:
        return dim.withColumn("vendor_name", X.sanitize_text("vendor_name"))
    if kind in ("risk", "holidays"):
        dim = dim.withColumn("country_code", _norm(F.col("country_code"), options[0]))
        return dim.withColumn("holiday_date", F.col("holiday_date").cast("date")) if kind == "holidays" else dim
    if kind == "lanes":
        return dim.withColumns({c: _norm(F.col(c), options[0]) for c in KEYS[kind]})
    return dim


def _options(kind: str, strict_case: bool, sanitize_vendor_key: bool) -> tuple:
    return {"vendors": (sanitize_vendor_key,), "risk": (strict_case,), "lanes": (strict_case,), "holidays": (strict_case,)}.get(kind, ())


def _unique(dim: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, for tables whose keys may collide once they are normalised: by ``load_seq`` where there is one (S4),
    the smallest row else."""
    if "load_seq" in dim.columns:
        return dedupe_keep_first(dim, keys, ["load_seq"]).drop("load_seq")
    rest = [c for c in dim.columns if c not in keys]
    return dim.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*")


def prepare(dim: DataFrame, kind: str, path: str, strict_case: bool = False, sanitize_vendor_key: bool = False) -> Prepared:
    """Store a dimension at ``path`` in the form that its lookup joins: keys normalised, one row per key.

    Done once, when the table is loaded. Of rows with equal keys the first
    loaded is kept where a ``load_seq`` column tells the order (S4), the smallest else.
    """
    options = _options(kind, strict_case, sanitize_vendor_key)
    _unique(_normalised(dim, kind, options), KEYS[kind]).write.mode("overwrite").parquet(path)
    return reopen(dim.sparkSession, kind, path, strict_case, sanitize_vendor_key)


def reopen(spark, kind: str, path: str, strict_case: bool = False, sanitize_vendor_key: bool = False) -> Prepared:
    """What ``prepare`` stored at ``path`` with these options."""
    return Prepared(spark.read.parquet(path), kind, _options(kind, strict_case, sanitize_vendor_key))


def prepare_dimensions(folder: str, strict_case: bool = False, sanitize_vendor_key: bool = False,
                       **dims: DataFrame) -> dict[str, Prepared]:
    """``prepare`` for the dimensions of ``enrich_shipments`` (vendors, routes, risk, lanes, holidays, weather)."""
    return {kind: prepare(d, kind, f"{folder}/{kind}", strict_case, sanitize_vendor_key) for kind, d in dims.items()}


def _one_per_key(dim: DataFrame | Prepared, kind: str, options: tuple = (), keep: Callable = cut_lineage) -> DataFrame:
    """Rows of a dimension with one row per key. ``keep`` stores those that are not prepared and may grow."""
    if isinstance(dim, Prepared):
        if (dim.kind, dim.options) != (kind, options):
            raise ValueError(f"prepared as {dim.kind} {dim.options}, looked up as {kind} {options}")
        return dim.rows
    return keep(_unique(_normalised(dim, kind, options), KEYS[kind]))


def _in_plan(dim: DataFrame) -> DataFrame:
    """Small tables (bounded by the number of countries) stay in the plan."""
    return dim


def lookup(fact: DataFrame, dim: DataFrame, fact_keys: list[Column], dim_keys: list[str],
           take: dict[str, tuple[str, object]], prefix: str) -> DataFrame:
    """Left-join ``dim`` on key equality and add ``take`` columns with defaults.

    ``take`` maps output name -> (dim column, default on miss). The dim key
    columns are renamed with ``prefix`` so repeated lookups never collide.
    ``dim`` has one row per key (``_one_per_key``).
    """
    d = dim.select(
        *[F.col(k).alias(f"{prefix}{k}") for k in dim_keys],
        *[F.col(src).alias(f"{prefix}v_{out}") for out, (src, _) in take.items()])
    cond = None
    for fk, dk in zip(fact_keys, dim_keys):
        c = fk == F.col(f"{prefix}{dk}")
        cond = c if cond is None else cond & c
    j = fact.join(d, cond, "left")
    return j.select(
        *fact.columns,
        *[F.coalesce(F.col(f"{prefix}v_{out}"), F.lit(default)).alias(out) for out, (_, default) in take.items()])


def _norm(c: Column, strict_case: bool) -> Column:
    return c if strict_case else F.upper(F.trim(c))


# J1 / J8 ----------------------------------------------------------------
def join_vendor(fact: DataFrame, vendors: DataFrame | Prepared, vendor_key: str = "vendor_name",
                sanitize_dimension_key: bool = False) -> DataFrame:
    """Vendor stats by name; miss -> rate .5, delay 2.0, count 0.

    ``vendor_key="destination_city"`` gives the training-path proxy (J8).
    ``sanitize_dimension_key`` applies the request sanitizer to the table key
    too, so that names such as 'A&B' still match a sanitized request.
    """
    v = _one_per_key(vendors, "vendors", (sanitize_dimension_key,))
    return lookup(fact, v, [F.col(vendor_key)], ["vendor_name"], {
        "vendor_on_time_rate": ("on_time_rate", C.VENDOR_DEFAULT_ON_TIME_RATE),
        "vendor_avg_delay_days": ("avg_delay_days", C.VENDOR_DEFAULT_AVG_DELAY_DAYS),
        "vendor_total_shipments": ("total_shipments", C.VENDOR_DEFAULT_TOTAL_SHIPMENTS),
    }, "_v_")


# J2 ---------------------------------------------------------------------
def join_route(fact: DataFrame, routes: DataFrame | Prepared, origin: str = "origin_city",
               destination: str = "destination_city") -> DataFrame:
    r = _one_per_key(routes, "routes")
    return lookup(fact, r, [F.col(origin), F.col(destination)], KEYS["routes"], {
        "route_avg_delay_days": ("avg_delay_days", C.ROUTE_DEFAULT_AVG_DELAY_DAYS),
        "route_historical_count": ("historical_count", C.ROUTE_DEFAULT_HISTORICAL_COUNT),
    }, "_r_")


# J3 / J4 ----------------------------------------------------------------
def join_country_risk(fact: DataFrame, risk: DataFrame | Prepared, country: str, side: str,
                      strict_case: bool = False, upper_fact: bool = True) -> DataFrame:
    """Country risk for one side ('origin' or 'destination').

    The scoring path upper-cases the request country; ``strict_case=True``
    compares that with the table key as stored (the reference behaviour);
    the default normalises both sides with upper(trim()).
    """
    fk = F.upper(F.col(country)) if upper_fact else F.col(country)
    r = _one_per_key(risk, "risk", (strict_case,), _in_plan)
    take = {
        f"{side}_lpi_score": ("lpi_score", C.COUNTRY_DEFAULT_LPI),
        f"{side}_customs_tier": ("customs_tier", C.COUNTRY_DEFAULT_CUSTOMS_TIER),
        f"{side}_geopolitical_risk": ("geopolitical_risk", C.COUNTRY_DEFAULT_GEO_RISK),
    }
    if side == "destination":
        take["destination_port_congestion"] = ("port_congestion", C.COUNTRY_DEFAULT_PORT_CONGESTION)
    return lookup(fact, r, [_norm(fk, strict_case)], ["country_code"], take, f"_c{side[0]}_")


# J5 ---------------------------------------------------------------------
def join_trade_lane(fact: DataFrame, lanes: DataFrame | Prepared, origin: str = "origin_country",
                    destination: str = "destination_country", strict_case: bool = False,
                    upper_fact: bool = True) -> DataFrame:
    o = F.upper(F.col(origin)) if upper_fact else F.col(origin)
    d = F.upper(F.col(destination)) if upper_fact else F.col(destination)
    ln = _one_per_key(lanes, "lanes", (strict_case,), _in_plan)
    return lookup(fact, ln, [_norm(o, strict_case), _norm(d, strict_case)],
                  ["origin_country", "destination_country"],
                  {"lane_avg_customs_days": ("avg_customs_days", C.LANE_DEFAULT_CUSTOMS_DAYS)}, "_l_")


# J6 ---------------------------------------------------------------------
def join_weather(fact: DataFrame, weather: DataFrame | Prepared, city: str = "origin_city",
                 date: str = "planned_departure_date") -> DataFrame:
    """Weather risk by (origin city, ISO date text); miss or null date -> 0.1.

    The weather table grows with city-days, so no hint: broadcast only
    when the planner / AQE measure it small, else a shuffle join. Where days
    were fetched twice, ``load_seq`` decides (the first load wins, S4).
    """
    w = _one_per_key(weather, "weather")
    return lookup(fact, w, [F.col(city), X.date_key(F.col(date))], KEYS["weather"],
                  {"weather_risk_score": ("weather_risk_score", C.WEATHER_DEFAULT_RISK)}, "_w_")


# J7 ---------------------------------------------------------------------
def holiday_flag(fact: DataFrame, holidays: DataFrame | Prepared, country: str = "origin_country",
                 date: str = "planned_departure_date", out: str = "is_origin_holiday",
                 strict_case: bool = False, upper_fact: bool = True) -> DataFrame:
    """1 when (country, date) is in the calendar, else 0 (mark join).

    The calendar is reduced to distinct keys first so the left join is an
    existence test.
    """
    fk = F.upper(F.col(country)) if upper_fact else F.col(country)
    if isinstance(holidays, Prepared):
        days = _one_per_key(holidays, "holidays", (strict_case,))
    else:
        days = _normalised(holidays, "holidays", (strict_case,)).select(*KEYS["holidays"]).distinct()
    keys = days.select(F.col("country_code").alias("_h_c"), F.col("holiday_date").alias("_h_d"), F.lit(1).alias("_h_hit"))
    j = fact.join(keys, (_norm(fk, strict_case) == F.col("_h_c")) & (F.col(date).cast("date") == F.col("_h_d")), "left")
    return j.select(*fact.columns, F.coalesce(F.col("_h_hit"), F.lit(0)).alias(out))


# J9 ---------------------------------------------------------------------
def missing_weather_pairs(pairs: DataFrame, done: DataFrame, city: str = "city",
                          date: str = "departure_date") -> DataFrame:
    """Pending (city, date) pairs not yet fetched (anti join on the done keys)."""
    d = done.select(F.col("origin_city").alias("_d_city"), F.col("departure_date").alias("_d_date"))
    return pairs.join(d, (F.col(city) == F.col("_d_city")) & (F.col(date) == F.col("_d_date")), "left_anti")


# J12 --------------------------------------------------------------------


def enrich_shipments(requests: DataFrame, vendors: DataFrame | Prepared, routes: DataFrame | Prepared, risk: DataFrame | Prepared,
                     lanes: DataFrame | Prepared, holidays: DataFrame | Prepared, weather: DataFrame | Prepared,
                     strict_case: bool = False, sanitize_vendor_key: bool = False,
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """Scoring-path enrichment: requests -> the 27 model features.

    Chain of left lookups (vendor, route, country x2, lane, holiday,
    weather) followed by one select that applies the request defaults.
    ``keep`` columns of the requests are carried through unchanged.
    """
    d = C.SCORING_DEFAULTS
    x = join_vendor(requests, vendors, sanitize_dimension_key=sanitize_vendor_key)
    x = join_route(x, routes)
    x = join_country_risk(x, risk, "origin_country", "origin", strict_case)
    x = join_country_risk(x, risk, "destination_country", "destination", strict_case)
    x = join_trade_lane(x, lanes, strict_case=strict_case)
    x = holiday_flag(x, holidays, strict_case=strict_case)
    x = join_weather(x, weather)
    dep = F.col("planned_departure_date")
    dow = X.day_of_week(dep)
    feats = {
        "cargo_weight_kg": X.with_default("cargo_weight_kg", d["cargo_weight_kg"]).cast("double"),
        "cargo_volume_m3": X.with_default("cargo_volume_m3", d["cargo_volume_m3"]).cast("double"),
        "distance_km": X.with_default("distance_km", d["distance_km"]).cast("double"),
        "num_stops": X.with_default("num_stops", d["num_stops"]).cast("int"),
        "planned_transit_days": X.with_default("scheduled_transit_days", d["scheduled_transit_days"]).cast("int"),
        "departure_day_of_week": dow,
        "departure_month": X.month_of(dep),
        "departure_is_weekend": X.is_weekend(dow),
        "is_hazmat": X.boolean_to_int("is_hazmat"),
        "temperature_sensitive": X.boolean_to_int("temperature_sensitive"),
        "weather_risk_score": F.col("weather_risk_score"),
        "vendor_on_time_rate": F.col("vendor_on_time_rate"),
        "vendor_avg_delay_days": F.col("vendor_avg_delay_days"),
        "route_avg_delay_days": F.col("route_avg_delay_days"),
        "is_cross_border": X.cross_border_flag(F.coalesce("origin_country", F.lit(C.RAW_DEFAULT_COUNTRY)),
                                               F.coalesce("destination_country", F.lit(C.RAW_DEFAULT_COUNTRY)),
                                               null_text=None),
        "origin_lpi_score": F.col("origin_lpi_score"),
        "destination_lpi_score": F.col("destination_lpi_score"),
        "origin_customs_tier": F.col("origin_customs_tier").cast("int"),
        "destination_customs_tier": F.col("destination_customs_tier").cast("int"),
        "origin_geopolitical_risk": F.col("origin_geopolitical_risk"),
        "destination_geopolitical_risk": F.col("destination_geopolitical_risk"),
        "destination_port_congestion": F.col("destination_port_congestion"),
        "is_origin_holiday": F.col("is_origin_holiday"),
        "is_destination_holiday": F.lit(0),
        "lane_avg_customs_days": F.col("lane_avg_customs_days"),
        "carrier_type": X.with_default("carrier_type", d["carrier_type"]),
        "priority_level": X.with_default("priority_level", d["priority_level"]),
    }
    ids = ["shipment_id", "vendor_name", "origin_city", "destination_city",
           "origin_country", "destination_country", "planned_departure_date"]
    return x.select(*ids, *keep, *[v.alias(k) for k, v in feats.items()])
