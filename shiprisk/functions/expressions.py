"""Scalar Column expressions.

Pure functions from Columns to a Column: no session, no action. They stay
inside whole-stage codegen (only built-in functions, no Python UDF).
ANSI mode is on in Spark 4, so text is always parsed with try_* forms.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map_lit(mapping: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


# P1 / P2 --------------------------------------------------------------
def map_carrier_type(mode) -> Column:
    """Shipping mode text -> carrier type; unknown or null -> FTL."""
    return F.coalesce(F.element_at(_map_lit(C.SHIPPING_MODE_TO_CARRIER), _c(mode)), F.lit(C.CARRIER_FALLBACK))


def map_priority(mode) -> Column:
    """Shipping mode text -> priority level; unknown or null -> MEDIUM."""
    return F.coalesce(F.element_at(_map_lit(C.SHIPPING_MODE_TO_PRIORITY), _c(mode)), F.lit(C.PRIORITY_FALLBACK))


# P3 --------------------------------------------------------------------
def safe_numeric(text, default: float) -> Column:
    """Text -> double; unparsable, null or NaN -> default."""
    parsed = _c(text).cast("string").try_cast("double")
    return F.coalesce(F.nanvl(parsed, F.lit(None).cast("double")), F.lit(float(default)))


def safe_int(text, default: float) -> Column:
    """Text -> number -> int by truncation (quantity)."""
    return safe_numeric(text, default).cast("long").cast("int")


# P4 --------------------------------------------------------------------
def delay_days(real, sched) -> Column:
    return F.greatest(F.lit(0.0), _c(real) - _c(sched))


def delay_flag(real, sched) -> Column:
    return (_c(real) > _c(sched)).cast("int")


# P5 --------------------------------------------------------------------
def cargo_weight_from_price(price) -> Column:
    return F.least(F.greatest(_c(price) * C.WEIGHT_PER_PRICE, F.lit(C.WEIGHT_MIN)), F.lit(C.WEIGHT_MAX))


def cargo_volume_from_weight(weight) -> Column:
    return _c(weight) / C.WEIGHT_PER_VOLUME


# P6 --------------------------------------------------------------------
def parse_order_date(text, fmt: str = C.RAW_DATE_FORMAT) -> Column:
    """Order timestamp text -> timestamp; bad text -> null."""
    return F.try_to_timestamp(_c(text), F.lit(fmt))


# P7 --------------------------------------------------------------------
def day_of_week(d) -> Column:
    """Monday = 0 ... Sunday = 6; null date -> 0."""
    return F.coalesce(F.weekday(_c(d)), F.lit(0))


def month_of(d) -> Column:
    return F.coalesce(F.month(_c(d)), F.lit(1))


def is_weekend(dow) -> Column:
    return _c(dow).isin(*C.WEEKEND_DAYS).cast("int")


# P8 --------------------------------------------------------------------
def cross_border_flag(origin_country, destination_country, null_text: str | None = C.NULL_TEXT) -> Column:
    """1 when the countries differ (case-sensitive).

    ``null_text`` is the text a missing value has (training path: two
    missing countries compare equal). ``None`` keeps SQL null semantics.
    """
    o, d = _c(origin_country), _c(destination_country)
    if null_text is not None:
        o, d = F.coalesce(o, F.lit(null_text)), F.coalesce(d, F.lit(null_text))
    return (o != d).cast("int")


# P9 --------------------------------------------------------------------
def date_key(d) -> Column:
    return F.date_format(_c(d), "yyyy-MM-dd")


# P10 -------------------------------------------------------------------
def sanitize_text(text) -> Column:
    """Keep only ASCII letters, digits, whitespace, '_' and '-'; trim whitespace.

    Python's ``\\s`` is Unicode-aware on str, so the Java pattern uses (?U).
    Text that one plain pattern shows to be clean already is kept as it is.
    """
    raw = _c(text).cast("string")
    kept = F.regexp_replace(raw, r"(?U)[^A-Za-z0-9\s_\-]", "")
    return F.when(raw.rlike(r"\A(?! )[A-Za-z0-9 _-]*+(?<! )\z"), raw).otherwise(F.regexp_replace(kept, r"(?U)^\s+|\s+$", ""))


# P11 -------------------------------------------------------------------
def upper_country(c) -> Column:
    return F.upper(_c(c))


# P12 -------------------------------------------------------------------
_SPLIT = 134217729.0  # 2**27 + 1: splits a double into two 26-bit halves


def round_half_even_exact(x, digits: int) -> Column:
    """Round to ``digits`` places on the exact binary value, ties to even.

    This is Python's round(); Spark's round() works on the shortest decimal
    text instead and differs on near-ties (0.18055 -> 0.1806 vs 0.1805).
    y = x * 10^d is split into y + err exactly (Dekker's product), so the
    tie test sees the true value. Plain double arithmetic: stays in codegen.
    """
    x = _c(x)
    p = float(10 ** digits)
    y = x * p
    t = x * _SPLIT
    hi = t - (t - x)
    lo = x - hi
    err = (hi * p - y) + lo * p
    n = F.floor(y).cast("double")
    frac = y - n
    up = (frac > 0.5) | ((frac == 0.5) & ((err > 0) | ((err == 0) & (F.pmod(n, F.lit(2.0)) != 0))))
    return (n + up.cast("double")) / p


def sql_round_half_even_exact(expr: str, digits: int) -> str:
    """The same rounding rule as SQL text (for the DuckDB oracle)."""
    p = f"CAST({10 ** digits} AS DOUBLE)"
    x = f"({expr})"
    y = f"({x} * {p})"
    t = f"({x} * CAST(134217729 AS DOUBLE))"
    hi = f"({t} - ({t} - {x}))"
    err = f"(({hi} * {p} - {y}) + ({x} - {hi}) * {p})"
    n = f"CAST(floor({y}) AS DOUBLE)"
    frac = f"({y} - {n})"
    up = (f"CASE WHEN {frac} > 0.5 THEN 1.0 WHEN {frac} < 0.5 THEN 0.0 WHEN {err} > 0 THEN 1.0 "
          f"WHEN {err} < 0 THEN 0.0 WHEN {n} - 2 * floor({n} / 2) = 0 THEN 0.0 ELSE 1.0 END")
    return f"(({n} + {up}) / {p})"


def weather_risk_score(precip, wind, snow) -> Column:
    """0..1 risk from daily precipitation (mm), wind (km/h), snowfall (cm)."""
    def part(x, sat, w):
        return F.least(F.coalesce(_c(x), F.lit(0.0)) / sat, F.lit(1.0)) * w
    s = (part(precip, C.WEATHER_PRECIP_SAT, C.WEATHER_PRECIP_WEIGHT)
         + part(wind, C.WEATHER_WIND_SAT, C.WEATHER_WIND_WEIGHT)
         + part(snow, C.WEATHER_SNOW_SAT, C.WEATHER_SNOW_WEIGHT))
    return round_half_even_exact(F.least(s, F.lit(1.0)), 4)


def sql_weather_risk_score(precip: str, wind: str, snow: str) -> str:
    s = (f"least(least(COALESCE({precip}, 0.0) / 30.0, 1.0) * 0.5 + least(COALESCE({wind}, 0.0) / 70.0, 1.0) * 0.35"
         f" + least(COALESCE({snow}, 0.0) / 10.0, 1.0) * 0.15, 1.0)")
    return sql_round_half_even_exact(s, 4)


# P13 -------------------------------------------------------------------
def country_risk_score(lpi, tier, geo, port) -> Column:
    return (F.lit(5.0) - _c(lpi)) * 2 + _c(tier) * 1.5 + _c(geo) * 5.0 + _c(port) * 0.5


def country_risk_category(score) -> Column:
    s = _c(score)
    return (F.when(s > C.COUNTRY_SCORE_HIGH, "HIGH")
             .when(s > C.COUNTRY_SCORE_MEDIUM, "MEDIUM").otherwise("LOW"))


# P14 -------------------------------------------------------------------
def vendor_tier(rate) -> Column:
    r = _c(rate)
    return (F.when(r >= C.TIER_EXCELLENT_MIN_RATE, "EXCELLENT")
             .when(r >= C.TIER_AVERAGE_MIN_RATE, "AVERAGE").otherwise("POOR"))


def adjusted_probability(p, rate) -> Column:
    """Vendor-tier shift of the raw probability, clamped to 0..1."""
    p, r = _c(p), _c(rate)
    span = C.TIER_EXCELLENT_MIN_RATE - C.TIER_AVERAGE_MIN_RATE
    shifted = (F.when(r >= C.TIER_EXCELLENT_MIN_RATE, p + C.TIER_EXCELLENT_SHIFT)
                .when(r >= C.TIER_AVERAGE_MIN_RATE,
                      p + (r - C.TIER_AVERAGE_MIN_RATE) / span * C.TIER_EXCELLENT_SHIFT)
                .otherwise(p + C.TIER_POOR_SHIFT))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), shifted))


# P15 -------------------------------------------------------------------
def risk_percent(adjusted, raw) -> Column:
    """Rounded percent (half up), adjusted probability first, raw as fallback."""
    return F.floor(F.coalesce(_c(adjusted), _c(raw)) * 100 + 0.5).cast("int")


def risk_band(pct) -> Column:
    p = _c(pct)
    return (F.when(p >= C.BAND_HIGH_PCT, "HIGH RISK")
             .when(p >= C.BAND_MODERATE_PCT, "MODERATE").otherwise("LOW RISK"))


# P16 -------------------------------------------------------------------
def reason_display(reason) -> Column:
    r = _c(reason)
    return F.when(r.isNull() | (r == ""), F.lit("None detected")).otherwise(r)


def headline(delayed) -> Column:
    return F.when(_c(delayed), F.lit("Delay Likely")).otherwise(F.lit("On-Time Expected"))


def on_time_rate_display(rate) -> Column:
    """Percent text with no decimals (half up), or N/A when the rate is 0 or null."""
    r = _c(rate)
    pct = F.floor(r * 100 + 0.5).cast("long").cast("string")
    return F.when(r.isNull() | (r == 0), F.lit("N/A")).otherwise(F.concat(pct, F.lit("%")))


# P17 / P18 / P19 --------------------------------------------------------
def boolean_to_int(flag) -> Column:
    return F.coalesce(_c(flag), F.lit(False)).cast("int")


def with_default(c, default) -> Column:
    return F.coalesce(_c(c), F.lit(default))


# P21 -------------------------------------------------------------------
def central_angle(lat1, lon1, lat2, lon2) -> Column:
    """Haversine central angle in radians."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    l1, l2 = F.radians(_c(lon1)), F.radians(_c(lon2))
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((l2 - l1) / 2), 2)
    return F.asin(F.sqrt(h)) * 2


def geodesic_km(lat1, lon1, lat2, lon2) -> Column:
    return central_angle(lat1, lon1, lat2, lon2) * C.EARTH_RADIUS_KM


# P22 -------------------------------------------------------------------
_OPS = {"ge": lambda a, v: a >= v, "gt": lambda a, v: a > v, "lt": lambda a, v: a < v}


def bounds_hold(lat, lon, bounds) -> Column:
    axes = {"lat": _c(lat), "lon": _c(lon)}
    cond = F.lit(True)
    for axis, op, v in bounds:
        cond = cond & _OPS[op](axes[axis], F.lit(float(v)))
    return cond


def geo_region(lat, lon) -> Column:
    """Broad region of a point; first matching rule wins, else 'other'."""
    expr = None
    for region, bounds in C.REGION_RULES:
        cond = bounds_hold(lat, lon, bounds)
        expr = F.when(cond, F.lit(region)) if expr is None else expr.when(cond, F.lit(region))
    return expr.otherwise(F.lit(C.REGION_OTHER))
