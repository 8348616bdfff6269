"""Keys, checks and validation."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import expressions as X


# S4 ---------------------------------------------------------------------
def dedupe_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Primary-key conflict: keep the first row per key by ``order``.

    An aggregate (min over a struct led by the order columns), not a
    row_number window: each task first reduces its own rows, so a key that
    holds a third of all rows reaches the shuffle as one row a task. A struct
    does not fit a hash aggregate's buffer, so each task sorts its rows by key
    (spilling to disk) instead. Ties on ``order`` are broken by the remaining
    columns, so the result is deterministic.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("_first")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order + rest]).select(*df.columns)


# S5 ---------------------------------------------------------------------
def violation_counts(df: DataFrame, rules: list[str], not_null: list[str] | None = None) -> DataFrame:
    """One row: count of rows breaking each rule (NOT NULL included), in one pass."""
    not_null = not_null if not_null is not None else []
    aggs = [F.count(F.lit(1)).alias("row_count")]
    for i, r in enumerate(rules):
        aggs.append(F.count_if(~F.coalesce(F.expr(r), F.lit(True))).alias(f"rule_{i}"))
    for c in not_null:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"null_{c}"))
    return df.agg(*aggs)


def row_ok(rules: list[str], not_null: list[str] | None = None) -> Column:
    ok = F.lit(True)
    for r in rules:
        ok = ok & F.coalesce(F.expr(r), F.lit(True))
    for c in not_null or []:
        ok = ok & F.col(c).isNotNull()
    return ok


def check_constraints(df: DataFrame, rules: list[str], not_null: list[str] | None = None,
                      mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Split a load into (good, violations).

    ``strict`` reproduces a whole-statement reject: if any row breaks a rule
    the good side is empty. ``quarantine`` keeps the good rows. A null rule
    result counts as passing, as a SQL CHECK does.
    """
    ok = row_ok(rules, not_null)
    flagged = df.withColumn("_ok", ok)
    bad = flagged.where(~F.col("_ok")).drop("_ok")
    if mode == "quarantine":
        return flagged.where(F.col("_ok")).drop("_ok"), bad
    # strict: keep rows only when no row fails; a semi join against a one-row "clean" flag
    clean = flagged.agg(F.min(F.col("_ok").cast("int")).alias("_clean")).where(F.coalesce("_clean", F.lit(1)) == 1)
    good = flagged.drop("_ok").crossJoin(clean).drop("_clean")
    return good, bad


# F1 ---------------------------------------------------------------------
def validate_shipments(df: DataFrame, as_of: str | _dt.date) -> DataFrame:
    """Apply the scoring-request rules; keep every row.

    Adds sanitized text fields (names sanitized before the length checks),
    ``errors`` (array of rule names broken, in rule order) and ``is_valid``.
    Sanitizing is its own projection, so each regex runs once per value;
    the error list drops its nulls with array_except, which stays in
    whole-stage codegen (a filter lambda would not).
    """
    as_of_d = F.to_date(F.lit(str(as_of)))
    names = ("shipment_id", "vendor_name", "origin_city", "destination_city")
    out = df.withColumns({c: X.sanitize_text(F.col(c)) for c in names})
    out = out.withColumn("num_stops", F.coalesce(F.col("num_stops"), F.lit(1)))
    L = C.LIMITS
    col = F.col

    def in_range(c: str, lo, hi, lo_inclusive=False):
        x = col(c)
        return ((x >= lo) if lo_inclusive else (x > lo)) & (x <= hi)

    checks = [
        ("shipment_id_length", F.length(col("shipment_id")).between(*L["shipment_id_len"])),
        ("vendor_name_length", F.length(col("vendor_name")).between(*L["vendor_name_len"])),
        ("origin_city_length", F.length(col("origin_city")).between(*L["city_len"])),
        ("destination_city_length", F.length(col("destination_city")).between(*L["city_len"])),
        ("origin_country_length", F.length(col("origin_country")).between(*L["country_len"])),
        ("destination_country_length", F.length(col("destination_country")).between(*L["country_len"])),
        ("departure_before_as_of", col("planned_departure_date") >= as_of_d),
        ("scheduled_transit_days_range", in_range("scheduled_transit_days", *L["scheduled_transit_days"])),
        ("cargo_weight_kg_range", in_range("cargo_weight_kg", *L["cargo_weight_kg"])),
        ("cargo_volume_m3_range", in_range("cargo_volume_m3", *L["cargo_volume_m3"])),
        ("distance_km_range", in_range("distance_km", *L["distance_km"])),
        ("num_stops_range", in_range("num_stops", *L["num_stops"], lo_inclusive=True)),
        ("carrier_type_value", col("carrier_type").isin(*C.CARRIER_TYPES)),
        ("is_hazmat_present", col("is_hazmat").isNotNull()),
        ("priority_level_value", col("priority_level").isin(*C.PRIORITY_LEVELS)),
        ("temperature_sensitive_present", col("temperature_sensitive").isNotNull()),
    ]
    flagged = F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in checks])
    errors = F.array_except(flagged, F.array(F.lit(None).cast("string")))
    return out.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


# F2 / F3 / F4 -----------------------------------------------------------
def delayed_subset(df: DataFrame, flag: str = "delay_flag", days: str = "delay_days") -> DataFrame:
    return df.where((F.col(flag) == 1) & F.col(days).isNotNull() & (F.col(days) > 0))


def drop_unparsed_dates(df: DataFrame, col: str) -> DataFrame:
    return df.dropna(subset=[col])


def not_after_as_of(df: DataFrame, date_text: str, as_of: str | _dt.date) -> DataFrame:
    """ISO date text <= as_of (text comparison, as ISO text sorts as dates)."""
    return df.where(F.col(date_text) <= F.lit(str(as_of)))


# F5 / L1 ----------------------------------------------------------------
def point_lookup(dim: DataFrame, where: dict, first_only: bool = True) -> DataFrame:
    """Equality lookup; the ad-hoc form returns the first matching row or none."""
    cond = F.lit(True)
    for k, v in where.items():
        cond = cond & (F.col(k) == F.lit(v))
    out = dim.where(cond)
    return out.limit(1) if first_only else out
