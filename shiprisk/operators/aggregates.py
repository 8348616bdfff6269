"""Aggregations.

All are plain groupBy/agg: Spark runs a partial (map-side) aggregate
before the shuffle, so a hot key (a vendor or city holding a third of the
rows) costs one small partial row per task, not a third of the data in
one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X


# A1 ---------------------------------------------------------------------
def table_counts(tables: dict[str, DataFrame], must_have_rows: list[str] | None = None) -> DataFrame:
    """COUNT(*) per table plus readiness (every required table non-empty).

    One aggregate per table, unioned into a single small result.
    """
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    counts = reduce(DataFrame.unionByName, parts)
    required = must_have_rows if must_have_rows is not None else list(tables)
    ready = counts.agg(F.min(F.when(F.col("table_name").isin(*required), F.col("row_count") > 0)).alias("all_ready"))
    return counts.crossJoin(ready)  # one-row right side


# A2 ---------------------------------------------------------------------
def distinct_city_dates(df: DataFrame, city="city", country="country", date="departure_date") -> DataFrame:
    return df.select(city, country, date).dropDuplicates()


# A3 ---------------------------------------------------------------------
def fetch_ranges(pairs: DataFrame, city="city", country="country", date="departure_date") -> DataFrame:
    """Per (city, country): first and last pending date (ISO text sorts as dates)."""
    return pairs.groupBy(city, country).agg(F.min(date).alias("start_date"), F.max(date).alias("end_date"))


# A4 ---------------------------------------------------------------------
def fit_scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """One row per feature: mean and population std (std 0 -> 1).

    A constant column is detected by min = max: a float residue could hide
    a zero deviation otherwise. One pass, one aggregation for all features:
    each row is turned into one row a feature, so that the aggregate has four
    functions and not four a feature, whose method would be too long to compile.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f).cast("double").alias("_x")) for i, f in enumerate(features)])
    x = F.col("_x")
    found = df.select(F.inline(pairs)).groupBy("_i").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("_min"), F.max(x).alias("_max"))
    named = F.array(*[F.struct(F.lit(i).alias("_n"), F.lit(f).alias("feature")) for i, f in enumerate(features)])
    names = df.sparkSession.range(0, 1, 1, 1).select(F.inline(named))  # a row for each feature, also without rows
    return names.join(found, F.col("_n") == F.col("_i"), "left").select(
        "feature", "mean", F.when(F.col("_min") == F.col("_max"), F.lit(1.0)).otherwise(F.col("std")).alias("std"))


# A5 ---------------------------------------------------------------------
def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced class weights n / (classes * n_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    totals = counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(totals).select(  # totals is one row
        label, "n_c", (F.col("n") / (F.col("k") * F.col("n_c"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(w), label, "left")  # one row per class


# A9 / A10 ---------------------------------------------------------------
def _delivery_stats(real: str, sched: str):
    on_time = (F.col(real) <= F.col(sched)).cast("double")
    return [F.avg(on_time).alias("on_time_rate"),
            F.avg(X.delay_days(F.col(real).cast("double"), F.col(sched).cast("double"))).alias("avg_delay_days")]


def build_vendor_stats(shipments: DataFrame, vendor: str = "vendor_name",
                       real: str = "real_days", sched: str = "scheduled_days") -> DataFrame:
    """vendor_stats rows from delivered shipments: on-time rate, mean delay, count."""
    on_time_rate, avg_delay = _delivery_stats(real, sched)
    return (shipments.groupBy(F.col(vendor).alias("vendor_name"))
            .agg(on_time_rate, avg_delay, F.count(F.lit(1)).cast("int").alias("total_shipments")))


def build_route_stats(shipments: DataFrame, origin: str = "origin_city", destination: str = "destination_city",
                      real: str = "real_days", sched: str = "scheduled_days") -> DataFrame:
    """route_stats rows: mean delay and count per (origin, destination)."""
    _, avg_delay = _delivery_stats(real, sched)
    return (shipments.groupBy(F.col(origin).alias("origin"), F.col(destination).alias("destination"))
            .agg(avg_delay, F.count(F.lit(1)).cast("int").alias("historical_count")))


# A11 --------------------------------------------------------------------
def geocode_failures(cities: DataFrame, lat: str = "lat") -> DataFrame:
    return cities.agg(F.count_if(F.col(lat).isNull()).alias("failed"), F.count(F.lit(1)).alias("total"))
