"""Shipment-shaped inputs derived by Spark from the driver's parquet tables.

The driver ships TPC-H-like tables (lineitem, orders, supplier, customer,
nation, events). This module maps them onto the engine's inputs (the rules
are in FIXTURES.md §6): a shipments table, the dimension tables, a raw-text
order table, given model scores, city coordinates, and the events table as
prediction log / pings / service metrics. Everything is lazy; every output
grows with the input tables.

Scale notes: lineitem x orders is the one large-large join (sort-merge on
the order key); customers join the orders before it, so lines are not
shuffled for them, and lines are dealt out by their order, once, before they
get their texts. No other join has a hint: the planner (and AQE at run time)
picks broadcast only when the measured size allows it. Nation is tiny and
broadcast by its size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STAGED: dict = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """``build()`` written once per session as parquet in the shared folder, then read back.

    The derived inputs (the joined shipments, the stats tables built from
    them) are stored tables in a deployment; staging them keeps every query
    from recomputing the five-way join, and the parquet copy still gets
    column pruning and filter pushdown. Files live under the session's
    ``spark.checkpoint.dir``, so they survive executor loss.
    """
    from ..session import ensure_checkpoint_dir
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        base = ensure_checkpoint_dir(spark).rstrip("/")
        tag = hashlib.md5(sf_dir.encode()).hexdigest()[:10]
        path = f"{base}/shiprisk-staged/{spark.sparkContext.applicationId}/{tag}/{name}"
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem: the shipments view (unique shipment_id), staged."""
    return staged(spark, sf_dir, "shipments", lambda: build_shipments(spark, sf_dir))


def build_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem: the shipments view (unique shipment_id)."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    shipment_id = F.concat_ws("-", *[F.col(k).cast("string") for k in keys])
    li = table(spark, sf_dir, "lineitem").select(*keys, "l_quantity", "l_extendedprice")
    prio = F.col("o_orderpriority")
    urgency = F.when(prio == "1-URGENT", 0).when(prio == "2-HIGH", 1).when(prio == "3-MEDIUM", 2).when(prio == "4-NOT SPECIFIED", 3).otherwise(4)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", urgency.alias("urgency"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    sn = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sn_key"), F.col("n_name").alias("origin_country"))
    cn = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cn_key"), F.col("n_name").alias("destination_country"))
    o = o.join(c, o.o_custkey == c.c_custkey).drop("c_custkey")
    # Lines are shuffled once, by their order, while they hold numbers only: the join with the orders, merged at any
    # size, takes that shuffle as its own, so the files, and every later read, are even, and what is shuffled grows
    # as the lines do. Asking the plan for its width would run its joins.
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    j = li.repartition(width, "l_orderkey").join(o.hint("merge"), li.l_orderkey == o.o_orderkey).drop("o_orderkey")
    j = (j.join(s, j.l_suppkey == s.s_suppkey)
          .join(sn, s.s_nationkey == sn.sn_key)
          .join(cn, j.c_nationkey == cn.cn_key))
    urgency = F.col("urgency")
    return j.select(
        shipment_id.alias("shipment_id"),
        F.col("s_name").alias("vendor_name"),
        F.concat(F.lit("CITY_"), (F.col("l_suppkey") % 40).cast("string")).alias("origin_city"),
        F.concat(F.lit("CITY_"), (F.col("o_custkey") % 40).cast("string")).alias("destination_city"),
        "origin_country", "destination_country",
        F.col("o_orderdate").cast("date").alias("planned_departure_date"),
        F.when(urgency == 0, "Same Day").when(urgency == 1, "First Class")
         .when(urgency == 2, "Second Class").when(urgency == 3, "Standard Class")
         .alias("shipping_mode"),
        F.when(urgency < 3, urgency).otherwise(4).alias("scheduled_days"),
        F.greatest(F.lit(0).cast("long"), F.col("l_linenumber") - 1 - F.col("l_suppkey") % 4).alias("real_days"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("product_price"),
        "l_linenumber", "l_partkey", "l_suppkey",
    )


def typed_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as scoring requests (the §1.3 record) with deterministic fields.

    cargo/distance/stops/flags are derived from the line so that the
    validation rules are exercised (some rows break limits on purpose).
    """
    sh = shipments(spark, sf_dir)
    carrier = F.element_at(F.array(*[F.lit(c) for c in C.CARRIER_TYPES]),
                           (F.col("l_partkey") % 5 + 1).cast("int"))
    prio = F.element_at(F.array(*[F.lit(p) for p in C.PRIORITY_LEVELS]),
                        (F.col("l_suppkey") % 4 + 1).cast("int"))
    return sh.select(
        "shipment_id", "vendor_name", "origin_city", "origin_country",
        "destination_city", "destination_country", "planned_departure_date",
        (F.col("scheduled_days") + 1).cast("int").alias("scheduled_transit_days"),
        (F.col("product_price") * 0.5).alias("cargo_weight_kg"),
        (F.col("quantity") * 4.0).alias("cargo_volume_m3"),
        (F.col("l_partkey") % 250 * 100.0 + 50.0).alias("distance_km"),
        (F.col("l_linenumber") - 1).cast("int").alias("num_stops"),
        carrier.alias("carrier_type"),
        (F.col("l_partkey") % 11 == 0).alias("is_hazmat"),
        prio.alias("priority_level"),
        (F.col("l_suppkey") % 3 == 0).alias("temperature_sensitive"),
        "l_partkey", "l_suppkey", "l_linenumber", *_given_score_columns(),
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw order text columns (CSV-like), with unparsable values on purpose."""
    sh = shipments(spark, sf_dir)
    ln = F.col("l_linenumber")
    return sh.select(
        "shipment_id", "shipping_mode",
        F.when(ln == 7, "bad").otherwise(F.col("real_days").cast("string")).alias("real_days_text"),
        F.when(ln == 6, "n/a").otherwise(F.col("scheduled_days").cast("string")).alias("sched_days_text"),
        F.when(ln == 5, "many").otherwise(F.col("quantity").cast("string")).alias("quantity_text"),
        F.when(ln == 4, F.lit(None).cast("string"))
         .otherwise(F.col("product_price").cast("string")).alias("price_text"),
        F.when((ln == 3) & (F.col("l_suppkey") % 2 == 0), "unknown")
         .otherwise(F.date_format(F.col("planned_departure_date").cast("timestamp"), C.RAW_DATE_FORMAT))
         .alias("order_date_text"),
        "origin_city", "destination_city", "origin_country", "destination_country",
    )


def vendor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vendor_stats built by A9 over the shipments, some suppliers left out (lookup misses)."""
    from ..operators.aggregates import build_vendor_stats

    def build():
        return build_vendor_stats(shipments(spark, sf_dir).where(F.col("l_suppkey") % 10 != 7))
    return staged(spark, sf_dir, "vendor_stats", build)


def route_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.aggregates import build_route_stats

    def build():
        rs = build_route_stats(shipments(spark, sf_dir))
        return rs.where(F.substring_index("origin", "_", -1).cast("int") <= 30)
    return staged(spark, sf_dir, "route_stats", build)


def country_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return (table(spark, sf_dir, "nation").where(k % 5 != 4).select(
        F.col("n_name").alias("country_code"),
        (F.lit(1.0) + (k % 9) * 0.5).alias("lpi_score"),
        (F.lit(1) + k % 4).cast("int").alias("customs_tier"),
        ((k % 11) / 10.0).alias("geopolitical_risk"),
        ((k % 7) * 1.5).alias("port_congestion")))


def trade_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("origin_country"))
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("destination_country"))
    # nation x nation: both sides are the nation table (bounded by the number of countries).
    pairs = a.join(F.broadcast(b), (F.col("a") != F.col("b")) & ((F.col("a") + F.col("b")) % 3 != 0))
    return pairs.select(
        "origin_country", "destination_country",
        (F.lit(1.0) + (F.col("a") * F.col("b") % 20) / 10.0).alias("avg_customs_days"),
        F.lit("INTERNATIONAL").alias("lane_type"),
        (F.lit(1.0) - (F.col("a") % 5) / 10.0).alias("confidence"))


def holiday_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(k, "n_name")
    return n.select(
        F.col("n_name").alias("country_code"),
        F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("y"), k,
    ).select(
        "country_code",
        F.date_add(F.make_date("y", F.lit(1), F.lit(1)), (F.col("n_nationkey") * 10).cast("int")).alias("holiday_date"),
        F.concat(F.lit("HOLIDAY_"), F.col("n_nationkey").cast("string")).alias("holiday_name"),
        F.lit(1.0).alias("risk_weight"))


def weather_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather per (origin city, date) seen in the shipments, day 13 missing (staged)."""
    return staged(spark, sf_dir, "weather_historical", lambda: build_weather_historical(spark, sf_dir))


def build_weather_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.expressions import weather_risk_score
    d = F.col("planned_departure_date")
    pairs = (shipments(spark, sf_dir).select("origin_city", d)
             .where(d.isNotNull() & (F.dayofmonth(d) != 13)).distinct())
    day, month = F.dayofmonth(d), F.month(d)
    out = pairs.select(
        "origin_city",
        F.date_format(d, "yyyy-MM-dd").alias("departure_date"),
        (day % 40).cast("double").alias("precipitation_mm"),
        (month * 7).cast("double").alias("windspeed_max_kmh"),
        ((day * month) % 15).cast("double").alias("snowfall_cm"))
    return out.withColumn("weather_risk_score",
                          weather_risk_score("precipitation_mm", "windspeed_max_kmh", "snowfall_cm"))


def _given_score_columns():
    """Model outputs given as columns of a shipment row: raw P(delay), raw days, reason index."""
    return [((F.col("l_partkey") * 37 % 1000) / 999.0).alias("raw_p"),
            (F.col("real_days") * 0.9 + 0.03).alias("raw_days"),
            (F.col("l_suppkey") % 4).cast("int").alias("reason_index")]


def given_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs given as columns (to check the SQL part of scoring and metrics)."""
    sh = shipments(spark, sf_dir)
    return sh.select(
        "shipment_id", "vendor_name", "real_days", "scheduled_days", "planned_departure_date",
        *_given_score_columns(),
        (F.col("real_days") > F.col("scheduled_days")).cast("int").alias("delay_flag"),
        (F.greatest(F.lit(0).cast("long"), F.col("real_days") - F.col("scheduled_days"))).cast("double").alias("delay_days"),
    )


def stage_inputs(spark: SparkSession, sf_dir: str) -> None:
    """Write the staged inputs now (the shipments view and the tables built from it)."""
    for f in (shipments, vendor_stats, route_stats, weather_historical):
        f(spark, sf_dir)


def city_ordinal(col) -> "F.Column":
    return F.substring_index(col, "_", -1).cast("int")


def city_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates for every city seen in the shipments, from its ordinal k."""
    sh = shipments(spark, sf_dir)
    cities = (sh.select(F.col("origin_city").alias("city"))
              .union(sh.select(F.col("destination_city").alias("city"))).distinct())
    k = city_ordinal(F.col("city"))
    return cities.select(
        "city",
        ((k * 37 % 150) - 70.0).alias("lat"),
        ((k * 83 % 350) - 170.0).alias("lon"))


def city_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial coordinate dictionary (ordinal < 20) keyed by lower-case name.

    Cities with ordinal >= 20 are found through the contains rule of J10.
    """
    cc = city_coordinates(spark, sf_dir)
    k = city_ordinal(F.col("city"))
    return cc.where(k < 20).select(
        F.lower("city").alias("name"), k.alias("ordinal"), "lat", "lon")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a session-zone timestamp (watermarks reject TIMESTAMP_NTZ)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
