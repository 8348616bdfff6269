"""Registered source/sink queries.

Each one writes data that Spark derives from the given tables into a fresh
folder under the shared checkpoint folder, then reads it back through the
source under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as SC
from ..models.assemble import score_assemble
from ..operators import enrich as E
from ..operators import quality as Q
from ..sources import dimensions as DL
from ..sources import files as FS
from ..sources import sinks as SK
from ..sources import testdata as td
from .catalog import register
from .ml_q import _ASSEMBLE_SQL


@register("scan_shipments_csv", ["raw_orders"], """
SELECT shipment_id, shipping_mode, real_days_text, sched_days_text, quantity_text, price_text,
       order_date_text, origin_city, destination_city, origin_country, destination_country
FROM raw_orders""")
def q_scan_shipments_csv(spark, sf):
    """Raw orders written as a latin1 CSV with the source header, scanned back."""
    path = FS.scratch_path(spark, "orders-csv")
    raw = td.raw_orders(spark, sf)
    named = raw.select("shipment_id", *[F.col(k).alias(v) for k, v in SC.RAW_ORDER_COLUMNS.items()])
    # packed files cannot be split, so their rows are bounded
    named.write.option("header", True).option("encoding", "ISO-8859-1").option("compression", "gzip").option("maxRecordsPerFile", 1_000_000).csv(path)
    return FS.scan_shipments_csv(spark, path)


@register("load_dimension", ["weather_historical"], """
SELECT origin_city, departure_date, precipitation_mm, windspeed_max_kmh, snowfall_cm, weather_risk_score
FROM weather_historical""")
def q_load_dimension(spark, sf):
    """A weather CSV whose header names differ from the table's, loaded by position
    (text to typed columns with try_cast; the boolean-to-weight case is in the tests)."""
    path = FS.scratch_path(spark, "weather-csv")
    w = td.weather_historical(spark, sf)
    w.toDF("city", "day", "precip", "wind", "snow", "risk").write.option("header", True).csv(path)
    return FS.load_dimension(spark, "weather_historical", path)


@register("missing_source_default", ["shipments"], """
SELECT shipment_id, vendor_name, CAST(0.5 AS DOUBLE) AS vendor_on_time_rate, CAST(2.0 AS DOUBLE) AS vendor_avg_delay_days,
       0 AS vendor_total_shipments FROM shipments""")
def q_missing_source_default(spark, sf):
    """S3: the vendor file is absent -> empty typed table -> lookup defaults for all."""
    vendors = FS.load_dimension(spark, "vendor_stats", FS.scratch_path(spark, "absent") + "/vendor_stats.csv")
    sh = td.shipments(spark, sf).select("shipment_id", "vendor_name")
    out = E.join_vendor(sh, vendors)
    return out.select("shipment_id", "vendor_name", F.col("vendor_on_time_rate").cast("double"),
                      F.col("vendor_avg_delay_days").cast("double"), F.col("vendor_total_shipments").cast("int"))


def _weather_loads(spark, sf):
    """Weather rows loaded twice for some cities: an earlier load (seq 0) and a later one (seq 1)."""
    w = td.weather_historical(spark, sf)
    k = td.city_ordinal(F.col("origin_city"))
    early = w.where(k % 3 == 0).withColumn("precipitation_mm", F.col("precipitation_mm") + 1.0)
    return early.withColumn("load_seq", F.lit(0)).unionByName(w.withColumn("load_seq", F.lit(1)))


_LOADS_SQL = """
SELECT origin_city, departure_date, precipitation_mm + 1.0 AS precipitation_mm, windspeed_max_kmh, snowfall_cm,
       weather_risk_score, 0 AS load_seq
FROM weather_historical WHERE CAST(split_part(origin_city, '_', 2) AS INTEGER) % 3 = 0
UNION ALL
SELECT origin_city, departure_date, precipitation_mm, windspeed_max_kmh, snowfall_cm, weather_risk_score, 1
FROM weather_historical"""


@register("dedupe_keep_first", ["weather_historical"], f"""
SELECT origin_city, departure_date, precipitation_mm, windspeed_max_kmh, snowfall_cm, weather_risk_score, load_seq
FROM ({_LOADS_SQL}) l
QUALIFY row_number() OVER (PARTITION BY origin_city, departure_date ORDER BY load_seq) = 1""")
def q_dedupe_keep_first(spark, sf):
    """Primary-key conflict, first load wins."""
    return Q.dedupe_keep_first(_weather_loads(spark, sf), ["origin_city", "departure_date"], ["load_seq"])


def _risk_shaped_load(spark, sf):
    """A country-risk-shaped load derived from events (breaks the checks on some rows)."""
    ev = td.events(spark, sf)
    return ev.select(
        F.concat(F.col("event_type"), F.lit("_"), F.col("user_id").cast("string")).alias("country_code"),
        (F.col("value") / 50.0).alias("lpi_score"),
        (F.col("user_id") % 6).cast("int").alias("customs_tier"),
        (F.col("value") / 400.0).alias("geopolitical_risk"),
        (F.col("value") - 100.0).alias("port_congestion"))


_RISK_LOAD_SQL = """
SELECT concat(event_type, '_', CAST(user_id AS VARCHAR)) AS country_code, value / 50.0 AS lpi_score,
       CAST(user_id % 6 AS INTEGER) AS customs_tier, value / 400.0 AS geopolitical_risk,
       value - 100.0 AS port_congestion
FROM events_ts"""


@register("check_constraints", ["events_ts"], f"""
SELECT count(*) AS row_count,
       count(*) FILTER (WHERE NOT (lpi_score >= 1.0 AND lpi_score <= 5.0)) AS rule_0,
       count(*) FILTER (WHERE NOT (customs_tier >= 1 AND customs_tier <= 4)) AS rule_1,
       count(*) FILTER (WHERE NOT (geopolitical_risk >= 0.0 AND geopolitical_risk <= 1.0)) AS rule_2,
       count(*) FILTER (WHERE NOT (port_congestion >= 0.0)) AS rule_3,
       count(*) FILTER (WHERE (lpi_score >= 1.0 AND lpi_score <= 5.0) AND (customs_tier >= 1 AND customs_tier <= 4)
                         AND (geopolitical_risk >= 0.0 AND geopolitical_risk <= 1.0) AND port_congestion >= 0.0)
         AS quarantine_good_rows,
       CASE WHEN count(*) FILTER (WHERE NOT ((lpi_score >= 1.0 AND lpi_score <= 5.0)
                 AND (customs_tier >= 1 AND customs_tier <= 4)
                 AND (geopolitical_risk >= 0.0 AND geopolitical_risk <= 1.0) AND port_congestion >= 0.0)) > 0
            THEN 0 ELSE count(*) END AS strict_good_rows
FROM ({_RISK_LOAD_SQL}) r""")
def q_check_constraints(spark, sf):
    """Per-rule violation counts; rows kept under quarantine and strict modes."""
    load = _risk_shaped_load(spark, sf)
    rules = SC.DIMENSIONS["country_risk"][2]
    counts = Q.violation_counts(load, rules)
    good_q, _ = Q.check_constraints(load, rules, mode="quarantine")
    good_s, _ = Q.check_constraints(load, rules, mode="strict")
    return (counts
            .crossJoin(good_q.agg(F.count(F.lit(1)).alias("quarantine_good_rows")))
            .crossJoin(good_s.agg(F.count(F.lit(1)).alias("strict_good_rows"))))


def _risk_file(spark, sf) -> str:
    """A country-risk CSV derived from events, rows in event order: repeated keys, null keys, text that is no number, values
    outside the checks."""
    path = FS.scratch_path(spark, "risk-csv")
    ev = td.events(spark, sf).repartitionByRange("event_id").sortWithinPartitions("event_id")
    k = F.col("event_id")
    lpi = (F.lit(1.0) + (k % 50) / 10).cast("string")
    ev.select(F.when(k % 97 != 0, F.concat(F.col("event_type"), F.lit("_"), F.col("user_id"))).alias("code"),
              F.when(k % 89 != 0, lpi).otherwise("n/a").alias("lpi"), (k % 5).alias("tier"),
              ((k % 21) / 20).alias("risk"), F.col("value").alias("congestion")).write.option("header", True).csv(path)
    return path


_RISK_FILE_SQL = """
SELECT *, bad_text OR country_code IS NULL OR broken AS bad FROM (
  SELECT *, event_id % 89 = 0 AS bad_text,
         coalesce(NOT lpi_score <= 5.0, false) OR NOT customs_tier BETWEEN 1 AND 4 OR NOT port_congestion >= 0.0 AS broken FROM (
    SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN concat(event_type, '_', CAST(user_id AS VARCHAR)) END AS country_code,
           CASE WHEN event_id % 89 <> 0 THEN CAST(1 AS DOUBLE) + CAST(event_id % 50 AS DOUBLE) / CAST(10 AS DOUBLE) END AS lpi_score,
           CAST(event_id % 5 AS INTEGER) AS customs_tier, CAST(event_id % 21 AS DOUBLE) / CAST(20 AS DOUBLE) AS geopolitical_risk,
           value AS port_congestion FROM events_ts) a) b"""


@register("checked_dimension_rows", ["events_ts"], f"""
SELECT country_code, lpi_score, customs_tier, geopolitical_risk, port_congestion FROM ({_RISK_FILE_SQL}) f WHERE NOT bad
QUALIFY row_number() OVER (PARTITION BY country_code ORDER BY event_id) = 1""")
def q_checked_dimension_rows(spark, sf):
    """A faulty file loaded in quarantine mode; of each key the first good row in file order is stored."""
    root = FS.scratch_path(spark, "dimensions")
    DL.load_dimensions(spark, {"country_risk": _risk_file(spark, sf)}, root, "quarantine")
    return DL.read_dimension(spark, root, "country_risk")


@register("load_dimensions", ["events_ts", "vendor_stats"], f"""
WITH f AS ({_RISK_FILE_SQL}),
kept AS (SELECT customs_tier FROM f WHERE NOT bad QUALIFY row_number() OVER (PARTITION BY country_code ORDER BY event_id) = 1),
n AS (SELECT count(*) AS row_count, count(*) FILTER (WHERE bad_text) AS bad_text,
             count(*) FILTER (WHERE country_code IS NULL) AS null_values, count(*) FILTER (WHERE broken) AS rule_violations,
             count(*) FILTER (WHERE bad) AS bad_rows FROM f),
runs AS (SELECT 1 AS run, 'strict' AS mode UNION ALL SELECT 2, 'quarantine' UNION ALL SELECT 3, 'strict'),
risk AS (SELECT run, mode, 'country_risk' AS table_name, CASE WHEN run = 3 THEN CAST(2 AS BIGINT) ELSE 1 END AS load_id, n.*,
                CASE WHEN run = 2 THEN row_count - bad_rows - (SELECT count(*) FROM kept) ELSE 0 END AS duplicate_rows,
                CASE WHEN run = 2 THEN (SELECT count(*) FROM kept) ELSE 0 END AS stored_rows, run = 2 AS committed FROM runs, n),
vendors AS (SELECT run, mode, 'vendor_stats' AS table_name, CAST(run AS BIGINT) AS load_id, (SELECT count(*) FROM vendor_stats) AS row_count,
                   0 AS bad_text, 0 AS null_values, 0 AS rule_violations, 0 AS bad_rows, 0 AS duplicate_rows,
                   (SELECT count(*) FROM vendor_stats) AS stored_rows, true AS committed FROM runs),
lanes AS (SELECT run, mode, 'trade_lanes' AS table_name, CAST(1 AS BIGINT) AS load_id, 0, 0, 0, 0, 0, 0, 0, false FROM runs)
SELECT a.*, CASE WHEN table_name = 'country_risk' THEN (SELECT CAST(sum(customs_tier) AS BIGINT) FROM kept) ELSE 0 END AS last_tier_sum
FROM (SELECT * FROM risk UNION ALL SELECT * FROM vendors UNION ALL SELECT * FROM lanes) a""")
def q_load_dimensions(spark, sf):
    """Three loads of a faulty, a clean and an absent file (strict, quarantine, strict again): the report of each, and
    a sum over the faulty table as it stands at the end (the last load is rejected and leaves it alone)."""
    root, vendors = FS.scratch_path(spark, "dimensions"), FS.scratch_path(spark, "vendors-csv")
    td.vendor_stats(spark, sf).write.option("header", True).csv(vendors)
    files = {"country_risk": _risk_file(spark, sf), "vendor_stats": vendors,
             "trade_lanes": FS.scratch_path(spark, "absent") + "/trade_lanes.csv"}
    out = None
    for run, mode in enumerate(("strict", "quarantine", "strict"), 1):
        found = DL.load_dimensions(spark, files, root, mode).select(F.lit(run).alias("run"), F.lit(mode).alias("mode"), "*")
        out = found if out is None else out.unionByName(found)
    last = DL.read_dimension(spark, root, "country_risk").agg(F.sum("customs_tier").alias("last_tier_sum"))  # one row
    risk = F.col("table_name") == "country_risk"
    return out.crossJoin(last).withColumn("last_tier_sum", F.when(risk, F.col("last_tier_sum")).otherwise(0))


@register("idempotent_seed", ["vendor_stats"],
          "SELECT vendor_name, on_time_rate, avg_delay_days, total_shipments FROM vendor_stats")
def q_idempotent_seed(spark, sf):
    """Seeding twice writes once; the table reads back unchanged."""
    path = FS.scratch_path(spark, "vendor-seed")
    v = td.vendor_stats(spark, sf)
    FS.idempotent_seed(spark, v, path)
    FS.idempotent_seed(spark, v.limit(0), path)  # second seed is a no-op
    return spark.read.parquet(path)


def _assembled(spark, sf):
    g = td.given_scores(spark, sf).select("shipment_id", "vendor_name", "raw_p", "raw_days", "reason_index")
    return score_assemble(E.join_vendor(g, td.vendor_stats(spark, sf)))


@register("prediction_log_sink", ["given_scores", "vendor_stats"], f"""
SELECT shipment_id, delay_predicted, adjusted_delay_probability AS delay_probability, estimated_delay_days, delay_reason, vendor_tier,
       TIMESTAMP '2024-05-17 10:30:00' AS prediction_timestamp, '2024-05' AS month
FROM ({_ASSEMBLE_SQL})""")
def q_prediction_log_sink(spark, sf):
    """Append scored rows to a month-partitioned log with a given time stamp; read back."""
    path = FS.scratch_path(spark, "prediction-log")
    SK.append_prediction_log(_assembled(spark, sf), path, F.lit("2024-05-17 10:30:00").cast("timestamp"))
    return spark.read.parquet(path).select(*SK.PREDICTION_LOG_COLUMNS, "month")


@register("weather_append_sink", ["weather_historical"], """
SELECT origin_city, departure_date, precipitation_mm, windspeed_max_kmh, snowfall_cm, weather_risk_score
FROM weather_historical""")
def q_weather_append_sink(spark, sf):
    """Two appended batches (the second refetches days already stored) read back once per key."""
    path = FS.scratch_path(spark, "weather")
    w = td.weather_historical(spark, sf)
    k = td.city_ordinal(F.col("origin_city"))
    SK.append_weather(w.where(k < 20).withColumn("load_seq", F.lit(0)), path)
    SK.append_weather(w.withColumn("load_seq", F.lit(1)), path)
    return SK.read_weather(spark, path)


def _geo_pairs(spark, sf):
    sh = td.shipments(spark, sf)
    pairs = sh.select(F.col("origin_city").alias("city"), F.col("origin_country").alias("country")).distinct()
    k = td.city_ordinal(F.col("city"))
    failed = k % 7 == 3
    return pairs.select("city", "country",
                        F.when(~failed, (k * 37 % 150) - 70.0).alias("lat"),
                        F.when(~failed, (k * 83 % 350) - 170.0).alias("lon"))


@register("geocode_lookup_io", ["shipments"], """
SELECT city, country,
       CASE WHEN k % 7 = 3 THEN NULL ELSE CAST(k * 37 % 150 AS DOUBLE) - 70.0 END AS lat,
       CASE WHEN k % 7 = 3 THEN NULL ELSE CAST(k * 83 % 350 AS DOUBLE) - 170.0 END AS lon
FROM (SELECT DISTINCT origin_city AS city, origin_country AS country,
             CAST(split_part(origin_city, '_', 2) AS INTEGER) AS k FROM shipments) p""")
def q_geocode_lookup_io(spark, sf):
    """Geocode rows -> JSON cache text files -> lookup rows again."""
    path = FS.scratch_path(spark, "geocode-cache")
    FS.geocode_table_to_cache(_geo_pairs(spark, sf)).write.text(path)
    return FS.geocode_cache_to_table(spark.read.text(path))
