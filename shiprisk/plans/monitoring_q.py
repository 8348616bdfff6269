"""Registered monitoring queries (T2-T14, batch forms).

Events stand in for the service streams (FIXTURES.md §6): user_id is the
shipment, event_type the position cell / endpoint / model key, value the
latency, least(1, value / 200) the predicted probability.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor as MO
from ..operators import outcomes as OC
from ..schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from ..sources import testdata as td
from .catalog import register
from .expressions_q import _TRAIN_FIX, _TRAIN_SQL, training_table
from .ml_q import assemble_select

_PROB = "least(1.0, value / 200.0)"


def _events(spark, sf):
    return td.events(spark, sf)


@register("stationary_alert", ["events_ts"], """
WITH l AS (SELECT user_id, event_type, ts, event_id,
                  CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END
                    AS new_run
           FROM events_ts WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, CAST(sum(new_run) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
                AS island FROM l)
SELECT user_id, island, first(event_type) AS event_type, min(ts) AS start_ts, max(ts) AS end_ts,
       count(*) AS pings, (epoch_us(max(ts)) // 1000000) - (epoch_us(min(ts)) // 1000000) AS stationary_seconds
FROM i GROUP BY user_id, island
HAVING (epoch_us(max(ts)) // 1000000) - (epoch_us(min(ts)) // 1000000) >= 7200""")
def q_stationary_alert(spark, sf):
    """Runs of pings in one position cell lasting two hours or more."""
    return MO.stationary_alerts(_events(spark, sf))


_REUSE_SQL = """
SELECT event_id, ts, user_id AS reuse_user, event_type,
       lag(ts) OVER w IS NOT NULL AND epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 AS cache_hit
FROM events_ts WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)"""


def _reuse(spark, sf):
    e = _events(spark, sf).select("event_id", "ts", F.col("user_id").alias("reuse_user"), "event_type")
    return MO.prediction_reuse(e, ["reuse_user", "event_type"]).drop("prev_ts")


@register("prediction_reuse", ["events_ts"], _REUSE_SQL)
def q_prediction_reuse(spark, sf):
    """A request reuses the prediction of the same key made within 6 hours."""
    return _reuse(spark, sf)


@register("cache_hit_rate", ["events_ts"], f"""
SELECT CAST(ts AS DATE) AS day, count(*) AS requests, count(*) FILTER (WHERE cache_hit) AS hits,
       count(*) FILTER (WHERE cache_hit) / count(*) AS hit_rate,
       count(*) FILTER (WHERE cache_hit) / count(*) < 0.4 AS alert
FROM ({_REUSE_SQL}) r GROUP BY CAST(ts AS DATE)""")
def q_cache_hit_rate(spark, sf):
    """Daily share of reused predictions, alert under 40 %."""
    return MO.cache_hit_rate(_reuse(spark, sf))


@register("feature_drift", ["events_ts"], """
WITH daily AS (SELECT CAST(ts AS DATE) AS day, event_type AS category, count(*) AS n FROM events_ts GROUP BY 1, 2),
base AS (SELECT category, sum(n) AS base_n FROM daily GROUP BY 1),
tot AS (SELECT sum(base_n) AS all_n FROM base),
b AS (SELECT category, greatest(base_n / all_n, 1e-4) AS q FROM base, tot),
days AS (SELECT day, sum(n) AS day_n FROM daily GROUP BY day),
grid AS (SELECT d.day, b.category, b.q, COALESCE(x.n, 0) AS n, d.day_n
         FROM days d CROSS JOIN b LEFT JOIN daily x ON x.day = d.day AND x.category = b.category)
SELECT day, count(*) FILTER (WHERE n > 0) AS categories,
       round(sum((greatest(n / day_n, 1e-4) - q) * ln(greatest(n / day_n, 1e-4) / q)), 9) AS psi
FROM grid GROUP BY day""")
def q_feature_drift(spark, sf):
    """T4: daily PSI of the category mix against the whole-period baseline (9 places)."""
    d = MO.feature_drift(_events(spark, sf), "event_type")
    return d.withColumn("psi", F.round("psi", 9))


@register("label_drift", ["given_scores"], """
SELECT strftime(planned_departure_date, '%Y-%m') AS period, round(avg(raw_p), 9) AS mean_predicted,
       avg(CAST(delay_flag AS DOUBLE)) AS actual_rate, count(*) AS n
FROM given_scores GROUP BY 1""")
def q_label_drift(spark, sf):
    """T5: mean predicted probability against the actual delay rate per month."""
    g = td.given_scores(spark, sf)
    d = MO.label_drift(g, F.date_format("planned_departure_date", "yyyy-MM"), "raw_p", "delay_flag")
    return d.withColumn("mean_predicted", F.round("mean_predicted", 9))  # float sum order varies


@register("false_negative_rate", ["given_scores"], """
SELECT planned_departure_date AS day,
       count(*) FILTER (WHERE delay_flag = 1 AND NOT raw_p >= 0.5) AS false_negatives,
       count(*) FILTER (WHERE delay_flag = 1) AS late,
       CASE WHEN count(*) FILTER (WHERE delay_flag = 1) > 0
            THEN count(*) FILTER (WHERE delay_flag = 1 AND NOT raw_p >= 0.5) / count(*) FILTER (WHERE delay_flag = 1)
       END AS fn_rate
FROM given_scores GROUP BY planned_departure_date""")
def q_false_negative_rate(spark, sf):
    """Per day, late deliveries predicted on time over all late deliveries."""
    g = td.given_scores(spark, sf).withColumn("predicted", F.col("raw_p") >= 0.5)
    return MO.false_negative_rate(g, F.col("planned_departure_date"), "predicted", "delay_flag")


@register("latency_percentiles", ["events_ts"], """
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
       round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n
FROM events_ts GROUP BY 1""")
def q_latency_percentiles(spark, sf):
    """Exact p50/p95/p99 latency per hour (6-place output rounding)."""
    p = MO.latency_percentiles(_events(spark, sf), "ts", "value")
    return p.select("window_start", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "n")


@register("error_rate_windows", ["events_ts"], """
SELECT time_bucket(INTERVAL '2 minutes', ts) AS window_start, count(*) AS requests,
       count(*) FILTER (WHERE event_type = 'error') AS errors,
       count(*) FILTER (WHERE event_type = 'error') / count(*) AS error_rate,
       count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.01 AS alert
FROM events_ts GROUP BY 1""")
def q_error_rate_windows(spark, sf):
    """Share of error responses per tumbling 2-minute window, alert above 1 %."""
    return MO.error_rate_windows(_events(spark, sf), "ts", F.col("event_type") == "error")


_UNITS = "CAST(least(20000, round(value * 100)) AS BIGINT)"


@register("rolling_confidence", ["events_ts"], f"""
WITH r AS (SELECT event_type, ts, event_id,
                  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn,
                  CAST(sum({_UNITS}) OVER w AS DOUBLE) / count(*) OVER w AS rolling_units,
                  CAST(sum({_UNITS}) OVER (PARTITION BY event_type) AS DOUBLE)
                    / count(*) OVER (PARTITION BY event_type) AS key_units
           FROM events_ts
           WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT event_type, ts, event_id, rn, rolling_units / 20000.0 AS rolling_mean,
       rolling_units < key_units * 0.8 AS confidence_drop
FROM r""")
def q_rolling_confidence(spark, sf):
    """Rolling mean of the last 100 probabilities per model key; drop flag.

    The probability least(1, value / 200) is carried as integer units of
    1/20000 (value in cents, capped), so every sum is exact.
    """
    units = F.least(F.lit(20000), F.round(F.col("value") * 100)).cast("long")
    e = _events(spark, sf).withColumn("p_units", units)
    r = MO.rolling_confidence(e, "event_type", "ts", "event_id", "p_units")
    return r.withColumn("rolling_mean", F.col("rolling_mean") / 20000.0)


@register("request_rate", ["events_ts"], """
WITH g AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type AS endpoint, count(*) AS requests
           FROM events_ts GROUP BY 1, 2)
SELECT window_start, endpoint, requests,
       avg(requests) OVER (PARTITION BY endpoint ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
         AS normal,
       COALESCE(requests > 1.3 * avg(requests) OVER (PARTITION BY endpoint ORDER BY window_start
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS surge
FROM g""")
def q_request_rate(spark, sf):
    """Requests per hour and endpoint against the endpoint's earlier hours."""
    return MO.request_rate(_events(spark, sf), "ts", "event_type")


@register("monthly_vendor_mode_report", ["requests", "vendor_stats"], f"""
WITH a AS (SELECT {assemble_select("r")}, r.vendor_name, r.carrier_type, r.planned_departure_date
           FROM requests r LEFT JOIN vendor_stats v ON v.vendor_name = r.vendor_name)
SELECT strftime(planned_departure_date, '%Y-%m') AS month, vendor_name, carrier_type AS mode,
       count(*) AS predictions, round(avg(adjusted_delay_probability), 9) AS mean_probability,
       avg(CAST(delay_predicted AS DOUBLE)) AS delayed_share
FROM a GROUP BY 1, 2, 3""")
def q_monthly_vendor_mode_report(spark, sf):
    """Predictions by month, vendor and carrier mode."""
    from ..models.assemble import score_assemble
    from ..operators import enrich as E
    req = td.typed_shipments(spark, sf).select("shipment_id", "vendor_name", "carrier_type",
                                               "planned_departure_date", "raw_p", "raw_days", "reason_index")
    log = score_assemble(E.join_vendor(req, td.vendor_stats(spark, sf)),
                         keep=("vendor_name", "carrier_type", "planned_departure_date"))
    r = MO.monthly_vendor_mode_report(log, F.date_format("planned_departure_date", "yyyy-MM"), "vendor_name",
                                      "carrier_type", "adjusted_delay_probability", "delay_predicted")
    return r.withColumn("mean_probability", F.round("mean_probability", 9))


RECENT_AS_OF = "1998-06-30"


@register("recent_predictions", ["requests", "vendor_stats"], f"""
WITH a AS (SELECT {assemble_select("r")}, CAST(r.planned_departure_date AS TIMESTAMP) AS prediction_timestamp
           FROM requests r LEFT JOIN vendor_stats v ON v.vendor_name = r.vendor_name)
SELECT shipment_id, delay_predicted, adjusted_delay_probability AS delay_probability, estimated_delay_days,
       delay_reason, vendor_tier, prediction_timestamp, strftime(prediction_timestamp, '%Y-%m') AS month
FROM a
WHERE prediction_timestamp >= CAST(DATE '{RECENT_AS_OF}' - INTERVAL 7 DAY AS TIMESTAMP)
  AND prediction_timestamp < CAST(DATE '{RECENT_AS_OF}' + INTERVAL 1 DAY AS TIMESTAMP)""")
def q_recent_predictions(spark, sf):
    """T12 (time filter): last 7 days of a month-partitioned prediction log.

    The log is written with the departure time as prediction time (a
    historical backfill), so the answer is reproducible; the read prunes
    month partitions and pushes the time filter to the parquet scan.
    """
    from ..models.assemble import score_assemble
    from ..operators import enrich as E
    from ..sources import files as FS
    from ..sources import sinks as SK
    req = td.typed_shipments(spark, sf).select("shipment_id", "vendor_name", "planned_departure_date",
                                               "raw_p", "raw_days", "reason_index")
    rec = score_assemble(E.join_vendor(req, td.vendor_stats(spark, sf)), keep=("planned_departure_date",))
    path = FS.scratch_path(spark, "history-log")
    SK.append_prediction_log(rec, path, ts=F.col("planned_departure_date").cast("timestamp"))
    return MO.recent_predictions(spark, path, RECENT_AS_OF, days=7)


@register("shadow_compare", ["shipments"], """
WITH s AS (SELECT CAST((l_partkey * 37) % 1000 AS DOUBLE) / 999.0 AS a,
                  (CAST((l_partkey * 37) % 1000 AS DOUBLE) / 999.0 + CAST((l_partkey * 53) % 1000 AS DOUBLE) / 999.0
                   + CAST((l_suppkey * 71 + l_linenumber) % 1000 AS DOUBLE) / 999.0) / 3.0 AS b
           FROM shipments)
SELECT count(*) AS rows, avg(CASE WHEN (a >= 0.5) = (b >= 0.5) THEN 1.0 ELSE 0.0 END) AS agreement,
       round(avg(abs(a - b)), 9) AS mean_abs_diff, round(corr(a, b), 9) AS correlation
FROM s""")
def q_shadow_compare(spark, sf):
    """Current model (given score) against a shadow model (vote of three) on the same rows."""
    from ..models.pipeline import soft_vote
    sh = td.shipments(spark, sf)
    p1 = (F.col("l_partkey") * 37 % 1000) / 999.0
    p2 = (F.col("l_partkey") * 53 % 1000) / 999.0
    p3 = ((F.col("l_suppkey") * 71 + F.col("l_linenumber")) % 1000) / 999.0
    both = sh.select(p1.alias("raw_p"), soft_vote(p1, p2, p3).alias("shadow_p"))
    r = MO.shadow_compare(both, "raw_p", "shadow_p")
    return r.select("rows", "agreement", F.round("mean_abs_diff", 9).alias("mean_abs_diff"),
                    F.round("correlation", 9).alias("correlation"))


@register("p95_alert", ["events_ts"], """
WITH m AS (SELECT epoch_us(ts) // 60000000 AS minute, quantile_cont(value, 0.95) AS p95 FROM events_ts GROUP BY 1),
b AS (SELECT minute, p95 FROM m WHERE p95 > 100)
SELECT make_timestamp(b.minute * 60000000) AS minute_start, round(b.p95, 6) AS p95 FROM b
WHERE EXISTS (SELECT 1 FROM b b1 WHERE b1.minute = b.minute - 1)""")
def q_p95_alert(spark, sf):
    """Minutes whose p95 latency has been over the threshold for the last
    ``minutes`` minutes (thresholds scaled to the test events: 100, 2 minutes)."""
    a = MO.p95_alerts(_events(spark, sf), "ts", "value", threshold=100.0, minutes=2)
    return a.withColumn("p95", F.round("p95", 6))


_OUTCOMES_AS_OF = "1998-01-01 00:00:00"
_LOG_SQL = """
log AS (SELECT shipment_id, CAST(planned_departure_date AS TIMESTAMP) - INTERVAL 1 DAY * (l_partkey % 45) AS predicted_at,
               CAST((l_partkey * 37) % 1000 AS DOUBLE) / 999.0 >= 0.5 AS predicted FROM shipments
        UNION ALL
        SELECT shipment_id, CAST(planned_departure_date AS TIMESTAMP) - INTERVAL 6 HOUR, CAST((l_partkey * 53) % 1000 AS DOUBLE) / 999.0 >= 0.5
        FROM shipments WHERE l_linenumber % 2 = 0),
deliveries AS (SELECT shipment_id, CAST(planned_departure_date AS TIMESTAMP) + INTERVAL 1 DAY * real_days AS delivered_at, real_days > scheduled_days AS late
               FROM shipments)"""


@register("prediction_outcomes", ["shipments"], f"""
WITH {_LOG_SQL},
f AS (SELECT shipment_id, min(delivered_at) AS delivered_at, arg_min(late, (delivered_at, late)) AS late FROM deliveries
      WHERE delivered_at <= TIMESTAMP '{_OUTCOMES_AS_OF}' GROUP BY shipment_id),
r AS (SELECT l.*, f.delivered_at, f.late, COALESCE(l.predicted_at <= f.delivered_at AND l.predicted_at >= f.delivered_at - INTERVAL 30 DAY, false) AS recent
      FROM log l LEFT JOIN f USING (shipment_id)),
m AS (SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY recent DESC, predicted_at DESC, predicted DESC) AS nth FROM r),
s AS (SELECT *, CASE WHEN delivered_at IS NULL THEN 'pending' WHEN recent THEN 'matched' ELSE 'stale' END AS status FROM m WHERE nth = 1),
g AS (SELECT CAST(predicted_at AS DATE) AS day, count(*) AS shipments, count(*) FILTER (WHERE status = 'pending') AS pending,
             count(*) FILTER (WHERE status = 'stale') AS stale, count(*) FILTER (WHERE status = 'matched' AND late) AS late,
             count(*) FILTER (WHERE status = 'matched' AND late AND NOT predicted) AS false_negatives FROM s GROUP BY 1)
SELECT *, CASE WHEN late > 0 THEN false_negatives / late END AS fn_rate FROM g""")
def q_prediction_outcomes(spark, sf):
    """A stored prediction log (some shipments scored twice) joined with the deliveries known on a day; false negatives by day of prediction."""
    from ..sources import files as FS
    sh = td.shipments(spark, sf)
    departure = F.col("planned_departure_date").cast("timestamp")
    early = sh.select("shipment_id", (departure - F.make_dt_interval((F.col("l_partkey") % 45).cast("int"))).alias("predicted_at"),
                      ((F.col("l_partkey") * 37 % 1000) / 999.0 >= 0.5).alias("predicted"))
    again = sh.where("l_linenumber % 2 = 0").select("shipment_id", (departure - F.expr("interval 6 hours")).alias("predicted_at"),
                                                    ((F.col("l_partkey") * 53 % 1000) / 999.0 >= 0.5).alias("predicted"))
    path = FS.scratch_path(spark, "prediction-log")
    early.union(again).write.parquet(path)
    deliveries = sh.select("shipment_id", (departure + F.make_dt_interval(F.col("real_days").cast("int"))).alias("delivered_at"),
                           (F.col("real_days") > F.col("scheduled_days")).alias("late"))
    return OC.outcome_rates(OC.match_outcomes(spark.read.parquet(path), deliveries, _OUTCOMES_AS_OF))


_NUM_SQL = " UNION ALL ".join(
    f"""SELECT departure_month AS day, '{c}' AS feature, CASE WHEN {c} IS NULL THEN 'null' WHEN lo = hi THEN '0'
        ELSE CAST(CAST(least(floor((CAST({c} AS DOUBLE) - lo) / (hi - lo) * 20.0), 19) AS INTEGER) AS VARCHAR) END AS bin
        FROM t, (SELECT min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi FROM t)""" for c in NUMERIC_FEATURES)
_CAT_SQL = " UNION ALL ".join(f"SELECT departure_month AS day, '{c}' AS feature, COALESCE('=' || {c}, 'null') AS bin FROM t" for c in CATEGORICAL_FEATURES)


@register("feature_profile_drift", _TRAIN_FIX, f"""
WITH t AS ({_TRAIN_SQL}), x AS ({_NUM_SQL} UNION ALL {_CAT_SQL}),
b AS (SELECT feature, bin, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS q FROM x GROUP BY feature, bin),
c AS (SELECT day, feature, bin, count(*) AS n FROM x GROUP BY ALL),
d AS (SELECT day, feature, sum(n) AS rows FROM c GROUP BY ALL),
g AS (SELECT d.day, d.feature, d.rows, b.bin, b.q, COALESCE(c.n, 0) / d.rows AS s FROM d JOIN b USING (feature)
      LEFT JOIN c ON c.day = d.day AND c.feature = d.feature AND c.bin = b.bin),
k AS (SELECT *, greatest(s, 1e-4) AS p1, greatest(q, 1e-4) AS q1,
             abs(sum(s) OVER w - sum(q) OVER w) AS gap FROM g
      WINDOW w AS (PARTITION BY day, feature ORDER BY TRY_CAST(bin AS INTEGER) NULLS FIRST ROWS UNBOUNDED PRECEDING))
SELECT CAST(day AS INTEGER) AS month, feature, CAST(any_value(rows) AS BIGINT) AS rows, round(sum((p1 - q1) * ln(p1 / q1)), 6) AS psi,
       round(max(CASE WHEN feature NOT IN ('carrier_type', 'priority_level') THEN gap END), 6) AS ks
FROM k GROUP BY day, feature""")
def q_feature_profile_drift(spark, sf):
    """T4: each month's 27 features against the stored profile of the training table: stability index and greatest gap."""
    from ..sources import files as FS
    # the table is read three times: its lookups are made once
    path = FS.scratch_path(spark, "training-table")
    training_table(spark, sf).select(*NUMERIC_FEATURES, *CATEGORICAL_FEATURES).write.option("compression", "zstd").parquet(path)
    t = spark.read.parquet(path)
    bounds = OC.profile_bounds(t, NUMERIC_FEATURES)
    path = FS.scratch_path(spark, "training-profile")
    OC.training_profile(t, bounds, CATEGORICAL_FEATURES).write.parquet(path)
    d = OC.drift(t, F.col("departure_month").cast("int"), spark.read.parquet(path), bounds, CATEGORICAL_FEATURES)
    return d.select(F.col("day").alias("month"), "feature", "rows", F.round("psi", 6).alias("psi"), F.round("ks", 6).alias("ks"))
