"""Batch monitoring operators.

The reference describes these in prose only; where it leaves semantics
open, the choice made here is stated in the docstring (marked "ours").
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import sequence as S

HOUR = 3600


# T2 -----------------------------------------------------------------------
def stationary_alerts(pings: DataFrame, key: str = "user_id", cell: str = "event_type", ts: str = "ts",
                      tie: str = "event_id", min_seconds: int = 2 * HOUR) -> DataFrame:
    """Runs of consecutive pings in the same position cell lasting >= ``min_seconds``.

    Gaps and islands, skew-safe: the pings are range-sorted by (shipment,
    time) once; the previous ping's cell and the running count of cell
    changes (the island id) are then taken range by range. Duration = last
    ping - first ping of the run (ours). A null cell never equals another.
    """
    p = S.in_order(pings.select(key, cell, ts, tie), [key], [ts, tie])
    p = S.keyed_previous(p, [key], [ts, tie], [cell])
    p = p.withColumn("_new", (F.col(f"prev_{cell}").isNull() | (F.col(f"prev_{cell}") != F.col(cell))).cast("long"))
    # the running sum reads its input twice: its rows, and the sums that it carries on
    p = S.keyed_running_sum(cut_lineage(p), [key], [ts, tie], ["_new"], prefix="island_")
    runs = p.groupBy(key, F.col("island__new").alias("island")).agg(
        F.first(cell).alias(cell), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"),
        F.count(F.lit(1)).alias("pings"))
    dur = F.unix_seconds("end_ts") - F.unix_seconds("start_ts")
    return runs.withColumn("stationary_seconds", dur).where(F.col("stationary_seconds") >= min_seconds)


# T3 / T11 -------------------------------------------------------------------
def prediction_reuse(requests: DataFrame, keys: list[str], ts: str = "ts", tie: str = "event_id",
                     ttl_seconds: int = 6 * HOUR) -> DataFrame:
    """Per request: ``cache_hit`` when the previous request with the same reuse
    key came at most ``ttl_seconds`` earlier (sliding reuse; ours).
    """
    r = S.keyed_previous(S.in_order(requests, keys, [ts, tie]), keys, [ts, tie], [ts]).drop(S.RANGE)
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.col(f"prev_{ts}"))
    hit = F.col(f"prev_{ts}").isNotNull() & (gap <= F.lit(ttl_seconds * 1_000_000))
    return r.withColumn("cache_hit", hit)


def cache_hit_rate(reuse: DataFrame, ts: str = "ts", alert_below: float = 0.40) -> DataFrame:
    """Share of reused predictions per day; alert when under 40 %."""
    d = reuse.groupBy(F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("cache_hit").alias("hits"))
    rate = F.col("hits") / F.col("requests")
    return d.withColumn("hit_rate", rate).withColumn("alert", rate < alert_below)


def score_once(requests: DataFrame, keys: list[str]) -> DataFrame:
    """T3 batch form: one representative request per reuse key (score these, join back)."""
    return requests.dropDuplicates(keys)


# T4 -----------------------------------------------------------------------
def feature_drift(df: DataFrame, feature: str, ts: str = "ts", eps: float = 1e-4) -> DataFrame:
    """Population stability index per day: each day's category shares against
    the shares over the whole table (baseline), shares floored at ``eps`` (ours).

    Categories absent on a day contribute (eps - q) ln(eps / q); that part is
    the baseline total T0 minus the same term of the categories present, so
    no day x category grid is built.
    """
    daily = df.groupBy(F.to_date(ts).alias("day"), F.col(feature).alias("category")).agg(
        F.count(F.lit(1)).alias("n"))
    base = daily.groupBy("category").agg(F.sum("n").alias("base_n"))
    all_n = base.agg(F.sum("base_n").alias("all_n"))
    q = F.greatest(F.col("base_n") / F.col("all_n"), F.lit(eps))
    absent_term = (F.lit(eps) - q) * F.log(F.lit(eps) / q)
    base = base.crossJoin(all_n).select("category", q.alias("q"), absent_term.alias("t0"))  # all_n: one row
    t0 = base.agg(F.sum("t0").alias("T0"))
    day_n = daily.groupBy("day").agg(F.sum("n").alias("day_n"))
    d = daily.join(day_n, "day").join(base, "category")
    p = F.greatest(F.col("n") / F.col("day_n"), F.lit(eps))
    term = (p - F.col("q")) * F.log(p / F.col("q")) - F.col("t0")
    per_day = d.groupBy("day").agg(F.sum(term).alias("present"), F.count(F.lit(1)).alias("categories"))
    return per_day.crossJoin(t0).select("day", "categories", (F.col("present") + F.col("T0")).alias("psi"))  # one row


# T5 -----------------------------------------------------------------------
def label_drift(df: DataFrame, period, prob: str, actual: str) -> DataFrame:
    return df.groupBy(period.alias("period")).agg(
        F.avg(prob).alias("mean_predicted"), F.avg(F.col(actual).cast("double")).alias("actual_rate"),
        F.count(F.lit(1)).alias("n"))


# T6 -----------------------------------------------------------------------
def false_negative_rate(df: DataFrame, day, predicted: str, actual: str) -> DataFrame:
    """Per day: predicted on time but delivered late / all delivered late."""
    late = F.col(actual) == 1
    g = df.groupBy(day.alias("day")).agg(
        F.count_if(late & ~F.col(predicted)).alias("false_negatives"), F.count_if(late).alias("late"))
    return g.withColumn("fn_rate", F.when(F.col("late") > 0, F.col("false_negatives") / F.col("late")))


# T7 -----------------------------------------------------------------------
def exact_percentiles(df: DataFrame, key: str, value: str, probabilities: dict[str, float]) -> DataFrame:
    """Interpolated percentiles of the non-null values of each key, and ``n`` rows.

    Equal values are counted first, with partial aggregation. The distinct
    values are range-sorted by (key, value), and running counts give their
    ranks range by range: a window that holds most rows is ranked by many
    tasks, and no group's values are ever held in one buffer or sorted in one task.
    """
    counts = df.groupBy(key, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.count(value).alias("_k"))
    placed = S.in_order(counts, [key], ["_v"])
    ranked = S.keyed_totals(S.keyed_running_sum(placed, [key], ["_v"], ["_k"], prefix="_to"), [key], ["_c", "_k"], prefix="_all")
    picks = []
    for name, p in probabilities.items():
        at = F.lit(p) * (F.col("_all_k") - 1)
        picks += [F.min(F.when(F.col("_to_k") > F.floor(at), F.col("_v"))).alias(f"_lo_{name}"),
                  F.min(F.when(F.col("_to_k") > F.ceil(at), F.col("_v"))).alias(f"_hi_{name}")]
    g = ranked.where("_k > 0 or _all_k = 0").groupBy(key).agg(*picks, F.max("_all_c").alias("n"), F.max("_all_k").alias("_m"))
    part = {name: F.lit(p) * (F.col("_m") - 1) - F.floor(F.lit(p) * (F.col("_m") - 1)) for name, p in probabilities.items()}
    return g.select(key, *[(F.col(f"_lo_{x}") * (1 - part[x]) + F.col(f"_hi_{x}") * part[x]).alias(x) for x in probabilities], "n")


def latency_percentiles(df: DataFrame, ts: str, latency: str, width: str = "1 hour") -> DataFrame:
    """Exact p50/p95/p99 per tumbling window (stream form: percentile_approx)."""
    w = F.window(ts, width)
    g = exact_percentiles(df.select(w.alias("w"), latency), "w", latency, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return g.select(F.col("w.start").alias("window_start"), "p50", "p95", "p99", "n")


# T8 -----------------------------------------------------------------------
def error_rate_windows(df: DataFrame, ts: str, is_error, width: str = "2 minutes",
                       alert_above: float = 0.01) -> DataFrame:
    g = df.groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(is_error).alias("errors"))
    rate = F.col("errors") / F.col("requests")
    return g.select(F.col("w.start").alias("window_start"), "requests", "errors",
                    rate.alias("error_rate"), (rate > alert_above).alias("alert"))


# T9 -----------------------------------------------------------------------
def rolling_confidence(df: DataFrame, key: str, ts: str, tie: str, prob: str, rows: int = 100,
                       drop_ratio: float = 0.8) -> DataFrame:
    """Rolling mean of the last ``rows`` probabilities per key, skew-safe.

    mean = (prefix(r) - prefix(r - rows)) / min(r, rows), with row numbers and
    prefix sums from one pass over (key, range) groups and the r - rows lookup
    by (key, row number); flag when the rolling mean falls under
    ``drop_ratio`` x the key's overall mean (ours).
    """
    x = df.select(key, ts, tie, F.col(prob).cast("double").alias("_p"), F.lit(1).cast("long").alias("_one"))
    x = S.keyed_running_sum(S.in_order(x, [key], [ts, tie]), [key], [ts, tie], ["_p", "_one"])
    x = cut_lineage(x.withColumnRenamed("cum__one", "rn").drop("_one", S.RANGE))  # both sides of the lag join read it
    overall = x.groupBy(key).agg(F.avg("_p").alias("key_mean"))
    x = S.keyed_lag(x, [key], "rn", ["cum__p"], offset=rows, prefix="back_")
    n = F.least(F.col("rn"), F.lit(rows))
    mean = (F.col("cum__p") - F.coalesce(F.col("back_cum__p"), F.lit(0.0))) / n
    out = x.withColumn("rolling_mean", mean).join(overall, key)
    return out.select(key, ts, tie, "rn", "rolling_mean",
                      (F.col("rolling_mean") < F.col("key_mean") * drop_ratio).alias("confidence_drop"))


# T10 ----------------------------------------------------------------------
def request_rate(df: DataFrame, ts: str, endpoint: str, width: str = "1 hour", above: float = 1.3) -> DataFrame:
    """Requests per window and endpoint; flag when 30 % above the mean of the
    endpoint's earlier windows (ours: windows with no requests are absent)."""
    g = df.groupBy(F.window(ts, width).alias("w"), F.col(endpoint).alias("endpoint")).agg(
        F.count(F.lit(1)).alias("requests"))
    g = g.select(F.col("w.start").alias("window_start"), "endpoint", "requests")
    # one row per (window, endpoint): the window below is bounded by the time span
    prior = Window.partitionBy("endpoint").orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)
    normal = F.avg("requests").over(prior)
    return g.withColumn("normal", normal).withColumn(
        "surge", F.coalesce(F.col("requests") > F.col("normal") * above, F.lit(False)))


# T12 ----------------------------------------------------------------------
def monthly_vendor_mode_report(log: DataFrame, month, vendor: str, mode: str, prob: str, delayed: str) -> DataFrame:
    return log.groupBy(month.alias("month"), F.col(vendor).alias("vendor_name"), F.col(mode).alias("mode")).agg(
        F.count(F.lit(1)).alias("predictions"), F.avg(prob).alias("mean_probability"),
        F.avg(F.col(delayed).cast("double")).alias("delayed_share"))


def recent_predictions(spark, path: str, as_of: str, days: int = 7) -> DataFrame:
    """Last ``days`` days of a month-partitioned log: the month filter prunes
    partitions, the timestamp filter is pushed to the parquet scan."""
    lo = F.date_sub(F.to_date(F.lit(as_of)), days)
    log = spark.read.parquet(path)
    return log.where((F.col("month") >= F.date_format(lo, "yyyy-MM")) & (F.col("month") <= F.lit(as_of[:7]))
                     & (F.col("prediction_timestamp") >= lo.cast("timestamp"))
                     & (F.col("prediction_timestamp") < F.date_add(F.to_date(F.lit(as_of)), 1).cast("timestamp")))


# T13 ----------------------------------------------------------------------
def shadow_compare(scored: DataFrame, pa: str, pb: str, threshold: float = 0.5) -> DataFrame:
    """Two models' probabilities on the same rows (one frame holding both):
    decision agreement, mean absolute difference and correlation.

    Scoring both models in one pass over the rows avoids joining two
    outputs on an id that may not be unique.
    """
    a, b = F.col(pa), F.col(pb)
    return scored.agg(F.count(F.lit(1)).alias("rows"),
                      F.avg(((a >= threshold) == (b >= threshold)).cast("double")).alias("agreement"),
                      F.avg(F.abs(a - b)).alias("mean_abs_diff"),
                      F.corr(a, b).alias("correlation"))


# T14 ----------------------------------------------------------------------
def p95_alerts(df: DataFrame, ts: str, latency: str, threshold: float, minutes: int = 5) -> DataFrame:
    """Minutes that close a run of ``minutes`` consecutive minutes whose p95 is over ``threshold``.

    Per-minute p95, then "the previous minutes were breaches too" as
    equi-joins on the minute number (no global ordered window).
    """
    minutely = df.select(F.floor(F.unix_seconds(F.col(ts)) / 60).alias("minute"), latency)
    m = exact_percentiles(minutely, "minute", latency, {"p95": 0.95})
    breach = m.where(F.col("p95") > threshold).select("minute", "p95")
    out = breach
    for k in range(1, minutes):
        prev = breach.select((F.col("minute") + k).alias("minute"))
        out = out.join(prev, "minute", "left_semi")
    return out.select(F.timestamp_seconds(F.col("minute") * 60).alias("minute_start"), "p95")
