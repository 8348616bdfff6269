"""Predictions against later outcomes (T6), and drift of all features against a stored training profile (T4).

``match_outcomes`` joins a stored prediction log with deliveries that come in
later. One delivery a shipment is taken (the first), so the join makes at
most one row for each logged prediction. What it gives is written once (as
Parquet: two numbers and the id), so that Spark may split the join's skewed
keys and combines a shipment's predictions before they are shuffled: a
shipment that was scored very often does not end in one task.

A training profile is one row for each bin of each feature: numbers fall into
``BINS`` equal steps between the training minimum and maximum, categories are
bins of their own. Its counts add up, so profiles of parts of the training
rows over the same steps merge by summing. A day is compared with it in one
pass over the rows, whatever the number of features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch_path

BINS = 20
#: Code of a number whose feature had none in training.
NONE = -2
#: Shares are floored at this in the stability index.
LEAST_SHARE = 1e-4


# T6 -----------------------------------------------------------------------
def match_outcomes(log: DataFrame, deliveries: DataFrame, as_of, horizon_days: int = 30) -> DataFrame:
    """(shipment_id, predicted_at, predicted, delivered_at, late, status) of every logged shipment.

    ``log``: shipment_id, predicted_at, predicted (boolean); ``deliveries``:
    shipment_id, delivered_at, late (boolean). A delivery is judged by the
    shipment's last prediction in the ``horizon_days`` up to it (the later of
    equal times is the one that predicted a delay). status: matched; stale,
    if no prediction is that recent (the shipment's last one is shown);
    pending, if nothing was delivered by ``as_of``.
    """
    until = F.lit(as_of).cast("timestamp")
    first = deliveries.where((F.col("delivered_at") <= until) & F.col("shipment_id").isNotNull()).groupBy(F.col("shipment_id").alias("_id")) \
        .agg(F.min(_packed("delivered_at", "late")).alias("_d"))
    joined = log.where("shipment_id is not null").join(first, F.col("shipment_id") == F.col("_id"), "left")
    at = _time("_d")
    recent = F.coalesce((F.col("predicted_at") <= at) & (F.col("predicted_at") >= at - F.expr(f"interval {int(horizon_days)} days")), F.lit(False))
    joined = joined.select("shipment_id", (_packed("predicted_at", "predicted") + F.when(recent, RECENT).otherwise(0)).alias("_p"), "_d")
    path = scratch_path(log.sparkSession, "matched")
    joined.write.parquet(path)
    kept = log.sparkSession.read.parquet(path).groupBy("shipment_id").agg(F.max("_p").alias("_p"), F.max("_d").alias("_d"))
    recent = F.col("_p") >= UNDATED + RECENT
    kept = kept.select("shipment_id", "_d", recent.alias("_recent"), (F.col("_p") - F.when(recent, RECENT).otherwise(0)).alias("_p"))
    status = F.when(F.col("_d").isNull(), "pending").when(F.col("_recent"), "matched").otherwise("stale")
    return kept.select("shipment_id", _time("_p").alias("predicted_at"), _flag("_p").alias("predicted"),
                       _time("_d").alias("delivered_at"), _flag("_d").alias("late"), status.alias("status"))


#: Below and above every packed time (a year has 1e14 thirds of a microsecond).
UNDATED, RECENT = -(1 << 60), 1 << 61


def _packed(time: str, flag: str) -> Column:
    """(time, flag) as one whole number in the same order, nulls first: aggregates of numbers are hashed, those of structs sort all rows."""
    code = F.when(F.col(flag), 2).when(~F.col(flag), 1).otherwise(0)
    return F.coalesce(F.unix_micros(F.col(time).cast("timestamp")) * 3, F.lit(UNDATED)) + code


def _time(packed: str) -> Column:
    p = F.col(packed)
    return F.when(p >= UNDATED + 3, F.timestamp_micros(F.expr(f"(`{packed}` - pmod(`{packed}`, 3L)) div 3L")))


def _flag(packed: str) -> Column:
    code = F.pmod(F.col(packed) - F.when(F.col(packed) < UNDATED + 3, UNDATED).otherwise(0), F.lit(3))
    return F.when(code > 0, code == 2)


def outcome_rates(matched: DataFrame) -> DataFrame:
    """For each day of prediction: shipments, pending, stale, late deliveries, those predicted on time, and their share."""
    ok = F.col("status") == "matched"
    missed = ok & F.col("late") & ~F.col("predicted")
    g = matched.groupBy(F.to_date("predicted_at").alias("day")).agg(
        F.count("*").alias("shipments"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "stale").alias("stale"),
        F.count_if(ok & F.col("late")).alias("late"), F.count_if(missed).alias("false_negatives"))
    return g.withColumn("fn_rate", F.when(F.col("late") > 0, F.col("false_negatives") / F.col("late")))


# T4 -----------------------------------------------------------------------
def profile_bounds(train: DataFrame, numeric: list[str]) -> dict[str, tuple[float, float]]:
    """Training minimum and maximum of each numeric feature (two numbers a feature)."""
    row = train.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in numeric for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in numeric}


def _step(feature: Column, x: Column, bounds: dict[str, tuple[float | None, float | None]]) -> Column:
    """Steps 0 to BINS - 1 of a number of the feature with that position; -1 below the training range, BINS above it; null for null,
    and NONE where training had no number."""
    lows, highs = ([b[k] for b in bounds.values()] for k in (0, 1))
    widths = [None if lo is None else hi - lo for lo, hi in zip(lows, highs)]
    lo, hi, width = (F.get(F.array(*[F.lit(v).cast("double") for v in vs]), feature) for vs in (lows, highs, widths))
    at = F.when(x < lo, -1).when(x > hi, BINS).when(lo == hi, 0).otherwise(F.least(F.floor((x - lo) / width * F.lit(float(BINS))), F.lit(BINS - 1)))
    return F.when(lo.isNull(), NONE).when(x.isNotNull(), at.cast("int"))


def binned_counts(df: DataFrame, bounds: dict[str, tuple], categories: list[str], *keep: str) -> DataFrame:
    """(keep..., feature, bin, n) of the rows' features; a null is the bin ``null``.

    Each row becomes one row a feature, (position, number, text), before its
    bin is found: one short expression for all features, which is compiled,
    and counted by numbers. Names are given to the counts.
    """
    if not bounds and not categories:
        return df.limit(0).select(*keep, F.lit("").alias("feature"), F.lit("").alias("bin"), F.lit(0).cast("long").alias("n"))
    n, names = len(bounds), [*bounds, *categories]
    cells = [F.struct(F.lit(i).alias("_i"), F.col(c).cast("double").alias("_x"), F.lit(None).cast("string").alias("_s")) for i, c in enumerate(bounds)]
    cells += [F.struct(F.lit(n + i).alias("_i"), F.lit(None).cast("double").alias("_x"), F.col(c).cast("string").alias("_s")) for i, c in enumerate(categories)]
    rows = df.select(*keep, F.inline(F.array(*cells)))
    step = _step(F.col("_i"), F.col("_x"), bounds) if bounds else F.lit(None).cast("int")
    counts = rows.groupBy(*keep, "_i", step.alias("_b"), "_s").agg(F.count("*").alias("n"))
    number = F.when(F.col("_b") == NONE, "none").otherwise(F.col("_b").cast("string"))
    text = F.coalesce(F.when(F.col("_i") < n, number).otherwise(F.concat(F.lit("="), F.col("_s"))), F.lit("null"))
    return counts.select(*keep, F.get(F.array(*map(F.lit, names)), F.col("_i")).alias("feature"), text.alias("bin"), "n")


def training_profile(train: DataFrame, bounds: dict[str, tuple], categories: list[str]) -> DataFrame:
    """(feature, bin, n): what is stored with a model."""
    return binned_counts(train, bounds, categories)


def merged(*profiles: DataFrame) -> DataFrame:
    """The profile of all rows, from profiles over the same bounds."""
    out = profiles[0]
    for p in profiles[1:]:
        out = out.union(p)
    return out.groupBy("feature", "bin").agg(F.sum("n").alias("n"))


def drift(df: DataFrame, day: Column, profile: DataFrame, bounds: dict[str, tuple], categories: list[str]) -> DataFrame:
    """(day, feature, rows, psi, ks): the stability index of a day's shares against the profile's, and for numbers the greatest
    difference of the two distribution functions at a step (null for categories)."""
    counts = binned_counts(df.select(day.alias("_day"), *dict.fromkeys([*bounds, *categories])), bounds, categories, "_day").withColumnRenamed("_day", "day")
    path = scratch_path(df.sparkSession, "day-counts")  # a row for each day and bin, read several times below
    counts.write.parquet(path)
    counts = df.sparkSession.read.parquet(path)
    days = counts.groupBy("day", "feature").agg(F.sum("n").alias("rows"))
    base = profile.select("feature", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).alias("q"))  # a row for each bin
    # every day meets every bin of the profile, and the bins that only it has
    grid = days.join(base, "feature").select("day", "feature", "rows", "bin", "q").alias("g")
    own = counts.select(F.col("day").alias("d"), F.col("feature").alias("f"), F.col("bin").alias("b"), "n").alias("o")
    cells = grid.join(own, (F.col("day").eqNullSafe(F.col("d"))) & (F.col("feature") == F.col("f")) & (F.col("bin") == F.col("b")), "full") \
        .select(F.coalesce("day", "d").alias("day"), F.coalesce("feature", "f").alias("feature"), F.coalesce("bin", "b").alias("bin"),
                F.coalesce("q", F.lit(0.0)).alias("q"), F.coalesce("n", F.lit(0)).alias("n"))
    cells = cells.join(days.select(F.col("day").alias("d"), F.col("feature").alias("f"), "rows"),
                       F.col("day").eqNullSafe(F.col("d")) & (F.col("feature") == F.col("f"))).drop("d", "f")
    share = F.col("n") / F.col("rows")
    p, q = F.greatest(share, F.lit(LEAST_SHARE)), F.greatest(F.col("q"), F.lit(LEAST_SHARE))
    upto = Window.partitionBy("day", "feature").orderBy(F.col("bin").try_cast("int").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    number = F.col("feature").isin(*bounds)
    gap = F.abs(F.sum(share).over(upto) - F.sum("q").over(upto))
    return cells.select("day", "feature", "rows", ((p - q) * F.log(p / q)).alias("term"), F.when(number, gap).alias("gap")) \
        .groupBy("day", "feature").agg(F.first("rows").alias("rows"), F.sum("term").alias("psi"), F.max("gap").alias("ks"))
