"""T6 and T4 on small tables, by hand."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from shiprisk.operators import outcomes as OC

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 1)


def test_match_outcomes(spark):
    log = spark.createDataFrame([("a", T0, False), ("a", T0 + 2 * DAY, True), ("a", T0 + 9 * DAY, False),  # the last before delivery counts
                                 ("b", T0, False),                                                        # delivered late, predicted on time
                                 ("c", T0, True),                                                         # nothing delivered by then
                                 ("d", T0, True),                                                         # the prediction is too old
                                 ("e", T0, False), ("e", T0, True),                                       # equal times: the one that predicted a delay
                                 (None, T0, True)], "shipment_id string, predicted_at timestamp, predicted boolean")
    deliveries = spark.createDataFrame([("a", T0 + 5 * DAY, True), ("a", T0 + 8 * DAY, False), ("b", T0 + DAY, True), ("c", T0 + 70 * DAY, True),
                                        ("d", T0 + 40 * DAY, True), ("e", T0 + DAY, True), (None, T0, True), ("z", T0, True)],
                                       "shipment_id string, delivered_at timestamp, late boolean")
    m = OC.match_outcomes(log, deliveries, "2024-03-01 00:00:00")
    got = {r.shipment_id: (r.predicted, r.late, r.status) for r in m.collect()}
    assert got == {"a": (True, True, "matched"), "b": (False, True, "matched"), "c": (True, None, "pending"), "d": (True, True, "stale"), "e": (True, True, "matched")}
    rates = {r.day.isoformat(): (r.shipments, r.pending, r.stale, r.late, r.false_negatives, r.fn_rate) for r in OC.outcome_rates(m).collect()}
    assert rates == {"2024-01-03": (1, 0, 0, 1, 0, 0.0), "2024-01-01": (4, 1, 1, 2, 1, 0.5)}
    assert OC.match_outcomes(log.limit(0), deliveries, "2024-03-01").count() == 0
    assert {r.status for r in OC.match_outcomes(log, deliveries.limit(0), "2024-03-01").collect()} == {"pending"}


def test_drift_against_a_stored_profile(spark):
    schema = "day int, x double, k string"
    train = spark.createDataFrame([(0, float(i), "u" if i % 2 else "v") for i in range(101)] + [(0, None, None)], schema)
    bounds = OC.profile_bounds(train, ["x"])
    assert bounds == {"x": (0.0, 100.0)}
    profile = OC.training_profile(train, bounds, ["k"])
    halves = OC.merged(OC.training_profile(train.where("x < 50"), bounds, ["k"]), OC.training_profile(train.where("x >= 50 or x is null"), bounds, ["k"]))
    assert sorted(map(tuple, profile.collect())) == sorted(map(tuple, halves.collect()))
    seen = spark.createDataFrame([(1, float(i), "u" if i % 2 else "v") for i in range(101)] + [(1, None, None)]  # the training day again
                                 + [(2, -5.0, "w"), (2, 500.0, "w")], schema)                                # outside the range, a new category
    got = {(r.day, r.feature): (r.rows, r.psi, r.ks) for r in OC.drift(seen, F.col("day"), profile, bounds, ["k"]).collect()}
    assert got[1, "x"][0] == 102 and abs(got[1, "x"][1]) < 1e-12 and abs(got[1, "x"][2]) < 1e-12 and got[1, "k"][2] is None
    e = OC.LEAST_SHARE
    term = lambda p, q: (max(p, e) - max(q, e)) * math.log(max(p, e) / max(q, e))
    steps = [min(19, math.floor(i / 100.0 * 20.0)) for i in range(101)]
    shares = [steps.count(k) / 102 for k in range(20)] + [1 / 102]
    assert math.isclose(got[2, "x"][1], sum(term(0, q) for q in shares) + 2 * term(.5, 0))
    assert math.isclose(got[2, "x"][2], 0.5) and math.isclose(got[2, "k"][1], term(0, 50 / 102) + term(0, 51 / 102) + term(0, 1 / 102) + term(1, 0))


def test_drift_counts_rows_once_by_numbers(spark):
    """Bins are found after a row has become one row a feature, with short keys, and the rows of a day are counted once; odd numbers keep their bins."""
    schema = "day int, x double, y double, z double, k string"
    nan = float("nan")
    rows = spark.createDataFrame([(1, 0.0, 5.0, None, "a"), (1, 10.0, 5.0, None, None), (2, nan, 6.0, 1.0, "null"), (2, -1.0, 4.0, None, "a"), (None, None, None, 0.0, "")], schema)
    bounds = {"x": (0.0, 10.0), "y": (5.0, 5.0), "z": (None, None)}
    counts = OC.binned_counts(rows, bounds, ["k"], "day")
    got = sorted(map(str, map(tuple, counts.collect())))
    want = [(1, "x", "0", 1), (1, "x", "19", 1), (2, "x", "20", 1), (2, "x", "-1", 1), (None, "x", "null", 1), (1, "y", "0", 2), (2, "y", "20", 1), (2, "y", "-1", 1),
            (None, "y", "null", 1), (1, "z", "none", 2), (2, "z", "none", 2), (None, "z", "none", 1), (1, "k", "=a", 1), (1, "k", "null", 1), (2, "k", "=null", 1),
            (2, "k", "=a", 1), (None, "k", "=", 1)]
    assert got == sorted(map(str, want))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE" not in plan[plan.index("Generate"):]  # no bin is made before the rows are split
    d = OC.drift(rows, F.col("day"), OC.training_profile(rows, bounds, ["k"]), bounds, ["k"])
    assert "LocalTableScan" not in d._jdf.queryExecution().optimizedPlan().toString()  # the rows themselves are not read again
    assert OC.binned_counts(rows, {}, [], "day").count() == 0
