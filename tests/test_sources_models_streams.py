"""Loads by position (rows copied inline), the reference-data facts,
model fit/save/load, and late data in the streaming forms."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from shiprisk.functions import expressions as X
from shiprisk.operators import enrich as E
from shiprisk.sources import files as FS

VENDOR_CSV = """vendor_name,on_time_rate,avg_delay_days,total_shipments
FedEx,0.93,0.8,850000
UPS,0.92,0.9,920000
USPS,0.84,1.6,4500000
"""
HOLIDAY_CSV = """country_code,holiday_date,holiday_name,is_major
US,2026-01-01,New Year,True
IN,2026-01-26,Republic Day,True
CN,2026-02-15,Spring Festival,True
"""
COUNTRY_CSV = """country_code,lpi_score,customs_tier,geopolitical_risk,port_congestion
Afghanistan,5.0,3,0.6399644620228003,4.3465177837275615
Albania,5.0,2,0.2270369317441269,4.877372914605422
"""


def _write(text: str) -> str:
    d = tempfile.mkdtemp(prefix="shiprisk-test-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_load_dimension_by_position_boolean_weight(spark):
    h = FS.load_dimension(spark, "holiday_calendar", _write(HOLIDAY_CSV)).orderBy("holiday_date").collect()
    assert [r.risk_weight for r in h] == [1.0, 1.0, 1.0]
    assert h[0].country_code == "US" and h[0].holiday_date == dt.date(2026, 1, 1)
    assert h[0].holiday_name == "New Year"


def test_missing_file_gives_empty_typed_table(spark):
    v = FS.load_dimension(spark, "vendor_stats", "/nonexistent/shiprisk/vendor_stats.csv")
    assert v.count() == 0 and [f.name for f in v.schema.fields][0] == "vendor_name"


def test_reference_vendors_excellent_and_sanitized_miss(spark):
    v = FS.load_dimension(spark, "vendor_stats", _write(VENDOR_CSV))
    tiers = [r[0] for r in v.select(X.vendor_tier("on_time_rate")).collect()]
    assert tiers == ["EXCELLENT"] * 3
    fact = spark.createDataFrame([("FedEx",), ("DHL",)], "vendor_name string")
    got = {r.vendor_name: r.vendor_on_time_rate for r in E.join_vendor(fact, v).collect()}
    assert got == {"FedEx": 0.93, "DHL": 0.5}


def test_upper_cased_country_misses_title_case_table_in_strict_mode(spark):
    risk = FS.load_dimension(spark, "country_risk", _write(COUNTRY_CSV))
    req = spark.createDataFrame([("Afghanistan",)], "origin_country string")
    strict = E.join_country_risk(req, risk, "origin_country", "origin", strict_case=True).first()
    intent = E.join_country_risk(req, risk, "origin_country", "origin").first()
    assert strict.origin_lpi_score == 3.0 and strict.origin_customs_tier == 2      # default: reference result
    assert intent.origin_lpi_score == 5.0 and intent.origin_customs_tier == 3      # normalized keys match
    score = risk.select(X.country_risk_category(X.country_risk_score(
        "lpi_score", "customs_tier", "geopolitical_risk", "port_congestion"))).collect()
    assert [r[0] for r in score] == ["MEDIUM", "LOW"]  # 9.87 and 6.57


def test_geocode_cache_round_trip(spark):
    rows = spark.createDataFrame([("Paris", "FR", 48.85, 2.35), ("Atlantis", "XX", None, None)],
                                 "city string, country string, lat double, lon double")
    text = FS.geocode_table_to_cache(rows)
    back = {r.city: (r.country, r.lat, r.lon) for r in FS.geocode_cache_to_table(text).collect()}
    assert back == {"Paris": ("FR", 48.85, 2.35), "Atlantis": ("XX", None, None)}


def test_reference_default_params_are_wired():
    from shiprisk.models.pipeline import TrainParams
    p = TrainParams()
    assert (p.rf_trees, p.rf_depth, p.rf_min_leaf) == (100, 10, 10)
    assert (p.gbt_a_iter, p.gbt_a_lr, p.gbt_a_depth) == (200, 0.05, 8)
    assert (p.gbt_b_iter, p.gbt_b_depth, p.reg_iter, p.reg_depth) == (100, 6, 200, 10)
    assert (p.kmeans_k, p.kmeans_restarts, p.test_percent) == (4, 10, 20)


def test_registered_queries_fit_the_full_settings(spark, sf):
    """The registry's own trainer, fitted: as many trees, rounds and levels as the reference sets."""
    from shiprisk.models import pipeline as MP
    from shiprisk.plans import ml_q
    assert ml_q.trainer(spark, sf).params == MP.TrainParams()
    model = ml_q.fitted(spark, sf)
    trees = {n: len(f.roots) for n, f in model.forests.items()}
    assert trees == {"rf": 100, "gbt_a": 200, "gbt_b": 100, "regressor": 200, **{f"reason_{k}": 200 for k in range(4)}}
    assert {n: f.depth <= d for (n, f), d in zip(sorted(model.forests.items()), (8, 6, 8, 8, 8, 8, 10, 10))} == dict.fromkeys(sorted(trees), True)
    row = ml_q.q_held_out_domains(spark, sf).first()
    assert row.vote_rows == row.probabilities == row.votes > 0 and row.late_rows == row.days == row.reasons > 0
    m = ml_q.trainer(spark, sf).metrics().first()
    assert m.auc > 0.5 and m.accuracy > 0.5 and m.reason_accuracy > 0.8


def test_boosting_learns_and_bins():
    import numpy as np
    from shiprisk.models import boosting as B
    rng = np.random.default_rng(0)
    x = [rng.normal(size=4000), rng.integers(0, 5, 4000).astype(float), np.full(4000, 3.0), np.where(rng.random(4000) < .1, np.nan, rng.normal(size=4000))]
    edges = [np.unique(np.nanquantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x]
    codes = B.codes_of(x, edges)
    assert codes.dtype == np.uint8 and (codes[np.isnan(x[3]), 3] == 0).all() and codes[~np.isnan(x[3]), 3].min() >= 1
    for j in (0, 1):  # a bin holds the values above one bound, up to the next
        assert (np.diff([codes[np.argsort(x[j]), j].astype(int)]) >= 0).all()
    truth = ((x[0] > 0.3) ^ (x[1] >= 3)).astype(float)
    days = np.where(x[0] > 0, 2.0, -1.0) * x[1]
    fit, held = slice(0, 3000), slice(3000, 4000)
    for s in (B.Settings("logistic", 40, .2, balanced=True), B.Settings("logistic", 40, .2, 6, 64, 1, 1.0, 1.0), B.Settings("forest", 30, depth=10, leaves=1024, least_rows=10)):
        f = B.fit(codes[fit], truth[fit], s)
        p = f.probability(codes[held])
        assert ((p >= .5) == truth[held]).mean() > .93 and 0 <= p.min() and p.max() <= 1 and f.depth <= s.depth
        leaves = [sum(1 for i in range(a, b) if f.left[i] == i) for a, b in zip(f.roots, [*f.roots[1:], len(f.value)])]
        assert max(leaves) <= s.leaves
    r = B.fit(codes[fit], days[fit], B.Settings("squared", 80, .2))
    assert np.abs(r.raw(codes[held]) - days[held]).mean() < .4 < np.abs(days[held] - days.mean()).mean()
    parts = [B.fit(codes[fit], truth[fit], B.Settings("forest", 5, depth=4, leaves=16, seed=k)) for k in range(3)]
    assert np.allclose(B.joined(parts).raw(codes), np.mean([q.raw(codes) for q in parts], axis=0))


def test_boosting_without_rows_or_classes():
    import numpy as np
    from shiprisk.models import boosting as B
    for loss in ("logistic", "squared", "forest"):
        assert len(B.fit(np.zeros((0, 2), np.uint8), np.zeros(0), B.Settings(loss, 3)).raw(np.zeros((4, 2), np.uint8))) == 4
    one = B.fit(np.ones((50, 2), np.uint8), np.ones(50), B.Settings("logistic", 3, balanced=True))
    assert one.probability(np.ones((2, 2), np.uint8)).min() > .99
    first = B.fit(np.repeat([[1], [2]], 30, 0).astype(np.uint8), np.repeat([0., 1.], 30), B.Settings("squared", 1, 1.0, l2=1.0))
    assert np.allclose(first.raw(np.array([[1], [2]], np.uint8)), [0.5 - 15 / 31, 0.5 + 15 / 31])  # one Newton step by hand


def test_model_fit_score_save_load(spark, sf):
    from shiprisk.models import pipeline as MP
    from shiprisk.plans.enrichment import _dims
    from shiprisk.plans.expressions_q import training_table
    from shiprisk.sources import testdata as td
    model, metrics = MP.fit_delay_model(training_table(spark, sf), MP.TrainParams.quick())
    m = metrics.first()
    assert 0.0 <= m.accuracy <= 1.0 and 0.0 <= m.auc <= 1.0 and m.mae >= 0.0
    feats = E.enrich_shipments(td.typed_shipments(spark, sf), **_dims(spark, sf))
    scored = MP.score_shipments(feats, model)
    bad = scored.where((F.col("delay_probability") < 0) | (F.col("delay_probability") > 1)
                       | (F.col("adjusted_delay_probability") < 0) | (F.col("adjusted_delay_probability") > 1)
                       | (~F.col("delay_predicted") & (F.col("delay_reason") != ""))
                       | (F.col("estimated_delay_days") < 0)).count()
    assert bad == 0
    path = tempfile.mkdtemp(prefix="shiprisk-model-")
    model.save(path)
    again = MP.score_shipments(feats, MP.DelayModel.load(spark, path))
    assert sorted(map(tuple, scored.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_stream_window_drops_late_rows(spark):
    """Three files in arrival order; the third holds a row far behind the watermark."""
    from shiprisk.streaming import jobs as SJ
    folder = tempfile.mkdtemp(prefix="shiprisk-stream-")
    base = dt.datetime(2024, 1, 1, 0, 0, 0)

    def batch(rows, name):
        df = spark.createDataFrame(rows, SJ.EVENTS_SCHEMA)
        df.coalesce(1).write.parquet(os.path.join(folder, "in", name))

    def ev(i, minutes, kind):
        return (i, base + dt.timedelta(minutes=minutes), 1, kind, 10.0, "{}")
    os.makedirs(os.path.join(folder, "in"))
    stream = (spark.readStream.schema(SJ.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(os.path.join(folder, "in"))
              .withColumn("ts", F.col("ts").cast("timestamp")))
    out = os.path.join(folder, "out")
    # each file arrives, then the query runs to completion on the same checkpoint
    # (the watermark is restored from the checkpoint on every restart)
    for name, rows in (("a", [ev(1, 0, "error"), ev(2, 1, "view")]),
                       ("b", [ev(3, 30, "view"), ev(4, 31, "view")]),
                       ("c", [ev(5, 0, "error"), ev(6, 60, "view")])):  # event 5 is behind the watermark
        batch(rows, name)
        SJ.run_to_parquet(SJ.error_rate_stream(stream), out, os.path.join(folder, "ckpt"))
    got = {r.window_start.replace(tzinfo=None): (r.requests, r.errors)
           for r in spark.read.parquet(out).collect()}
    assert got[base] == (2, 1)                    # the late error is not counted
    assert got[base + dt.timedelta(minutes=30)] == (2, 0)
    assert base + dt.timedelta(minutes=60) not in got   # still open when the input ends


def test_stationary_stream_timer_alerts_on_silence(spark):
    """A shipment pings once and goes quiet; another shipment's later pings move the
    watermark. The event-time timer alerts at start + 2 h (silence mode only)."""
    from shiprisk.streaming import jobs as SJ
    base = dt.datetime(2024, 1, 1, 0, 0, 0)

    def ev(i, user, minutes, cell):
        return (i, base + dt.timedelta(minutes=minutes), user, cell, 1.0, "{}")

    results = {}
    for mode in (False, True):
        folder = tempfile.mkdtemp(prefix="shiprisk-timer-")
        os.makedirs(os.path.join(folder, "in"))
        stream = (spark.readStream.schema(SJ.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", "true").parquet(os.path.join(folder, "in"))
                  .withColumn("ts", F.col("ts").cast("timestamp")))
        out = os.path.join(folder, "out")
        for name, rows in (("a", [ev(1, 1, 0, "A")]), ("b", [ev(2, 2, 240, "B")]), ("c", [ev(3, 2, 250, "B")])):
            spark.createDataFrame(rows, SJ.EVENTS_SCHEMA).coalesce(1).write.parquet(os.path.join(folder, "in", name))
            SJ.run_to_parquet(SJ.stationary_alert_stream(stream, on_silence=mode), out, os.path.join(folder, "ckpt"))
        results[mode] = [(r.user_id, r.event_type, r.stationary_seconds) for r in spark.read.parquet(out).collect()]
    assert results[False] == []
    assert results[True] == [(1, "A", 7200)]


def test_ordered_streams_equal_the_batch_form(spark):
    """Rows late within the watermark, shuffled over files, with null cells, in Arrow chunks of two rows: as if sorted at once."""
    import random
    from shiprisk.streaming import jobs as SJ
    rng, base = random.Random(8), dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=rng.randint(0, 3000)), rng.randint(1, 3), rng.choice(["A", "A", "A", "B", None]), 1.0, "{}") for i in range(240)]
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randint(0, 50)))  # arrival: at most 50 minutes out of order
    folder = tempfile.mkdtemp(prefix="shiprisk-ordered-")
    for k in range(4):
        part = late[k * 60:(k + 1) * 60]
        rng.shuffle(part)
        spark.createDataFrame(part, SJ.EVENTS_SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part={k}")
    stream = SJ.events_stream(spark, f"{folder}/in/*", "*.parquet")
    end = max(r[1] for r in rows) - dt.timedelta(hours=1)
    want_alerts, want_hits = set(), set()
    for user in {r[2] for r in rows}:
        cell = start = None
        alerted, last = False, {}
        for i, ts, _, c, _, _ in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0])):
            if start is None or c != cell:
                cell, start, alerted = c, ts, False
            elif not alerted and ts - start >= dt.timedelta(hours=2):
                alerted = True
                want_alerts |= {(user, c, start, ts)} if ts <= end else set()
            if c is not None and ts <= end:
                want_hits.add((user, c, i, c in last and ts - last[c] <= dt.timedelta(hours=6)))
            last[c] = ts
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        SJ.run_to_parquet(SJ.stationary_alert_stream(stream), f"{folder}/alerts", f"{folder}/alerts-ckpt")
        SJ.run_to_parquet(SJ.reuse_stream(stream, ["user_id", "event_type"]), f"{folder}/hits", f"{folder}/hits-ckpt")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plain = lambda t: t.replace(tzinfo=None)
    assert {(r.user_id, r.event_type, plain(r.start_ts), plain(r.alert_ts)) for r in spark.read.parquet(f"{folder}/alerts").collect()} == want_alerts
    assert want_alerts and {(r.user_id, r.event_type, r.event_id, r.cache_hit) for r in spark.read.parquet(f"{folder}/hits").collect()} == want_hits


def test_stream_surge_carries_state_across_epochs(spark, sf):
    """Events in three time-ordered files -> three micro-batches; the flags equal the
    batch form on the windows the watermark has closed."""
    from shiprisk.operators import monitor as MO
    from shiprisk.sources import testdata as td
    from shiprisk.streaming import jobs as SJ
    folder = tempfile.mkdtemp(prefix="shiprisk-surge-")
    ev = td.table(spark, sf, "events")
    day = F.dayofmonth("ts")
    for i, (lo, hi) in enumerate(((1, 10), (11, 20), (21, 31))):
        ev.where((day >= lo) & (day <= hi)).coalesce(1).write.parquet(os.path.join(folder, "in", f"part{i}"))
    stream = (spark.readStream.schema(SJ.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(os.path.join(folder, "in"))
              .withColumn("ts", F.col("ts").cast("timestamp")))
    out = os.path.join(folder, "out")
    SJ.request_surge_stream(stream, os.path.join(folder, "state"), out, os.path.join(folder, "ckpt"))
    got = spark.read.parquet(out)
    assert got.select("epoch").distinct().count() >= 2
    batch = MO.request_rate(td.events(spark, sf), "ts", "event_type")
    max_ts = td.events(spark, sf).agg(F.max("ts")).first()[0]
    closed = batch.where(F.col("window_start") + F.expr("INTERVAL 70 MINUTES") <= F.lit(max_ts))
    key = ["window_start", "endpoint"]
    a = {tuple(r[:2]): (r.requests, r.normal, r.surge) for r in got.select(*key, "requests", "normal", "surge").collect()}
    b = {tuple(r[:2]): (r.requests, r.normal, r.surge) for r in closed.select(*key, "requests", "normal", "surge").collect()}
    assert a == b
