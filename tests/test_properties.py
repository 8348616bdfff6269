"""Properties: joins keep rows, keep-first is idempotent, explode sizes,
AUC invariances, skew-safe helpers equal their naive window forms."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from shiprisk.operators import enrich as E
from shiprisk.operators import geo as G
from shiprisk.operators import metrics as M
from shiprisk.operators import prefix as P
from shiprisk.operators import quality as Q
from shiprisk.operators import sequence as S
from shiprisk.operators import weather as W
from shiprisk.sources import testdata as td


def test_left_lookups_keep_row_count(spark, sf):
    from shiprisk.plans.enrichment import _dims
    req = td.typed_shipments(spark, sf)
    out = E.enrich_shipments(req, **_dims(spark, sf))
    assert out.count() == req.count()
    assert out.select("shipment_id").distinct().count() == req.select("shipment_id").distinct().count()


def test_lookup_with_duplicate_keys_does_not_fan_out(spark):
    fact = spark.createDataFrame([("a",), ("b",)], "vendor_name string")
    dim = spark.createDataFrame([("a", 0.9, 1.0, 5), ("a", 0.1, 9.0, 7)],
                                "vendor_name string, on_time_rate double, avg_delay_days double, total_shipments int")
    out = E.join_vendor(fact, dim).collect()
    assert len(out) == 2
    b = [r for r in out if r.vendor_name == "b"][0]
    assert (b.vendor_on_time_rate, b.vendor_avg_delay_days, b.vendor_total_shipments) == (0.5, 2.0, 0)


def test_dedupe_keep_first_idempotent_and_first(spark):
    rows = [("x", 2, 1.0), ("x", 1, 2.0), ("y", 5, 3.0), ("x", 3, 4.0)]
    df = spark.createDataFrame(rows, "k string, seq int, v double")
    once = Q.dedupe_keep_first(df, ["k"], ["seq"])
    twice = Q.dedupe_keep_first(once, ["k"], ["seq"])
    assert sorted(once.collect()) == sorted(twice.collect())
    assert sorted(tuple(r) for r in once.collect()) == [("x", 1, 2.0), ("y", 5, 3.0)]


def test_check_constraints_strict_and_quarantine(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (None,)], "r double")
    rules = ["r >= 0.0 AND r <= 1.0"]
    good_s, bad = Q.check_constraints(df, rules, mode="strict")
    good_q, _ = Q.check_constraints(df, rules, mode="quarantine")
    assert good_s.count() == 0 and bad.count() == 1
    assert good_q.count() == 2  # null passes a CHECK
    clean = spark.createDataFrame([(0.5,)], "r double")
    assert Q.check_constraints(clean, rules)[0].count() == 1


def test_explode_daily_weather_rows_equal_array_length(spark):
    payload = spark.createDataFrame(
        [("A", (["2024-01-01", "2024-01-02", "2024-01-03"], [1.0, None, 45.0], [7.0, 80.0, None], [None, 0.0, 20.0])),
         ("B", ([], [], [], []))],
        "city string, daily struct<time:array<string>, precipitation_sum:array<double>, "
        "windspeed_10m_max:array<double>, snowfall_sum:array<double>>")
    out = W.explode_daily_weather(payload).orderBy("departure_date").collect()
    assert len(out) == 3
    assert out[1].precipitation_mm == 0.0 and out[2].windspeed_max_kmh == 0.0
    assert out[2].weather_risk_score == round(min(1.0 * 0.5 + 0.0 + 1.0 * 0.15, 1.0), 4)


def test_polyline_point_counts(spark):
    df = spark.createDataFrame([(35.0, 139.0, 51.5, -0.1), (10.0, 10.0, 10.0, 10.0)],
                               "o_lat double, o_lon double, d_lat double, d_lon double")
    w = G.with_lane_waypoints(df, "w")
    start = F.struct(F.col("o_lat").alias("lat"), F.col("o_lon").alias("lon"))
    end = F.struct(F.col("d_lat").alias("lat"), F.col("d_lon").alias("lon"))
    r = w.select(F.size("w").alias("nw"), F.size(G.polyline_linear(start, F.col("w"), end, 8)).alias("n"),
                 F.size(G.polyline_great_circle("o_lat", "o_lon", "d_lat", "d_lon")).alias("g")).collect()
    assert r[0].nw == 7 and r[0].n == (7 + 1) * 9 and r[0].g == 81
    assert r[1].nw == 0 and r[1].n == 9 and r[1].g == 81


def test_route_geometry_branches(spark):
    rows = [("A", "B", "X", "Y", "Ocean"), ("A", "B", "X", "Y", "Air"), ("A", "B", "X", "X", "FTL"),
            ("A", "B", "X", "X", "Air"), ("A", "B", "X", "X", "Ocean"), ("A", "B", "X", "Y", "LTL")]
    df = spark.createDataFrame(rows, "origin_city string, destination_city string, origin_country string, "
                                     "destination_country string, carrier_type string")
    df = df.withColumns({"o_lat": F.lit(35.0), "o_lon": F.lit(139.0), "d_lat": F.lit(51.5), "d_lon": F.lit(-0.1)})
    got = [(r.route_type, r.n) for r in G.route_geometry(df).select("route_type", F.size("route").alias("n")).collect()]
    assert got == [("ocean", 72), ("air", 81), ("road", 13), ("air", 13), ("", 0), ("ocean", 72)]


def test_city_coordinates_exact_then_contains(spark):
    dic = spark.createDataFrame([("city_2", 2, 1.0, 2.0), ("city_20", 20, 3.0, 4.0), ("port", 5, 5.0, 6.0)],
                                "name string, ordinal int, lat double, lon double")
    cities = spark.createDataFrame([("CITY_20",), ("city_25",), ("por",), ("nowhere",)], "city string")
    got = {r.city: (r.lat, r.dictionary_ordinal) for r in G.city_coordinates(cities, dic).collect()}
    assert got == {"CITY_20": (3.0, 20), "city_25": (1.0, 2), "por": (5.0, 5), "nowhere": (None, None)}


def test_city_match_equals_brute_force(spark):
    """Empty and null keys, an empty dictionary name, repeated names, 10,000-character names, an extra column named key."""
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    long = "x" * 4000 + "müller-stadt" + "y" * 6000
    cities = [word(rnd.randint(1, 9)) for _ in range(300)] + ["", "  ", None, long, " MÜLLER-STADT ", "é", "zzzz"]
    names = [(word(rnd.randint(2, 7)), i) for i in range(60)] + [("ller-st", 70), ("é", 71), ("caf\u00e9", 72), (None, 0), ("q" * 10_000, 73)]
    for extra in ([], [("", 90)]):
        entries = [(n, i, float(i), -float(i)) for n, i in names + extra]
        dic = spark.createDataFrame(entries, "name string, ordinal int, lat double, lon double")
        df = spark.createDataFrame(list(enumerate(cities)), "key int, city string")
        got = {r.key: r.dictionary_ordinal for r in G.city_coordinates(df, dic).collect()}
        assert len(got) == len(cities)
        for at, c in enumerate(cities):
            k = None if c is None else c.strip(" ").lower()
            exact = [i for n, i, *_ in entries if n is not None and n == k]
            near = [i for n, i, *_ in entries if None not in (n, k) and (n in k or k in n)]
            assert got[at] == (min(exact) if exact else min(near) if near else None), c
    none = spark.createDataFrame([], "name string, ordinal int, lat double, lon double")
    assert [r.lat for r in G.city_coordinates(df, none).select("lat").distinct().collect()] == [None]


def _naive_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    num = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return num / (len(pos) * len(neg))


def test_auc_exact_and_monotone_invariant(spark):
    random.seed(3)
    pairs = [(round(random.random(), 2), random.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "s double, y int")
    got = M.roc_auc(df, "s", "y", buckets=7).first().auc
    assert abs(got - _naive_auc(pairs)) < 1e-12
    mono = M.roc_auc(df.withColumn("s", F.exp(F.col("s") * 3) + 1), "s", "y", buckets=3).first().auc
    assert abs(mono - got) < 1e-12
    assert 0.0 <= got <= 1.0


def test_running_totals_match_global_window(spark):
    rows = [(float(i % 37) + i / 1000.0, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "k double, v long")
    got = {r.k: r.cum_v for r in P.running_totals(df, "k", ["v"], buckets=6).collect()}
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    ref = {r.k: r.c for r in df.select("k", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("c")).collect()}
    assert got == ref


def _hot_events(spark):
    """One key with most rows, spread over several hours."""
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        key = "hot" if i % 5 else f"k{i % 3}"
        rows.append((i, base + dt.timedelta(minutes=7 * i), key, ["a", "a", "b"][(i // 3) % 3], float(i % 11)))
    return spark.createDataFrame(rows, "event_id long, ts timestamp, key string, cell string, x double")


def test_keyed_helpers_match_naive_windows(spark):
    df = _hot_events(spark)
    r = S.keyed_row_number(S.in_order(df, ["key"], ["ts", "event_id"], 7), ["key"], ["ts", "event_id"])
    r = S.keyed_running_sum(r, ["key"], ["ts", "event_id"], ["x"])
    r = S.keyed_lag(r, ["key"], "rn", ["cell"])
    got = {(x.event_id): (x.rn, x.cum_x, x.prev_cell) for x in r.collect()}
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    ref = df.select("event_id", F.row_number().over(w).alias("rn"),
                    F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"),
                    F.lag("cell").over(w).alias("p")).collect()
    assert got == {x.event_id: (x.rn, x.c, x.p) for x in ref}


def test_ranges_split_a_key_within_one_second(spark):
    """One key with most rows and one time stamp, null keys and times: groups stay small, results equal naive windows."""
    n, t = 4000, dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 97 == 0 else t, None if i % 13 == 0 else "hot" if i % 3 else f"k{i % 50}", ["a", "b", None][(i // 7) % 3], i % 11)
            for i in range(n)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, key string, cell string, x long")
    order = ["ts", "event_id"]
    placed = S.in_order(df, ["key"], order, 8)
    assert placed.groupBy("key", S.RANGE).count().agg(F.max("count")).first()[0] <= 2 * n / 8
    assert placed.where("key = 'hot'").select(S.RANGE).distinct().count() >= 4
    r = S.keyed_totals(S.keyed_running_sum(placed, ["key"], order, ["x"]), ["key"], ["x"])
    r = S.keyed_previous(r, ["key"], order, ["cell", "event_id"])
    got = {x.event_id: (x.cum_x, x.all_x, x.prev_cell, x.prev_event_id) for x in r.collect()}
    w = Window.partitionBy("key").orderBy(*order)
    ref = df.select("event_id", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"),
                    F.sum("x").over(Window.partitionBy("key")).alias("a"), F.lag("cell").over(w).alias("p"), F.lag("event_id").over(w).alias("e"))
    assert got == {x.event_id: (x.c, x.a, x.p, x.e) for x in ref.collect()}
    empty = S.in_order(df.limit(0), ["key"], order)
    assert S.keyed_previous(S.keyed_running_sum(empty, ["key"], order, ["x"]), ["key"], order, ["cell"]).count() == 0


def test_percentiles_of_a_hot_window(spark, monkeypatch):
    """One window with most values is ranked in many ranges and equals the interpolated percentiles; null values, all-null windows."""
    import numpy as np
    from shiprisk.operators import monitor as MO
    whole, groups = S.in_order, []

    def spied(df, keys, order):
        placed = whole(df, keys, order, 8)
        groups.append(placed.groupBy(*keys, S.RANGE).count().agg(F.max("count"), F.sum("count")).first())
        return placed
    monkeypatch.setattr(S, "in_order", spied)
    values = [("hot", float((i * 7919) % 3001) / 3) for i in range(4000)] + [("cold", float(i % 5)) for i in range(77)]
    rows = values + [("hot", None)] * 9 + [("none", None)] * 4 + [(None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "w string, v double")
    got = {r.w: (r.p50, r.p95, r.n) for r in MO.exact_percentiles(df, "w", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for w, n in (("hot", 4009), ("cold", 77), (None, 2)):
        v = [x for k, x in rows if k == w and x is not None]
        assert got[w][2] == n and np.allclose(got[w][:2], np.percentile(v, [50, 95]))
    assert got["none"] == (None, None, 4) and len(got) == 4
    assert groups[0][0] <= 2 * groups[0][1] / 8


def test_exact_stratified_split_multi_level(spark, sf):
    """Force several refinement levels (tiny exact-rank threshold) and compare with a
    naive per-label ranking."""
    import math
    from shiprisk.models.pipeline import stratified_split_exact
    g = td.given_scores(spark, sf).select("shipment_id", "delay_flag").dropDuplicates(["shipment_id"])
    got = {r.shipment_id: r.is_test for r in stratified_split_exact(g).collect()}
    w = Window.partitionBy("delay_flag").orderBy(F.md5("shipment_id"), "shipment_id")
    n = {r[0]: r[1] for r in g.groupBy("delay_flag").count().collect()}
    ref = g.withColumn("rn", F.row_number().over(w)).collect()
    want = {r.shipment_id: r.rn <= math.ceil(n[r.delay_flag] * 0.2) for r in ref}
    assert got == want
    counts = {}
    for r in ref:
        counts[r.delay_flag] = counts.get(r.delay_flag, 0) + int(got[r.shipment_id])
    assert counts == {k: math.ceil(v * 0.2) for k, v in n.items()}


def test_staged_fact_table_is_spread_and_stats_are_not(spark, sf):
    """The staged shipments view is written at least as wide as the default parallelism
    (the test inputs are single row groups); small stats tables are written as they are."""
    sh = td.shipments(spark, sf)
    assert sh.rdd.getNumPartitions() >= min(spark.sparkContext.defaultParallelism, sh.count())
    assert td.vendor_stats(spark, sf).inputFiles() and len(td.vendor_stats(spark, sf).inputFiles()) <= 2


def test_exact_split_with_an_id_of_many_copies(spark):
    """The share of each label is exact where one id holds most rows, for null labels and ids, and for no rows."""
    import math
    from shiprisk.models.pipeline import stratified_split_exact
    rows = [("hot", 1)] * 20_000 + [(f"a{i}", i % 2) for i in range(3001)] + [(f"n{i}", None) for i in range(7)] + [(None, 1)] * 3
    split = stratified_split_exact(spark.createDataFrame(rows, "shipment_id string, delay_flag int"))
    got = {r.delay_flag: (r.n, r.t) for r in split.groupBy("delay_flag").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert got == {1: (21_503, math.ceil(21_503 / 5)), 0: (1501, math.ceil(1501 / 5)), None: (7, 2)}
    assert stratified_split_exact(spark.createDataFrame([], "shipment_id string, delay_flag int")).count() == 0
