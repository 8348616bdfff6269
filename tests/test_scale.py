"""Steps whose cost must not grow faster than their input: scoring by masks, the hash-cut sample, shared k-means passes,
bulk stream state, packed outcomes and the staging joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _walked(f, codes):
    """Each row's sum (or mean) of leaves, one node at a time."""
    out = []
    for row in codes:
        leaves = []
        for node in f.roots:
            while f.left[node] != node:
                node = f.left[node] if row[f.feature[node]] <= f.bin[node] else f.right[node]
            leaves.append(f.value[node])
        out.append(f.base + (np.mean(leaves) if f.mean else np.sum(leaves)))
    return np.array(out)


def test_scoring_by_masks_equals_a_walk():
    from shiprisk.models import boosting as B
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (3000, 6)).astype(np.uint8)
    codes[:, 2] %= 3
    y = ((codes[:, 0] > 99) ^ (codes[:, 1] > 180) ^ (codes[:, 2] == 1)).astype(float)
    for s in (B.Settings("logistic", 12, .1, 8, 31), B.Settings("logistic", 12, .1, 6, 64, least_rows=1), B.Settings("squared", 3, leaves=1),
              B.Settings("forest", 6, depth=10, leaves=1024, least_rows=5)):
        f = B.fit(codes, y, s)
        assert isinstance(B._tables(f)[0], list) == (s.loss != "forest")
        seen = rng.integers(0, 256, (700, 6)).astype(np.uint8)
        assert np.allclose(f.raw(seen), _walked(f, seen))


def test_sample_is_the_smallest_hashes_of_few_sorted_rows(spark, tmp_path):
    from shiprisk.models import pipeline as MP
    rows = spark.range(20_000).select(F.concat(F.lit("s"), (F.col("id") % 15_000)).alias("shipment_id"), F.col("id").alias("x"))
    trainer = MP.DelayTrainer.__new__(MP.DelayTrainer)
    trainer.params = MP.TrainParams(fit_rows=500)
    h = F.xxhash64("shipment_id", F.lit(42))
    want = [r.shipment_id for r in rows.orderBy(h, "shipment_id").limit(500).collect()]
    got = trainer._sample(rows)
    assert [r.shipment_id for r in got.collect()] == want
    assert "shiftright" in got._jdf.queryExecution().optimizedPlan().toString()  # only rows up to the cut are sorted
    trainer.params = MP.TrainParams(fit_rows=50_000)
    assert trainer._sample(rows).count() == 20_000


def test_kmeans_finds_groups_in_few_passes(spark):
    """Four far groups, ten restarts: as many jobs as passes, whatever the restarts; equal to Lloyd's fixed point."""
    from shiprisk.models import clusters as K
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, .2, (400, 2)) for m in ((0, 0), (9, 0), (0, 9), (9, 9))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])).repartition(3)
    rows = df.select(K.row_bytes(["a", "b"]).alias("x")).cache()
    spark.sparkContext.setJobGroup("kmeans", "passes")
    try:
        found = K.fit(rows, ["a", "b"], 4, list(range(10)))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("kmeans"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 1 + K.STEPS + 1 + K.ROUNDS + 1
    means = sorted(tuple(np.round(x[i:i + 400].mean(0), 6)) for i in range(0, 1600, 400))
    assert sorted(tuple(np.round(c, 6)) for c in found.centers) == means
    got = found.transform(df).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in got) == [400] * 4
    same = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, b double").select(K.row_bytes(["a", "b"]).alias("x"))
    assert K.fit(same, ["a", "b"], 4, [1, 2]).centers.tolist() == [[1.0, 2.0]]  # fewer centers than k, where rows do not differ


class _State:
    def __init__(self, calls):
        self.rows, self.calls = [], calls

    def exists(self):
        self.calls.append("exists")
        return bool(self.rows)

    def get(self):
        self.calls.append("get")
        return iter(self.rows)

    def put(self, rows):
        self.calls.append("put")
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class _Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getListState(self, name, schema):  # noqa: N802
        return _State(self.calls)

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)


class _Times:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_stream_state_is_read_and_written_in_bulk():
    """Two thousand keys in one part: a handful of state requests, and each key's rows in time order."""
    from pyspark.sql import types as T
    from shiprisk.streaming import ordered as O
    step = O.reuse_step(5_000_000)
    out = T.StructType([T.StructField("k", T.LongType()), *step.output.fields])
    p, handle = O._InOrder(step, ["k"], ["bigint"], [], [], out), _Handle()
    p.init(handle)
    n = 2000
    rows = pd.DataFrame({"k": [*range(n)] * 2, "us": [4_000_000] * n + [1_000_000] * n, "tie": range(2 * n)})
    assert not list(p.handleInputRows((7,), iter([rows]), _Times(0)))
    assert handle.timers == [1000]
    got = pd.concat(p.handleExpiredTimer((7,), _Times(4000), None))
    assert len(got) == 2 * n and got[got.event_id < n].cache_hit.all() and not got[got.event_id >= n].cache_hit.any()
    assert len(handle.calls) < 20
    assert handle.timers == [9001]  # when memory goes
    assert not list(p.handleExpiredTimer((7,), _Times(9001), None)) and not p.memory.rows and not handle.timers


def test_packed_times_keep_order_and_nulls(spark):
    from shiprisk.operators import outcomes as OC
    rows = spark.sql("""select * from values (timestamp'1969-12-31 23:59:59.999999', true), (timestamp'2024-01-01 00:00:00', false), (timestamp'2024-01-01 00:00:00', null),
                        (timestamp'2024-01-01 00:00:00', true), (null, true), (null, null), (null, false), (timestamp'9000-12-31 00:00:00', true), (timestamp'1900-01-01 00:00:00', false) as t(at, flag)""")
    p = rows.select("at", "flag", OC._packed("at", "flag").alias("p"))
    for r in p.select("at", "flag", OC._time("p").alias("a"), OC._flag("p").alias("f")).collect():
        assert (r.a, r.f) == (r.at, r.flag)
    by_struct = [tuple(r) for r in p.orderBy(F.struct("at", "flag")).select("at", "flag").collect()]
    assert [tuple(r) for r in p.orderBy("p").select("at", "flag").collect()] == by_struct


def test_outcomes_are_hashed_not_sorted(spark):
    from shiprisk.operators import outcomes as OC
    log = spark.createDataFrame([("a", "2024-01-01", True), ("a", "2024-01-05", False), ("b", "2023-01-01", None), ("c", None, True)], "shipment_id string, predicted_at string, predicted boolean")
    done = spark.createDataFrame([("a", "2024-01-04", True), ("a", "2024-01-06", False), ("b", "2024-01-01", None)], "shipment_id string, delivered_at string, late boolean")
    m = OC.match_outcomes(log.withColumn("predicted_at", F.col("predicted_at").cast("timestamp")), done.withColumn("delivered_at", F.col("delivered_at").cast("timestamp")), "2024-02-01")
    got = {r.shipment_id: (str(r.predicted_at)[:10], r.predicted, str(r.delivered_at)[:10], r.late, r.status) for r in m.collect()}
    assert got == {"a": ("2024-01-01", True, "2024-01-04", True, "matched"), "b": ("2023-01-01", None, "2024-01-01", None, "stale"),
                   "c": ("None", True, "None", None, "pending")}
    assert "SortAggregate" not in m._jdf.queryExecution().executedPlan().toString()


def test_shipments_are_shuffled_before_they_are_wide(spark, sf):
    """No exchange of the staging plan carries the shipment id or the countries of a line."""
    from shiprisk.sources import testdata as td
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = td.build_shipments(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [ln for ln in plan.splitlines() if "RepartitionByExpression" in ln]
    assert len(dealt) == 1 and "l_orderkey" in dealt[0] and "shipment_id" not in dealt[0]
    assert plan.index("origin_country") < plan.index("RepartitionByExpression")  # texts come above it


def test_orders_csv_is_packed_in_bounded_files(spark, sf):
    from shiprisk.plans import catalog
    catalog.load_all()
    assert all(f.endswith(".csv.gz") for f in catalog.QUERIES["scan_shipments_csv"](spark, sf).inputFiles())


def test_lines_are_shuffled_once_at_any_size(spark, tmp_path):
    """The deal of the lines is the shuffle of their join with the orders, also where the planner would broadcast; same rows."""
    from shiprisk.sources import testdata as td
    spark.sql("select 'a' n_name, 0 n_nationkey union all select 'b', 1").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(3).selectExpr("id s_suppkey", "concat('s', id) s_name", "id % 2 s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(4).selectExpr("id c_custkey", "id % 2 c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(201).selectExpr("if(id = 200, 7, id) o_orderkey", "id % 5 o_custkey", "timestamp'1996-01-02 00:00:00' o_orderdate", "'2-HIGH' o_orderpriority") \
        .write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1000).selectExpr("if(id = 999, null, id % 250) l_orderkey", "cast(id % 4 as int) l_linenumber", "id l_partkey", "id % 3 l_suppkey", "1.0D l_quantity",
                                 "2.0D l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    # order 7 comes twice (customers 2 and 0); orders of customer 4 have no customer row
    want = sum((2 if i % 250 == 7 else 1) for i in range(999) if i % 250 < 200 and i % 250 % 5 != 4)
    width, small = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (small, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            df = td.build_shipments(spark, str(tmp_path))
            plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
            assert sum("Exchange hashpartitioning(l_orderkey" in ln for ln in plan) == 1
            assert not any("Exchange hashpartitioning(concat_ws" in ln for ln in plan)
            assert any("SortMergeJoin [l_orderkey" in ln for ln in plan)
            assert df.count() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    stored = td.shipments(spark, str(tmp_path))
    assert stored.count() == want and len(stored.inputFiles()) >= width and all(f.endswith(".zstd.parquet") for f in stored.inputFiles())
