"""Plan-shape guards: the properties that matter at scale, read from executed plans."""

from __future__ import annotations

from shiprisk.plans import catalog

catalog.load_all()


def _plan(spark, sf, name: str) -> str:
    df = catalog.QUERIES[name](spark, sf)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_enrichment_has_no_python_and_seven_size_checked_broadcasts(spark, sf):
    plan = _plan(spark, sf, "enrich_shipments")
    assert "EvalPython" not in plan and "PythonUDF" not in plan
    # every small lookup is broadcast by the planner's size check (no hints in the code)
    assert plan.count("BroadcastHashJoin") == 7
    assert "CartesianProduct" not in plan
    # the only non-equi join is the lane fixture itself: nation x nation pairs (bounded by countries)
    nlj = [ln for ln in plan.splitlines() if "BroadcastNestedLoopJoin" in ln]
    assert all("% 3" in ln for ln in nlj) and len(nlj) <= 1


def test_recent_log_read_prunes_partitions_and_pushes_time_filter(spark, sf):
    df = catalog.QUERIES["recent_predictions"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert "GreaterThanOrEqual(prediction_timestamp" in plan


def test_auc_has_no_single_partition_window_over_rows(spark, sf):
    plan = _plan(spark, sf, "roc_auc")
    # the only single-partition exchanges are over the bucket table and the final one-row sum
    lines = [ln for ln in plan.splitlines() if "SinglePartition" in ln]
    assert len(lines) <= 2
    assert "Window [sum(neg" in plan and "_bucket" in plan


def test_batch_paths_have_no_python_evaluation(spark, sf):
    for name in ("build_training_table", "validate_shipments", "weather_ingest", "route_geometry",
                 "stationary_alert", "country_risk_report", "lane_waypoints"):
        plan = _plan(spark, sf, name)
        assert "EvalPython" not in plan and "FlatMapGroupsInPandas" not in plan, name


def test_hot_vendor_is_split(spark):
    """With broadcasts off, AQE splits the partition of a vendor that holds most rows."""
    from pyspark.sql import functions as F

    from shiprisk.operators import enrich
    fact = spark.range(300_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 1000)).alias("vendor_name"),
                                       F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    vendors = spark.range(1000).select(F.concat(F.lit("v"), "id").alias("vendor_name"), F.lit(0.5).alias("on_time_rate"),
                                       F.lit(1.0).alias("avg_delay_days"), F.lit(3).alias("total_shipments"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        j = enrich.join_vendor(fact, vendors)
        j.collect()
        assert "skew=true" in j._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_prepared_dimensions_are_joined_bare_and_without_a_job(spark, sf):
    """With dimensions prepared, building an enrichment starts no job, and the plan holds no aggregate over a dimension."""
    import pytest

    from shiprisk.operators import enrich
    from shiprisk.plans.enrichment import _dims
    from shiprisk.sources import testdata as td
    requests, dims, sc = td.typed_shipments(spark, sf), _dims(spark, sf), spark.sparkContext
    sc.setJobGroup("building", "enrichment")
    try:
        j = enrich.enrich_shipments(requests, **dims)
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert len(sc.statusTracker().getJobIdsForGroup("building")) == 0
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert "Aggregate" not in plan and plan.count("HashJoin") == 7
    with pytest.raises(ValueError):
        enrich.enrich_shipments(requests, strict_case=True, **dims)


def test_prepared_dimensions_equal_unprepared_ones(spark, tmp_path):
    """Duplicate, differently written and null keys; the first load wins where loads are numbered."""
    from shiprisk.operators import enrich
    fact = spark.createDataFrame([("A&B", "france", "2024-01-01"), ("c", " PERU", None), (None, None, "2024-01-02")],
                                 "vendor_name string, origin_country string, planned_departure_date string")
    fact = fact.withColumn("planned_departure_date", fact.planned_departure_date.cast("date"))
    vendors = spark.createDataFrame([("A&B", 0.9, 1.0, 5), ("A&B", 0.1, 9.0, 7), (None, 0.2, 1.0, 1)],
                                    "vendor_name string, on_time_rate double, avg_delay_days double, total_shipments int")
    risk = spark.createDataFrame([("France", 4.0, 1, 0.1, 2.0), ("FRANCE ", 5.0, 1, 0.1, 2.0), ("peru", 2.0, 3, 0.4, 1.0)],
                                 "country_code string, lpi_score double, customs_tier int, geopolitical_risk double, port_congestion double")
    days = spark.createDataFrame([("France", "2024-01-01", "x", 1.0), ("FRANCE", "2024-01-01", "y", 1.0)],
                                 "country_code string, holiday_date string, holiday_name string, risk_weight double")
    p = enrich.prepare_dimensions(str(tmp_path), sanitize_vendor_key=True, vendors=vendors, risk=risk, holidays=days)

    def looked_up(v, r, h):
        x = enrich.join_vendor(fact, v, sanitize_dimension_key=True)
        x = enrich.join_country_risk(x, r, "origin_country", "origin")
        return sorted(map(str, enrich.holiday_flag(x, h).collect()))
    assert looked_up(p["vendors"], p["risk"], p["holidays"]) == looked_up(vendors, risk, days)
    again = enrich.reopen(spark, "risk", f"{tmp_path}/risk")
    assert again.rows.count() == 2
    loads = spark.createDataFrame([("X", "2024-01-01", 0.9, 1), ("X", "2024-01-01", 0.95, 0)],
                                  "origin_city string, departure_date string, weather_risk_score double, load_seq int")
    stored = enrich.prepare(loads, "weather", f"{tmp_path}/weather").rows
    assert [r.weather_risk_score for r in stored.collect()] == [0.95] and "load_seq" not in stored.columns
