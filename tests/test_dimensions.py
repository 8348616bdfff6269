"""Checked dimension loads: faults, modes, file order, commit."""

from __future__ import annotations

import os
import tempfile

import pytest

from shiprisk.sources import dimensions as DL


def _csv(*lines: str) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="shiprisk-dim-"), "table.csv")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def _root() -> str:
    return tempfile.mkdtemp(prefix="shiprisk-dim-root-")


RISK = ("Country,lpi,tier,geo,port", "FRANCE,3.5,2,0.2,1.5", "CHINA,bad,2,0.2,1.5", ",3.0,2,0.2,1.5", "PERU,9.0,7,0.2,1.5",
        "FRANCE,4.5,1,0.1,0.5", "KENYA,2.0,3,,1.0", "CHINA,3.0,4,1.0,0.0")


def test_strict_rejects_the_whole_table_and_quarantine_keeps_its_good_rows(spark):
    root = _root()
    clean = _csv("name,rate,days,n", "V1,0.5,1.0,3", "V2,True,0.0,1")
    files = {"country_risk": _csv(*RISK), "vendor_stats": clean, "trade_lanes": "/nonexistent/lanes.csv"}
    strict = {r.table_name: r for r in DL.load_dimensions(spark, files, root).collect()}
    got = strict["country_risk"]
    assert (got.row_count, got.bad_text, got.null_values, got.rule_violations, got.bad_rows) == (7, 1, 2, 1, 4)
    assert not got.committed and DL.read_dimension(spark, root, "country_risk").count() == 0
    assert strict["vendor_stats"].committed and not strict["trade_lanes"].committed
    assert sorted(map(tuple, DL.read_dimension(spark, root, "vendor_stats").collect())) == [("V1", 0.5, 1.0, 3), ("V2", 1.0, 0.0, 1)]
    got = DL.load_dimensions(spark, files, root, "quarantine").first()
    assert (got.committed, got.stored_rows, got.duplicate_rows, got.bad_rows) == (True, 2, 1, 4)
    stored = DL.read_dimension(spark, root, "country_risk")
    assert sorted(map(tuple, stored.collect())) == [("CHINA", 3.0, 4, 1.0, 0.0), ("FRANCE", 3.5, 2, 0.2, 1.5)]
    aside = spark.read.parquet(f"{root}/_quarantine/country_risk/load=00000001")
    assert sorted(tuple(r.faults) for r in aside.collect()) == [
        ("null:country_code",), ("null:geopolitical_risk",), ("rule:0", "rule:1"), ("text:lpi_score",)]
    DL.load_dimensions(spark, files, root)  # rejected again: what was stored stays
    assert DL.read_dimension(spark, root, "country_risk").count() == 2
    with pytest.raises(ValueError):
        DL.load_dimensions(spark, files, root, "other")


def test_the_first_row_in_file_order_wins_over_many_splits(spark):
    path = _csv("a,b,c,d", *[f"V{i % 700},{(i % 1000) / 1000},1.0,{i}" for i in range(30_000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = DL.read_checked(spark, "vendor_stats", path)
        assert rows.select("_start").distinct().count() > 5
        root = _root()
        got = DL.load_dimensions(spark, {"vendor_stats": path}, root).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (got.row_count, got.stored_rows, got.duplicate_rows) == (30_000, 700, 29_300)
    assert {(r.vendor_name, r.total_shipments) for r in DL.read_dimension(spark, root, "vendor_stats").collect()} == {(f"V{i}", i) for i in range(700)}


def test_a_load_that_dies_before_its_manifest_is_not_seen_and_is_replaced(spark, monkeypatch):
    root, first, second = _root(), _csv("a,b,c,d", "V1,0.1,1.0,1"), _csv("a,b,c,d", "V1,0.2,1.0,2", "V2,0.3,1.0,3")
    DL.load_dimensions(spark, {"vendor_stats": first}, root)
    with monkeypatch.context() as m:
        m.setattr(DL, "MANIFEST", "broken")
        with pytest.raises(Exception):
            DL.load_dimension_checked(spark, "vendor_stats", second, root)
    assert [r.total_shipments for r in DL.read_dimension(spark, root, "vendor_stats").collect()] == [1]
    spark.range(5).write.mode("overwrite").parquet(f"{root}/vendor_stats/load=00000002")  # what an attempt may leave
    assert DL.load_dimension_checked(spark, "vendor_stats", second, root)["committed"]
    assert sorted(r.total_shipments for r in DL.read_dimension(spark, root, "vendor_stats").collect()) == [2, 3]


def test_empty_and_narrow_files(spark):
    root = _root()
    got = DL.load_dimension_checked(spark, "vendor_stats", _csv("a,b,c,d"), root)
    assert got["committed"] and got["row_count"] == 0 and DL.read_dimension(spark, root, "vendor_stats").count() == 0
    got = DL.load_dimension_checked(spark, "vendor_stats", _csv("a,b", "V1,0.5"), root)
    assert not got["committed"] and got["null_values"] == 1
