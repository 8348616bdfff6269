"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tools/oracle_check.py [--sf DIR] [name ...]

Compares row count, column names and the multiset of row values (floats
exact, and again rounded to 9 significant digits). Our own feedback loop,
shaped like the driver's correctness gate.
"""

from __future__ import annotations

import argparse
import datetime as _dt
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from shiprisk.plans import catalog  # noqa: E402
from shiprisk.session import build_session  # noqa: E402
from shiprisk.sources.testdata import TABLES  # noqa: E402


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if digits is None:
            return v
        return float(f"{v:.{digits}g}")
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, _dt.date):
        return _dt.datetime(v.year, v.month, v.day).isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist(), digits)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    return v


_SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                  "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
                  "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def spark_type_as_duck(t: str) -> str:
    if t.startswith("array<") and t.endswith(">"):
        return spark_type_as_duck(t[6:-1]) + "[]"
    if t.startswith("struct<"):
        return "STRUCT"
    return _SPARK_TO_DUCK.get(t, t.upper())


def duck_type(t: str) -> str:
    t = str(t)
    if t.startswith("STRUCT"):
        return "STRUCT"
    return t.replace("TIMESTAMP WITH TIME ZONE", "TIMESTAMP")


def type_mismatches(sdf, rel) -> list:
    """(column, spark type, duckdb type) where the two schemas differ."""
    duck = {c: duck_type(t) for c, t in zip(rel.columns, rel.types)}
    out = []
    for f in sdf.schema.fields:
        st = spark_type_as_duck(f.dataType.simpleString())
        if f.name in duck and duck[f.name] != st:
            out.append((f.name, st, duck[f.name]))
    return out


def _rows(pdf, cols, digits):
    out = Counter()
    for rec in pdf[cols].itertuples(index=False, name=None):
        out[tuple(_norm(x, digits) for x in rec)] += 1
    return out


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--plain-session", action="store_true", help="a default SparkSession, as a driver may pass")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    catalog.load_all()
    names = a.names or sorted(catalog.QUERIES)
    if a.plain_session:
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        p = f"{a.sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = catalog.QUERIES[n](spark, a.sf)
            sp = sdf.toPandas()
            ts = time.time() - t0
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {n}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        sql = catalog.ORACLE.get(n)
        if sql is None:
            print(f"rows-only  {n}: spark rows={len(sp)} cols={list(sp.columns)} ({ts:.1f}s)")
            continue
        try:
            rel = con.sql(sql)
            mism = type_mismatches(sdf, rel)
            if mism:
                print(f"TYPES      {n}: {mism}")
            dp = rel.df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL   {n}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        sc, dc = sorted(sp.columns), sorted(dp.columns)
        if sc != dc:
            print(f"COLS       {n}: spark-only={sorted(set(sc)-set(dc))} sql-only={sorted(set(dc)-set(sc))}")
            bad += 1
            continue
        if len(sp) != len(dp):
            print(f"ROWCOUNT   {n}: spark={len(sp)} sql={len(dp)}")
            bad += 1
            continue
        exact = _rows(sp, sc, None) == _rows(dp, sc, None)
        close = exact or _rows(sp, sc, 9) == _rows(dp, sc, 9)
        status = "OK" if exact else ("OK~9" if close else "VALUES")
        if not close:
            bad += 1
            a_, b_ = _rows(sp, sc, 9), _rows(dp, sc, 9)
            diff1 = list((a_ - b_).items())[:3]
            diff2 = list((b_ - a_).items())[:3]
            print(f"  cols={sc}\n  spark-only={diff1}\n  sql-only={diff2}")
        print(f"{status:10s} {n}: rows={len(sp)} ({ts:.1f}s)")
    spark.stop()
    print(f"done: {len(names)} checked, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
