"""File sources (S1-S3, S6, S9): CSV/JSON readers with explicit schemas."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as SC
from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/shiprisk-io/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` resolves to at least one file or folder."""
    try:
        spark.read.format("text").load(path)
        return True
    except AnalysisException:
        return False


# S1 ---------------------------------------------------------------------
def scan_shipments_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Raw order CSV (latin1, header): every column as text, only the needed ones.

    The header names are mapped to our column names; columns absent from
    the file (the two country columns may be) are simply not returned.
    """
    header = spark.read.option("header", True).option("encoding", encoding).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    df = (spark.read.schema(schema).option("header", True).option("encoding", encoding)
          .option("mode", "PERMISSIVE").csv(path))
    wanted = [F.col(f"`{src}`").alias(dst) for dst, src in SC.RAW_ORDER_COLUMNS.items() if src in header]
    extra = [F.col(c) for c in header if c == "shipment_id"]
    return df.select(*extra, *wanted)


# S2 / S3 ----------------------------------------------------------------
def load_dimension(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Read a dimension CSV and assign the table schema *by position*.

    Header names in the file are ignored (a file column 'is_major' with
    'True' lands in 'risk_weight' as 1.0). Values are cast with try_cast, a
    boolean text going through boolean to double. A missing file gives
    an empty table of the right type, so downstream defaults apply (S3).
    """
    schema = SC.DIMENSIONS[name][0]
    if not path_exists(spark, path):
        return missing_source_default(spark, name)
    raw = spark.read.option("header", True).csv(path)
    cols = raw.columns[: len(schema.fields)]
    out = []
    for c, f in zip(cols, schema.fields):
        src = F.col(f"`{c}`")
        if isinstance(f.dataType, T.DoubleType):
            val = F.coalesce(src.try_cast("double"), src.try_cast("boolean").cast("double"))
        else:
            val = src.try_cast(f.dataType)
        out.append(val.alias(f.name))
    return raw.select(*out)


def missing_source_default(spark: SparkSession, name: str) -> DataFrame:
    """An empty, typed dimension table."""
    return spark.createDataFrame([], SC.DIMENSIONS[name][0])


# S6 ---------------------------------------------------------------------
def idempotent_seed(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Write ``df`` as parquet at ``path`` only if nothing non-empty is there yet.

    Returns True when it wrote. The emptiness probe reads at most one row.
    """
    if path_exists(spark, path) and not spark.read.parquet(path).isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


# S9 ---------------------------------------------------------------------
GEOCODE_SCHEMA = T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))


def geocode_cache_to_table(cache_text: DataFrame, col: str = "value") -> DataFrame:
    """JSON cache text rows ``{"city|country": [lat, lon] | null, ...}`` -> lookup rows."""
    m = F.from_json(F.col(col), GEOCODE_SCHEMA)
    kv = cache_text.select(F.explode(m).alias("key", "coords"))
    return kv.select(
        F.split("key", r"\|").getItem(0).alias("city"),
        F.split("key", r"\|").getItem(1).alias("country"),
        F.col("coords").getItem(0).alias("lat"),
        F.col("coords").getItem(1).alias("lon"))


def geocode_table_to_cache(table: DataFrame) -> DataFrame:
    """Lookup rows -> JSON cache text, one ``{"city|country": [lat, lon] | null}``
    object per line.

    No grouping: every row becomes its own line, so no task ever holds more
    than its input split; the reader explodes any number of objects, and
    also reads a single-object file as written by a one-process tool.
    """
    coords = F.when(F.col("lat").isNull(), F.lit(None).cast("array<double>")).otherwise(F.array("lat", "lon"))
    entry = F.map_from_arrays(F.array(F.concat_ws("|", "city", "country")), F.array(coords))
    return table.select(F.to_json(entry).alias("value"))
