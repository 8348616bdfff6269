"""What several operators share: staged tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiprisk.session import ensure_checkpoint_dir


def ship(spark: SparkSession) -> None:
    """Give the Python workers of this application the package, once, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_shiprisk_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="shiprisk-")) / "shiprisk.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(package.rglob("*.py")):
            out.write(p, p.relative_to(package.parent))
    context.addPyFile(str(target))
    context._shiprisk_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    It cuts the lineage, and survives the loss of any executor.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 512):
    """Arrow batches cut into at most ``rows`` rows, which bounds the Python objects that live at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected links (a, b), both bigint.

    ``component`` is the smallest node that can be reached. Links to itself
    and null ends give no row, so nodes without a link are absent. The
    method alternates large stars (each neighbour above a node is linked to
    the smallest neighbour) and small stars (a node and its lower neighbours
    are linked to the smallest), until the links no longer change. Smallest
    neighbours are combined before the shuffle and staged, so both sides of
    each join are bare shuffles whose hot nodes Spark can split.
    """
    spark = edges.sparkSession
    tight = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), "links")
    before = None
    while True:
        both = tight.union(tight.select("b", "a"))
        low = stage(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m")), "low")
        large = stage(both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .distinct(), "large")
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        tight = stage(large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
                      .select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct(), "small")
        now = _summary(tight)
        if now == before:
            return tight.select(F.col("a").alias("node"), F.col("b").alias("component")) \
                .union(tight.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
