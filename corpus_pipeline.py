"""The corpus pipeline: toxicity, SimHash near-duplicates, secrets, packing.

Each stage works on all rows its predecessor kept; ``run`` writes what it
returns as Parquet in the shared folder and reads it back for the next one.
Toxic documents go, one document of each near-duplicate group stays (the one
with the smallest id), secrets are replaced inside their documents, and what
remains is packed into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiprisk.llm import packing, secret_scan, simhash, toxicity
from shiprisk.llm.common import read, stage


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filter_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs).drop("ids")


STAGES = [("toxicity", toxicity_stage), ("simhash near-dedup", simhash_stage), ("secret scans", secrets_stage), ("best-fit packing", packing_stage)]

#: Classifiers, connected components and tokenizers are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
