"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length: range-sorted by norm, from the longest,
into buckets of about ``BUCKET`` rows. Each query first scores a fixed number
of the longest candidates, whose k-th best product is a threshold that no
final result can be below. A bucket whose longest vector cannot reach it is
never visited. In a bucket the threshold over the norms of the query and of
the bucket's longest vector is a local cosine threshold, which chooses the
pruning: a high one bounds each of the query's strongest coordinates of the
normalised candidates to an interval (coordinate pruning), a low one only
bounds the candidates' length, so that the longest remain (length pruning).
Products of what is left are verified exactly, and a query's best of each
bucket are ranked together.

Components are whole numbers held as doubles, so products are exact below
2**53.

Nulls and edge cases: vectors that are null or empty, or hold null or
non-finite components, take no part, nor do rows with a null id. A zero
vector is a vector. Vectors of another dimension than the query's are no
candidates. The query's own row is every row of its id. Repeated rows are
candidates of their own; repeated queries are one query. Ties go to smaller
ids. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, ship, stage

K = 20
BUCKET = 4096
#: Longest candidates that give the first thresholds.
SEEDS = 1024
#: Local cosine thresholds from here on use coordinate pruning, on so many coordinates.
COORDINATE_FROM = 0.6
COORDINATES = 4
SLACK = 1e-9


def finite(vector: str) -> Column:
    v = F.col(vector)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))), F.lit(False))


def _vectors(batch: pa.RecordBatch, dim: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (rows, matrix)."""
    out = {}
    for d in np.unique(dim):
        of = np.flatnonzero(dim == d)
        flat = batch.column("v").take(pa.array(of)).flatten().to_numpy(zero_copy_only=False)
        out[int(d)] = of, flat.reshape(len(of), int(d))
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.lexsort((ids[places], -scores[places]))][:k]


class Bucket:
    """Candidates of one dimension, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norms = np.sqrt((vectors * vectors).sum(1))
        order = np.argsort(-norms, kind="stable")
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        self.directions = self.vectors / np.where(self.norms > 0, self.norms, 1)[:, None]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, ids, scores) of up to k candidates of each query that reach ``least``."""
        norms = np.sqrt((queries * queries).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(least > 0, least / (norms * self.norms[0]), -np.inf)  # the local cosine threshold
            shortest = np.where(least > 0, least / norms, 0)  # a zero query with a positive threshold gives infinity
        reach = np.searchsorted(-self.norms, -shortest * (1 - SLACK), side="right")
        by_length = np.flatnonzero((local < COORDINATE_FROM) & (reach > 0))
        for lo in range(0, len(by_length), 256):
            some = by_length[lo:lo + 256]
            products = queries[some] @ self.vectors[:reach[some].max()].T
            for i, row in zip(some.tolist(), products):
                yield from self._verified(i, query_ids[i], np.flatnonzero(row[:reach[i]] >= least[i]), row, least[i], k)
        for i in np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1 + SLACK) & (reach > 0)).tolist():
            t, q = min(1.0, local[i] * (1 - SLACK)), queries[i] / norms[i]
            left = np.arange(reach[i])
            for f in np.argsort(-np.abs(q))[:COORDINATES]:
                spread = math.sqrt(max(0.0, (1 - t * t) * (1 - q[f] * q[f]))) + SLACK
                x = self.directions[left, f]
                # |x - q t'| <= spread' for the cosine t' >= t of the pair; beyond q the interval ends at the cap's pole
                low = -1.0 if -q[f] > t else q[f] * t - spread
                high = 1.0 if q[f] > t else q[f] * t + spread
                left = left[(x >= low) & (x <= high)]
            row = np.full(len(self.ids), -np.inf)
            row[left] = self.vectors[left] @ queries[i]
            yield from self._verified(i, query_ids[i], left[row[left] >= least[i]], row, least[i], k)

    def _verified(self, i: int, query: int, left: np.ndarray, row: np.ndarray, least: float, k: int):
        left = left[self.ids[left] != query]
        if len(left):
            left = left[best(row[left], self.ids[left], k)]
            yield i, self.ids[left], row[left]


def _thresholds(seeds: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Adds ``least``: the k-th best product with the seeds, or minus infinity if there are fewer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                ids, dim = (some.column(c).to_numpy(zero_copy_only=False) for c in ("id", "dim"))
                least = np.full(len(ids), -np.inf)
                for d, (of, v) in _vectors(some, dim).items():
                    if d in seeds and len(seeds[d][0]) > k:
                        scores = v @ seeds[d][1].T
                        scores[ids[of][:, None] == seeds[d][0][None, :]] = -np.inf
                        least[of] = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(least)], names=[*some.schema.names, "least"])

    return run


def _search(k: int):
    """Streams rows sorted by (bucket, role): candidates first, then queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, buckets = None, {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            number, role, ids, dim, least = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "role", "id", "dim", "least"))
            edges = np.flatnonzero((number[1:] != number[:-1]) | (role[1:] != role[:-1])) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(number)]):
                if number[s] != current:
                    current, parts, buckets = number[s], {}, {}
                for lo in range(s, e, 2048):
                    hi = min(e, lo + 2048)
                    found = []
                    for d, (of, v) in _vectors(batch.slice(lo, hi - lo), dim[lo:hi]).items():
                        if role[s] == 0:
                            parts.setdefault(d, []).append((ids[lo:hi][of], v))
                            continue
                        if d in parts and d not in buckets:
                            buckets[d] = Bucket(*(np.concatenate(x) for x in zip(*parts[d])))
                        if d in buckets:
                            query_ids = ids[lo:hi][of]
                            for i, other, scores in buckets[d].search(query_ids, v, least[lo:hi][of], k):
                                found.append((np.full(len(other), query_ids[i]), other, scores.astype(np.int64)))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, bucket: int = BUCKET, id_col: str = "id", vector_col: str = "v") -> DataFrame:
    """(query_id, rank, vec_id, score) of whole-number vectors (array<double>); ``is_query`` is over the columns id and v."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")) \
        .where(finite("v") & F.col("id").isNotNull()).withColumn("dim", F.size("v"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    rows = stage(rows, "vectors")
    n = max(1, -(-rows.count() // bucket))
    bucketed = stage(rows.repartitionByRange(n, F.desc("norm"), F.xxhash64("id")).withColumn("bucket", F.spark_partition_id()), "buckets")
    # One number for each bucket goes to the driver: rows / bucket doubles.
    longest = {b: m for b, m in bucketed.groupBy("bucket").agg(F.max("norm")).collect()}
    numbers = sorted(longest, key=longest.get, reverse=True)
    lengths = np.array([longest[b] for b in numbers])
    seeds: dict[int, tuple[list, list]] = {}
    for r in rows.orderBy(F.desc("norm"), "id").select("id", "dim", "v").limit(SEEDS).collect():
        ids, vs = seeds.setdefault(r["dim"], ([], []))
        ids.append(r["id"])
        vs.append(r["v"])
    seeds = {d: (np.array(ids), np.array(vs)) for d, (ids, vs) in seeds.items()}

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm, least = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("norm", "least"))
            last = [np.searchsorted(-lengths, -t / q * (1 - SLACK), side="right") if t > 0 and q > 0 else 0 if t > 0 else len(lengths)
                    for q, t in zip(norm, least)]
            to = [numbers[:j] for j in last]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "dim", "v", "least")), pa.array(to, pa.list_(pa.int32()))],
                                             names=["id", "dim", "v", "least", "to"])

    queries = rows.where(is_query).dropDuplicates(["id"]).select("id", "dim", "v", "norm") \
        .mapInArrow(_thresholds(seeds, k), "id long, dim int, v array<double>, norm double, least double") \
        .mapInArrow(visits, "id long, dim int, v array<double>, least double, to array<int>")
    sent = queries.select(F.explode("to").alias("bucket"), F.lit(1).alias("role"), "id", "dim", "v", "least")
    candidates = bucketed.select("bucket", F.lit(0).alias("role"), "id", "dim", "v", F.lit(0.0).alias("least"))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = candidates.union(sent).repartition(max(n, shuffles), "bucket").sortWithinPartitions("bucket", "role") \
        .mapInArrow(_search(k), "query_id long, vec_id long, score long")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x).alias("e"))
    rows = rows.where(finite("e")).select("id", F.transform("e", lambda x: F.floor(x * 64).cast("double")).alias("v"))
    return top_k(rows, F.col("id") % 20 == 0)
