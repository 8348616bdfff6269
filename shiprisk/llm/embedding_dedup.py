"""Near-duplicates of embeddings by an exact metric range join.

On unit vectors cosine c is Euclidean distance sqrt(2 - 2c). Within each
label, vectors that are equal are one class; classes belong to the nearest of
a few pivots, and a class is also sent to another pivot's cell if its distance
there exceeds its own by at most twice the search radius: by the triangle
inequality a partner whose home is that cell can be no farther. Cells join
independently. A cell's home rows are split into blocks of bounded size, the
visitors of the cell stream past each block in batches, and cosines are
verified in double precision. A block counts each home row's links and keeps
only a spanning forest of them, so a group of many near copies never becomes
all its pairs. Labels of at most one block need no pivots.

Nulls and edge cases: vectors that are null, empty or zero, that hold null or
non-finite components, and rows with a null label link with nothing. Vectors
of different dimension do not link. Repeated rows are rows of their own that
link with each other, and so are rows that share a vec_id. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, read, ship, stage

COSINE = 0.93
#: Home rows of a block, and rows of a visiting batch.
BLOCK = 2048
#: At most so many pivots, chosen from at most so many vectors.
PIVOTS = 16
SAMPLE = 4096


def usable(vector: str):
    """True if a vector has only finite components, and one that is not zero."""
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) \
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))) & F.exists(v, lambda x: x != 0)


def choose_pivots(vectors: DataFrame, k: int) -> np.ndarray:
    """Farthest-first unit pivots of one dimension, from a sample of at most ``SAMPLE`` vectors by hash."""
    rows = vectors.select("dim", "vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(r["dim"], []).append(r["vector"])
    if not by_dim:
        return np.zeros((0, 0))
    v = np.array(max(by_dim.values(), key=len), float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    chosen = [0]
    nearest = v @ v[0]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, v @ v[chosen[-1]])
    return v[chosen]


class Block:
    """The home rows of one block: counts of links, and a forest over rows and visitors."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray, cosine: float):
        self.ids, self.vectors, self.cosine = ids, vectors, cosine
        self.root = np.arange(len(ids))
        self.links = weights - 1  # copies of the class itself

    def visit(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> list[np.ndarray]:
        """Links of the visitors that are not in the block's own forest, as (visitor, home row)."""
        hit = self.vectors @ vectors.T >= self.cosine
        hit &= self.ids[:, None] != ids[None, :]
        self.links += hit @ weights
        rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if not len(rows):
            return []
        hit = hit[np.ix_(rows, cols)]
        while True:  # rows that share a visitor get one root
            roots = self.root[rows]
            low = np.where(hit, roots[:, None], len(self.ids)).min(0)
            new = np.where(hit, low[None, :], len(self.ids)).min(1)
            if (new == roots).all():
                break
            to = np.arange(len(self.ids))
            np.minimum.at(to, roots, new)
            while (to[to] != to).any():
                to = to[to]
            self.root = to[self.root]
        return [np.stack([ids[cols], self.ids[rows[hit.argmax(0)]]], 1)]

    def forest(self) -> np.ndarray:
        return np.stack([self.ids, self.ids[self.root]], 1)


def _join_cells(cosine: float):
    """Streams rows sorted by (cell, block, role): home rows first, then visitors."""
    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        flat = batch.column("vector")
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, home, block = None, [], None

        def build() -> Block:
            ids, weights, vectors = (np.concatenate(x) for x in zip(*home))
            return Block(ids, weights, vectors, cosine)

        def close() -> Iterator[pa.RecordBatch]:
            if home:
                done = block or build()
                yield out(0, done.ids, done.links)
                forest = done.forest()
                forest = forest[forest[:, 0] != forest[:, 1]]
                if len(forest):
                    yield out(1, forest[:, 0], forest[:, 1])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, nth, role = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "role"))
            edges = np.flatnonzero((cell[1:] != cell[:-1]) | (nth[1:] != nth[:-1]) | (role[1:] != role[:-1])) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(cell)]):
                if (cell[s], nth[s]) != current:
                    yield from close()
                    current, home, block = (cell[s], nth[s]), [], None
                for lo in range(s, e, BLOCK):
                    part = batch.slice(lo, min(BLOCK, e - lo))
                    rows = (part.column("id").to_numpy(), part.column("weight").to_numpy(), matrix(part))
                    if role[s] == 0:
                        home.append(rows)
                    else:
                        block = block or build()
                        for found in block.visit(*rows):
                            yield out(1, np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1]))
        yield from close()

    return run


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by their largest component first, so that no square overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def _deal(centres: np.ndarray, radius: float):
    """Unit vectors with their home pivot and the pivots whose cells they visit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                dim, large = (some.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "large"))
                home, cells, units = np.zeros(len(dim), np.int32), [np.zeros(1, np.int32)] * len(dim), [None] * len(dim)
                for k in np.unique(dim):
                    of = np.flatnonzero(dim == k)
                    v = unit(some.take(pa.array(of)).column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(of), -1))
                    for i, x in zip(of.tolist(), v):
                        units[i] = x
                    if k == centres.shape[1]:
                        v, of = v[large[of]], of[large[of]]
                        d = np.sqrt(np.maximum(0, 2 - 2 * v @ centres.T))
                        near = d <= d.min(1, initial=3)[:, None] + 2 * radius
                        home[of] = d.argmin(1)
                        for i, n in zip(of.tolist(), near):
                            cells[i] = np.flatnonzero(n).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in ("label", "dim", "id", "weight")), pa.array(units, pa.list_(pa.float64())),
                     pa.array(home), pa.array(cells, pa.list_(pa.int32()))],
                    names=["label", "dim", "id", "weight", "vector", "home", "cells"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each input row."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
                          F.col(label_col).cast("string").alias("label"))
    takes_part = F.coalesce(usable("vector"), F.lit(False)) & F.col("label").isNotNull()
    classes = rows.where(takes_part).groupBy("label", "vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least")) \
        .withColumn("dim", F.size("vector")).withColumn("id", F.monotonically_increasing_id())
    classes = stage(classes, "classes")
    large = stage(classes.groupBy("label", "dim").count().where(F.col("count") > block).select("label", "dim", F.lit(True).alias("large")), "large")
    centres = choose_pivots(classes, pivots)
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    placed = classes.join(large, ["label", "dim"], "left") \
        .select("label", "dim", "id", "weight", "vector", F.coalesce("large", F.lit(False)).alias("large")) \
        .mapInArrow(_deal(centres, radius), "label string, dim int, id long, weight long, vector array<double>, home int, cells array<int>")
    placed = stage(placed, "placed")
    key = ["label", "dim", "home"]
    cells = stage(placed.groupBy(*key).count().select(*key, F.ceil(F.col("count") / block).cast("int").alias("blocks"),
                                                      F.monotonically_increasing_id().alias("cell")), "cells")
    at_home = placed.join(cells, key).select("cell", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(0).alias("role"),
                                             "id", "weight", "vector")
    visiting = placed.select("label", "dim", F.explode("cells").alias("home"), "id", "weight", "vector").join(cells, key) \
        .select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "id", "weight", "vector")
    joined = stage(at_home.union(visiting).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "block")
                   .sortWithinPartitions("cell", "block", "role")
                   .mapInArrow(_join_cells(cosine), "kind int, a long, b long"), "joined")
    counts = joined.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("n_links"))
    component = connected_components(joined.where("kind = 1").select("a", "b"))
    members = classes.join(counts, "id").join(component, F.col("id") == F.col("node"), "left") \
        .select("label", "vector", "n_links", "least", F.coalesce("component", "id").alias("component"))
    members = stage(members, "members")
    smallest = stage(members.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    known = stage(members.join(smallest, "component").select("label", "vector", "n_links", "component_id"), "known")
    linked = rows.where(takes_part).join(known, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
