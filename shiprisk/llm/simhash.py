"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprint: A-Z lower-cased, words between ASCII white space, shingles of
three words joined by a space (a shorter text is one shingle, a text without
words has fingerprint zero). Each of 64 bits is set if it is set in over half
of the shingles' XXH64 values (seed 42).

Distinct fingerprints are embedded as the vector of bit counts of their
segments. Two fingerprints that differ in d bits have vectors whose Manhattan
distance is at most d, so a range join of the vectors finds every pair.
Vectors at distance 2 or less have a common grid point at distance 1 or less
from both, so each vector is dealt to its own point and to the points one step
away, and only vectors that meet at a point are compared, exactly. For a
limit of 2r bits the steps are r. Links of equal texts need no
comparison: a fingerprint stands for all its documents.

Nulls and edge cases: null and empty texts, and texts of white space, have
fingerprint zero and link like any other. Rows with a null id are kept, in
the component of their fingerprint; a component without any id has a null
component_id. Very long texts are hashed whole. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, read, ship, slices, stage

BITS = 64
SEGMENTS = 16
SHINGLE = 3
MAX_BITS = 2
SEED = 42
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of a text in UTF-8."""
    import xxhash

    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    data = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(data, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    digest, n = xxhash.xxh64_digest, len(starts)
    set_bits = np.zeros(BITS, np.int64)
    for lo in range(0, n, HASHES_AT_ONCE):
        hashes = b"".join([digest(data[s:e], SEED) for s, e in zip(starts[lo:lo + HASHES_AT_ONCE], ends[lo:lo + HASHES_AT_ONCE])])
        set_bits += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed bigint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(t or b"", shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """(a, b), a < b, of distinct fingerprints ``fps`` (fp) that differ in at most ``max_bits`` bits."""
    width = BITS // segments
    steps = (max_bits + 1) // 2
    size = width.bit_length()  # bits that hold a count from 0 to width
    words = -(-segments * size // 60)
    per_word = -(-segments // words)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                fp = batch.column("fp").slice(lo, 8192).to_numpy(zero_copy_only=False)
                counts = np.unpackbits(fp.view(np.uint64).byteswap().view(np.uint8).reshape(-1, 8), axis=1) \
                    .reshape(len(fp), segments, width).sum(2).astype(np.int64)
                owner, points = np.arange(len(fp)), counts
                reached = [(owner, points)]
                for _ in range(steps):
                    next_owner, next_points = [], []
                    for k in range(segments):
                        for step in (-1, 1):
                            ok = (points[:, k] + step >= 0) & (points[:, k] + step <= width)
                            moved = points[ok].copy()
                            moved[:, k] += step
                            next_owner.append(owner[ok])
                            next_points.append(moved)
                    owner, points = np.concatenate(next_owner), np.concatenate(next_points)
                    reached.append((owner, points))
                owner, points = (np.concatenate(x) for x in zip(*reached))
                keys = [np.zeros(len(owner), np.int64) for _ in range(words)]
                for k in range(segments):
                    keys[k // per_word] |= points[:, k] << (size * (k % per_word))
                rows = np.stack([owner, *keys], 1)
                if steps > 1:  # a point may be reached in several ways
                    rows = np.unique(rows, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(1, words + 1)] + [pa.array(fp[rows[:, 0]])],
                                                 names=[*names, "fp"])

    names = [f"k{i}" for i in range(words)]
    dealt = fps.mapInArrow(deal, ", ".join(f"{n} long" for n in [*names, "fp"]))
    left = dealt.withColumnRenamed("fp", "a").alias("x")
    right = dealt.withColumnRenamed("fp", "b").alias("y")
    same = [F.col(f"x.{n}") == F.col(f"y.{n}") for n in names]
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    on = (F.col("a") < F.col("b")) & near
    for s in same:
        on = on & s
    # The planner sees the size of ``fps``, not that of its many grid points, and would broadcast them: merged at any size
    return left.join(right.hint("merge"), on).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, segments: int = SEGMENTS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row for each document."""
    found = stage(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = stage(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    component = connected_components(links(distinct.select("fp"), max_bits, segments))
    joined = component.join(distinct, F.col("node") == F.col("fp")).select("fp", "component", "first_id")
    linked = joined.join(joined.groupBy("component").agg(F.min("first_id").alias("component_id")), "component") \
        .select(F.col("fp").alias("f"), "component_id")
    known = stage(distinct.join(linked, F.col("fp") == F.col("f"), "left")
                  .select(F.col("fp").alias("f"), F.when(F.col("f").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")),
                  "components")
    return found.join(known, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, segments: int = SEGMENTS,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest (id, fingerprint), null ids last.

    Rows are told apart by id and fingerprint, so rows that share an id but
    not a text are judged each for itself; of rows equal in both, one stays.
    """
    found = stage(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = stage(found.select("fp").distinct(), "distinct")
    component = connected_components(links(distinct, max_bits, segments))
    classes = stage(distinct.join(component, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("component", "fp").alias("component")),
                    "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp"))
    best = found.join(classes, F.col("fp") == F.col("f")).groupBy("component").agg(first.alias("b"))
    best = stage(best.select(F.col("b.doc_id").alias("best_id"), F.col("b.fp").alias("best_fp")), "best")
    many = stage(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("many_id")), "many")
    own = F.col(f"`{id_col}`").cast("long")
    # An id that occurs once decides by itself; rows with other ids are fingerprinted again
    once = docs.join(many, own == F.col("many_id"), "left_anti").join(best.where("best_id is not null"), own == F.col("best_id"), "left_semi")
    if found.where("doc_id is null").isEmpty() and many.isEmpty():
        return once.select(docs.columns)
    unsure = docs.where(own.isNull()).union(docs.join(many, own == F.col("many_id"), "left_semi").select(docs.columns))

    @F.arrow_udf("long")
    def again(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t or b"", shingle) for t in texts.to_pylist()], np.uint64).view(np.int64))

    mark = "_fp"
    while mark in docs.columns:
        mark += "_"
    marked = unsure.withColumn(mark, again(F.col(f"`{text_col}`").cast("binary")))
    kept = marked.join(best, own.eqNullSafe(F.col("best_id")) & (F.col(mark) == F.col("best_fp")), "left_semi").dropDuplicates([id_col, mark])
    return once.select(docs.columns).union(kept.select(docs.columns))
