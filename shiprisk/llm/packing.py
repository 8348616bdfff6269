"""Best-fit packing of token sequences, bulk-synchronously.

Texts become ids plus an end id; those longer than the capacity are cut into
pieces of that length (the first piece takes the rest), and the pieces are
packed into as few sequences as possible.

Pieces and open sequences are range-sorted by size. Both tables are kept as
runs: all pieces of one length are one run of ranks, and sequences numbered
one after the other with equal gaps are one run, so hot lengths cost no more
than rare ones and the tables are bounded by the capacity, not the corpus.
A superstep has two parts. First every size range, in a task of its own,
sweeps its runs from small to large and gives each gap the largest piece
that fits and is not yet taken: the successor match seen from the piece.
Then what the ranges left is matched across them by the same sweep, repeated
as long as gaps change. Pieces that want the same gaps are served by rank:
the first ranks of a run go to the first sequences of the gap run, the rest
to the next larger gap. Gaps are updated, new sequences are opened for half
of the remaining tokens where nothing fits, and the step repeats.
At the end each piece looks its rank up in the matched runs.

Nulls and edge cases: a null text is empty; an empty text is one piece that
holds the end id. Repeated rows and rows with equal or null doc_id are packed
as rows of their own. An empty table gives an empty result. Other columns
are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, stage
from .tokens import default_vocabulary, encoder

CAPACITY = 2048
END_ID = 0
RANGES = 8
#: Sweeps across all ranges between two synchronisations.
SWEEPS = 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part long, nth long"
#: kind: see below; size: piece length or gap; lo, n: ranks or sequence numbers; a match also has the first
#: sequence, the pieces that each sequence takes, and where in the sequences they begin.
RUNS = "kind int, size long, lo long, n long, seq long, per long, begin long"
PIECE, GAP, MATCH, NEXT = range(4)


def tokenise(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None,
             keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece; ``nth`` counts the pieces of that length before it in the partition ``part``."""
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                rows = []
                for doc, ids in zip(some.column("doc_id").to_pylist(), encoder(vocabulary).encode_many(some.column("text").to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    for k in range((n - first) // capacity + 1):
                        start, length = (first + (k - 1) * capacity, capacity) if k else (0, first)
                        data = ids[4 * start:4 * (start + length)]
                        rows.append((doc, k, start, length, zlib.crc32(data), data if keep_ids else None, part, seen[length]))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(),
                                                                 pa.binary(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .mapInArrow(cut, PIECES)


def sweep(pieces: dict[int, list[int]], gaps: list[tuple[int, int, int]], capacity: int) -> tuple[list, list]:
    """One successor sweep from small to large sizes.

    ``pieces``: length -> [first rank, count], changed in place; ``gaps``:
    (gap, first sequence, count). Returns the new gaps and the matches
    (length, first rank, pieces, first sequence, pieces a sequence, begin).
    """
    waiting, lengths, left, matches = [], sorted(pieces), [], []
    k = 0
    for gap, seq, n in sorted(gaps):
        while k < len(lengths) and lengths[k] <= gap:
            waiting.append(lengths[k])
            k += 1
        while n and waiting:
            size = waiting[-1]
            rank, count = pieces[size]
            per = min(gap // size, count)
            taken = min(n, count // per)
            matches.append((size, rank, taken * per, seq, per, capacity - gap))
            if gap > per * size:
                left.append((gap - per * size, seq, taken))
            n, seq = n - taken, seq + taken
            if count == taken * per:
                waiting.pop()
                del pieces[size]
            else:
                pieces[size] = [rank + taken * per, count - taken * per]
        if n:
            left.append((gap, seq, n))
    return left, matches


def open_sequences(pieces: dict[int, list[int]], seq: int, capacity: int) -> tuple[list, list, int]:
    """New sequences for the longest pieces: all above half the capacity, or enough for half of all tokens."""
    need = sum(n for size, (_, n) in pieces.items() if 2 * size > capacity) \
        or max(1, -(-sum(size * n for size, (_, n) in pieces.items()) // (2 * capacity)))
    gaps, matches = [], []
    for size in sorted(pieces, reverse=True):
        rank, count = pieces[size]
        taken = min(need, count)
        matches.append((size, rank, taken, seq, 1, 0))
        if size < capacity:
            gaps.append((capacity - size, seq, taken))
        need, seq = need - taken, seq + taken
        if taken == count:
            del pieces[size]
        else:
            pieces[size] = [rank + taken, count - taken]
        if not need:
            break
    return gaps, matches, seq


def _load(runs: pd.DataFrame) -> tuple[dict, list, list, int]:
    of = {k: runs[runs.kind == k] for k in range(4)}
    return ({int(r.size_): [int(r.lo), int(r.n)] for r in of[PIECE].rename(columns={"size": "size_"}).itertuples()},
            [(int(s), int(lo), int(n)) for s, lo, n in zip(of[GAP]["size"], of[GAP].lo, of[GAP].n)],
            [tuple(map(int, x)) for x in of[MATCH][["size", "lo", "n", "seq", "per", "begin"]].values],
            int(of[NEXT].lo.sum()))


def _rows(pieces: dict, gaps: list, matches: list, following: int | None = None) -> pd.DataFrame:
    rows = [(PIECE, size, lo, n, 0, 0, 0) for size, (lo, n) in pieces.items()] \
        + [(GAP, size, lo, n, 0, 0, 0) for size, lo, n in gaps] + [(MATCH, *m) for m in matches]
    if following is not None:
        rows.append((NEXT, 0, following, 0, 0, 0, 0))
    return pd.DataFrame(rows, columns=["kind", "size", "lo", "n", "seq", "per", "begin"])


def match_runs(lengths: DataFrame, capacity: int) -> DataFrame:
    """(length, n) counts, at most ``capacity`` rows -> the matched runs, kind MATCH."""
    def in_range(runs: pd.DataFrame) -> pd.DataFrame:
        if (runs.kind == NEXT).any():
            return runs[["kind", "size", "lo", "n", "seq", "per", "begin"]]
        pieces, gaps, _, _ = _load(runs)
        gaps, matches = sweep(pieces, gaps, capacity)
        return _rows(pieces, gaps, matches)

    def across(runs: pd.DataFrame) -> pd.DataFrame:
        pieces, gaps, matches, following = _load(runs)
        for _ in range(SWEEPS):
            if not pieces:
                break
            gaps, new = sweep(pieces, gaps, capacity)
            if not new:
                opened, new, following = open_sequences(pieces, following, capacity)
                gaps += opened
            matches += new
        return _rows(pieces, gaps, matches, following)

    zero = F.lit(0).cast("long")
    runs = lengths.select(F.lit(PIECE).alias("kind"), F.col("length").alias("size"), zero.alias("lo"), "n",
                          zero.alias("seq"), zero.alias("per"), zero.alias("begin"))
    done = None
    while True:
        where = F.when(F.col("kind") == NEXT, F.lit(-1)).otherwise((F.col("size") * RANGES / F.lit(capacity + 1)).cast("int"))
        swept = runs.withColumn("at", where).groupBy("at").applyInPandas(in_range, RUNS)
        runs = stage(swept.groupBy().applyInPandas(across, RUNS), "runs")
        matched = runs.where(F.col("kind") == MATCH)
        done = matched if done is None else done.unionByName(matched)
        runs = runs.where(F.col("kind") != MATCH)
        if runs.where(F.col("kind") == PIECE).isEmpty():
            return done


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``tokenise`` (staged) plus sequence_id and offset."""
    counts = stage(pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("n")), "lengths")
    base = stage(counts.select(F.col("length").alias("l"), F.col("part").alias("p"),
                               (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("base")), "ranks")
    runs = match_runs(counts.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    # At most capacity runs a sweep: a table whose size does not follow the corpus.
    found = runs.select("size", "lo", "seq", "per", "begin").orderBy("size", "lo").toPandas()
    size, lo, seq, per, begin = (found[c].to_numpy(np.int64) for c in found.columns)
    first = np.searchsorted(size, np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.empty(len(rank), np.int64)
            for s in np.unique(length):
                of = length == s
                at[of] = first[s] + np.searchsorted(lo[first[s]:first[s + 1]], rank[of], side="right") - 1
            nth = rank - lo[at]
            cols = [*batch.columns[:6], pa.array(seq[at] + nth // per[at]), pa.array(begin[at] + nth % per[at] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*OUT])

    ranked = pieces.join(base, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p"))) \
        .select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, ", ".join(f"{k} {v}" for k, v in OUT.items()))


OUT = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "ids": "binary",
       "sequence_id": "long", "offset": "long"}


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False, **options) -> DataFrame:
    """Pieces of ``docs`` with their places; with ``keep_ids`` the ids go along (see ``sequences``)."""
    return pack(stage(tokenise(docs, capacity, keep_ids=keep_ids, **options), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_ids, ids binary) of pieces packed with ``keep_ids``; a group holds at most the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("p")) \
        .select("sequence_id", "n_ids", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents")).drop("ids")
