"""Byte-level BPE encoding and decoding on a contiguous rank array.

A pre-token's parts lie in one list and the ranks of adjacent pairs in
another. The lowest rank is found by a scan, its boundary deleted from both
lists, and the ranks on either side are refreshed, until no pair can merge.
Pre-tokens above ``LONG`` bytes (a scan would be quadratic) keep the same
order of merges with a heap. A worker remembers the words it has met, up to
a fixed number.

The vocabulary file is a parameter (``tokenizers`` JSON with a byte-level
pre-tokenizer); ids equal that library's, added tokens included.

Nulls and edge cases: a null text is empty, an empty text has no ids and
decodes to an empty text. Ids outside the vocabulary raise KeyError. Rows are
independent, so repeated rows, null or equal ids and empty tables need no
rule. Other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship
from .tokens import WordMemo, byte_characters, default_vocabulary

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 256
NONE = 1 << 62


class RankEncoder(WordMemo):
    """``encode_many`` as in ``WordMemo``; ``decode`` is its inverse."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab = data["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        of_char = {c: b for b, c in enumerate(byte_characters())}
        self.byte_ids = [vocab[c] for c in byte_characters()]
        #: The pair of two ids, as one integer -> rank, and rank -> id of the merged part.
        self.rank = {vocab[a] << 32 | vocab[b]: i for i, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        self.bytes_of = {i: bytes(of_char[c] for c in t) for t, i in vocab.items() if all(c in of_char for c in t)}
        self.bytes_of.update({i: t.encode() for t, i in added.items()})
        self.added = added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pretokens = regex.compile(PATTERN).findall
        super().__init__(list(added), True)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        parts = [self.byte_ids[b] for b in data]
        rank = self.rank.get
        if len(parts) > LONG:
            return self._merge_long(parts)
        ranks = [rank(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            parts[i] = self.merged[low]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 32 | parts[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or rank(parts[i] << 32 | parts[j], NONE) != r:
                continue
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (s := rank(parts[a] << 32 | parts[b], NONE)) != NONE:
                    heapq.heappush(heap, (s, a))
        return [p for p in parts if p >= 0]

    def stem(self, word: str, led: bool) -> bytes:
        return np.array(self.merge(b" " * led + word.encode()), "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.split_added.split(text) if self.split_added else [text]:
            if piece in self.added:
                ids.append(self.added[piece])
            else:
                for p in self.pretokens(piece):
                    ids += self.merge(p.encode())
        return np.array(ids, "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def rank_encoder(path: str) -> RankEncoder:
    return RankEncoder(path)


def _per_row(df: DataFrame, schema: str, column: str, kind: pa.DataType, function) -> DataFrame:
    """``df`` (doc_id, ...) with ``column`` made by ``function(list of last column's values)``, 256 rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                values = function(some.column(some.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(values, kind)], names=[*some.schema.names, column])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian uint32 in one binary."""
    path = vocabulary or default_vocabulary()
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _per_row(rows, f"doc_id {kind}, text string, ids binary", "ids", pa.binary(), lambda t: rank_encoder(path).encode_many(t)) \
        .select("doc_id", "ids")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of rows as ``encode`` makes them; null ids are an empty text."""
    path = vocabulary or default_vocabulary()
    ship(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return _per_row(encoded.select("doc_id", "ids"), f"doc_id {kind}, ids binary, text string", "text", pa.string(),
                    lambda ids: [rank_encoder(path).decode(i or b"") for i in ids])


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(read(spark, sf_dir, "documents"))).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
