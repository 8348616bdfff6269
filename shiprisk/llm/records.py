"""Token-ID binary output: length-delimited records with a separate offset index.

A record file holds one record for each document::

    length   8 bytes, little-endian unsigned
    check    4 bytes, masked CRC-32C of the length bytes
    payload  ``length`` bytes: the bytes of an id (2 or 4), then the ids, little-endian
    check    4 bytes, masked CRC-32C of the payload

``masked`` is the CRC rotated right by 15 bits plus 0xA282EAD8, modulo 2**32.
Files are named by partition; read in the order of their names they hold the
documents in ascending id order. The index is a table of its own (doc_id,
file, offset, length, n_ids), so shuffled readers fetch single records.

Nulls and edge cases: a null text is empty, an empty text is a record that
holds the end id alone, texts of any length are one record. Rows with equal
doc_id (or a null one, which sorts first) are each written. An empty table
gives an empty index. Columns other than the two named are not read.

Every task writes files under a name that no other attempt uses. The index,
committed by Spark's own writer, names only the files of attempts that
succeeded, so a lost executor or a second attempt leaves no trace in what
readers see.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, read
from .tokens import default_vocabulary, encoder

END_ID = 2
FILE_BYTES = 128 << 20
#: Words a writing task remembers, about 200 bytes each; it holds little else.
WORDS = 1_200_000
INDEX = "doc_id long, file string, offset long, length long, n_ids long, file_no long, row long"
READ = "doc_id long, file_no long, row long, n_ids long, ids_crc32 long"


def _crc_tables() -> np.ndarray:
    """Slicing tables of CRC-32C (reflected polynomial 0x82F63B78) for 8 bytes at a time."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0x82F63B78), one >> 1)
    tables = [one]
    for _ in range(7):
        tables.append((tables[-1] >> 8) ^ one[tables[-1] & 0xFF])
    return np.array(tables)


_TABLES = _crc_tables()


LANE = 256


def _zeros_tables() -> np.ndarray:
    """Tables by byte of a CRC register for what ``LANE`` zero bytes make of it."""
    v = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    for _ in range(LANE):
        v = _TABLES[0][v & 0xFF] ^ (v >> 8)
    return v


_ZEROS = _zeros_tables().tolist()


def crc32c(data: list[bytes]) -> list[int]:
    """CRC-32C of each item.

    All items are cut into lanes of 256 bytes that numpy advances side by
    side; a lane's register is then carried over the lanes that follow it.
    Zero bytes in front leave a zero register as it is, so items are padded
    there, and the usual start value is put into their first four bytes.
    """
    short = {i: d for i, d in enumerate(data) if len(d) < 4}
    lanes = [max(1, -(-len(d) // LANE)) for d in data]
    buffer = np.zeros(sum(lanes) * LANE, np.uint8)
    end = 0
    for i, (d, k) in enumerate(zip(data, lanes)):
        end += k * LANE
        if i not in short:
            buffer[end - len(d):end] = np.frombuffer(d, np.uint8)
            buffer[end - len(d):end - len(d) + 4] ^= 0xFF
    words = buffer.reshape(-1, LANE // 8, 8)
    reg = np.zeros(len(words), np.uint32)
    for k in range(LANE // 8):
        w = words[:, k]
        out = _TABLES[3][w[:, 4]] ^ _TABLES[2][w[:, 5]] ^ _TABLES[1][w[:, 6]] ^ _TABLES[0][w[:, 7]]
        for j in range(4):
            out ^= _TABLES[7 - j][w[:, j] ^ ((reg >> (8 * j)) & 0xFF).astype(np.uint8)]
        reg = out
    done, at, reg = [], 0, reg.tolist()
    z0, z1, z2, z3 = _ZEROS
    for i, k in enumerate(lanes):
        value = reg[at]
        for r in reg[at + 1:at + k]:
            value = z0[value & 255] ^ z1[value >> 8 & 255] ^ z2[value >> 16 & 255] ^ z3[value >> 24] ^ r
        at += k
        if i in short:
            value = 0xFFFFFFFF
            for b in short[i]:
                value = int(_TABLES[0][(value ^ b) & 0xFF]) ^ (value >> 8)
        done.append(value ^ 0xFFFFFFFF)
    return done


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payloads: list[bytes]) -> list[bytes]:
    """A record for each payload."""
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    sums = [masked(c).to_bytes(4, "little") for c in crc32c(heads + payloads)]
    return [b"".join(x) for x in zip(heads, sums[:len(heads)], payloads, sums[len(heads):])]


def unframe(records: list[bytes]) -> list[bytes]:
    """The payloads; ValueError if a length or a checksum is wrong."""
    heads, payloads = [r[:8] for r in records], [r[12:-4] for r in records]
    sums = [masked(c).to_bytes(4, "little") for c in crc32c(heads + payloads)]
    for r, h, p, a, b in zip(records, heads, payloads, sums[:len(heads)], sums[len(heads):]):
        if int.from_bytes(h, "little") != len(p) or r[8:12] != a:
            raise ValueError("bad record length")
        if r[-4:] != b:
            raise ValueError("bad record payload")
    return payloads


def serialize(ids: np.ndarray, width: int) -> bytes:
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def deserialize(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


def _file_system(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_records(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID,
                  id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Tokenise, write record files below ``folder`` and return the index.

    The one shuffle deals raw texts by ranges of the id (rows with equal ids
    are dealt by their place in the input), so files follow the id order.
    """
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.monotonically_increasing_id().alias("place")) \
        .repartitionByRange(n, "doc_id", "place").sortWithinPartitions("doc_id", "place")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = _file_system(folder)
        out, name, offset, k, row = None, "", 0, 0, 0
        memo = encoder(vocabulary, WORDS)
        width = 2 if max(len(memo.packed) - 1, end_id) < 1 << 16 else 4
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    some = batch.slice(lo, 256)
                    texts = some.column("text").to_pylist()
                    files, offsets, lengths, numbers = [], [], [], []
                    for record in frame([serialize(np.frombuffer(ids + end, "<u4"), width) for ids in memo.encode_many(texts)]):
                        if out is None or offset + len(record) > file_bytes and offset:
                            if out is not None:
                                out.close()
                                k += 1
                            name, offset = f"part-{part:06d}-{k:04d}-{uuid.uuid4().hex}.rec", 0
                            out = fs.open_output_stream(f"{root}/{name}")
                        out.write(record)
                        files.append(name)
                        offsets.append(offset)
                        lengths.append(len(record))
                        numbers.append((len(record) - 17) // width)
                        offset += len(record)
                    size = len(texts)
                    yield pa.RecordBatch.from_arrays([
                        some.column("doc_id"), pa.array(files), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()),
                        pa.array(numbers, pa.int64()), pa.array(np.full(size, part, np.int64)),
                        pa.array(np.arange(row, row + size, dtype=np.int64))],
                        names=["doc_id", "file", "offset", "length", "n_ids", "file_no", "row"])
                    row += size
        finally:
            if out is not None:
                out.close()

    fs, root = _file_system(folder)
    fs.create_dir(root, recursive=True)
    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, digest, schema: str) -> DataFrame:
    """``digest(batch of index rows, list of id arrays) -> RecordBatch`` over the records that ``index`` names.

    The index may be filtered or shuffled; neighbouring records of a file are
    fetched in one read of at most 8 MB or one record.
    """
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        source, opened = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                places = list(zip(*(some.column(c).to_pylist() for c in ("file", "offset", "length"))))
                found, i = [], 0
                while i < len(places):
                    name, start, length = places[i]
                    end, j = start + length, i + 1
                    while j < len(places) and places[j][0] == name and places[j][1] == end and end - start < 8 << 20:
                        end += places[j][2]
                        j += 1
                    if name != opened:
                        source, opened = fs.open_input_file(f"{root}/{name}"), name
                    data = source.read_at(end - start, start)
                    for _, at, size in places[i:j]:
                        found.append(data[at - start:at - start + size])
                    i = j
                yield digest(some, [deserialize(p) for p in unframe(found)])

    return index.mapInArrow(fetch, schema)


def _crc(batch: pa.RecordBatch, ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("file_no"), batch.column("row"),
         pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())],
        names=["doc_id", "file_no", "row", "n_ids", "ids_crc32"])


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written and read back: doc_id, start, n_tokens, ids_crc32."""
    folder = new_folder(spark, "records")
    index = write_records(read(spark, sf_dir, "documents"), folder)
    return number_records(read_records(index, folder, _crc, READ), index)


def number_records(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before each one.

    Totals of fixed runs of rows are summed first: running sums then meet
    neither a whole file nor the whole table in one task.
    """
    from pyspark.sql import Window as W

    block = (F.col("row") / F.lit(4096)).cast("long")
    totals = index.groupBy("file_no", block.alias("block")).agg(F.sum("n_ids").alias("n"))
    files = totals.groupBy("file_no").agg(F.sum("n").alias("n"))
    before_file = files.select("file_no", (F.sum("n").over(W.orderBy("file_no")) - F.col("n")).alias("before_file"))
    before_block = totals.select(F.col("file_no").alias("f"), "block", (F.sum("n").over(
        W.partitionBy("file_no").orderBy("block")) - F.col("n")).alias("before_block"))
    starts = before_block.join(before_file, before_block.f == before_file.file_no).select(
        "f", F.col("block").alias("b"), (F.col("before_file") + F.col("before_block")).alias("base"))
    w = W.partitionBy("file_no", "block").orderBy("row")
    keyed = rows.withColumn("block", block)
    return keyed.withColumn("within", F.sum("n_ids").over(w) - F.col("n_ids")) \
        .join(starts, (F.col("file_no") == F.col("f")) & (F.col("block") == F.col("b"))) \
        .select("doc_id", (F.col("base") + F.col("within")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")
