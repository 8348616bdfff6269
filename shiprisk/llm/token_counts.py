"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of at most ``CHUNK`` characters is encoded whole. A longer one is cut
into chunks of ``CHUNK`` characters that reach ``OVERLAP`` characters into
their successor. Chunks are rows of their own, dealt over all tasks, and are
encoded independently, each token with its offset in the text. Where two
chunks overlap, both encodings are spliced at a *common token*: the same
piece at the same place in both. Its start is a proven stable boundary:

    BPE merges the best pair, the leftmost of equals. Take the spliced
    sequence: the left chunk's tokens before the common one, then the right
    chunk's. Any two neighbours in it are neighbours in one of the two
    chunks. Suppose encoding the whole text merged across a boundary of it,
    and look at the first such merge, between neighbours u and v. Until then
    the merges inside u and v were those of the chunk in which u and v are
    neighbours, because their order depends on nothing else; so this merge
    was possible in the chunk as well, where nothing better was left inside
    u and v, and it would have been made there. But u and v are tokens of
    the chunk. So no merge crosses a boundary, and every token is as spliced.

The white space that the library puts before a chunk does not matter: the
proof only needs each chunk to be encoded consistently. Common tokens are
found by an equi-join on (text, seam, offset, piece). A text with a seam
without a common token gets wider chunks and overlaps, four times as long,
until it fits into one chunk.

The proof holds for SentencePiece BPE models whose normalizer maps each
character to itself (a space to its mark). Each chunk is checked for that;
a text that fails, and every text with a ``tokenizers`` file, is encoded
whole. Models with other than whole-numbered scores are no BPE and encode
whole texts too.

Nulls and edge cases: a null text counts as an empty one, with no bytes and
no tokens. Repeated rows and rows with a null id are counted each for
itself. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship, slices, stage
from .tokens import encoder

CHUNK = 16_384
OVERLAP = 256
WIDEN = 4
LIMIT = 4096
#: Texts are given to the library in lots of about this many characters.
LOT = 1 << 18


class PieceCounter:
    """Counts and offsets by the ``sentencepiece`` library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = self.model.id_to_piece(list(range(size)))
        scores = np.array([self.model.get_score(i) for i in range(size)])
        self.chunks = bool((scores == np.round(scores)).all())
        self.width = np.fromiter(map(len, pieces), np.int64, size)
        self.inner = np.zeros(size, bool)  # the second and later bytes of a character without a piece
        for i in range(size):
            if self.model.is_byte(i):
                self.inner[i] = 0x80 <= int(pieces[i][3:-1], 16) < 0xC0
                self.width[i] = not self.inner[i]

    def counts(self, texts: list[str]) -> list[int]:
        return list(map(len, self.model.encode(texts, num_threads=1)))

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, starts in characters of the text); None if the text is not what the pieces are cut from."""
        if not self.chunks or self.model.normalize(text) != "▁" + text.replace(" ", "▁"):
            return None
        ids = np.array(self.model.encode(text, num_threads=1), np.int64)
        ends = np.cumsum(self.width[ids]) - 1  # without the mark before the text
        return (ids, ends - self.width[ids]) if ends[-1] == len(text) else None


class WholeCounter:
    """Counts by the ``tokenizers`` library; its texts are never cut."""

    chunks = False

    def __init__(self, path: str):
        self.encoder = encoder(path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) // 4 for ids in self.encoder.encode_many(texts)]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter | WholeCounter:
    """The worker's counter for a vocabulary file."""
    return PieceCounter(path) if path.endswith(".model") else WholeCounter(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _lots(texts: list[str]) -> Iterator[list[str]]:
    lot, size = [], 0
    for t in texts:
        if lot and size + len(t) > LOT:
            yield lot
            lot, size = [], 0
        lot.append(t)
        size += len(t)
    if lot:
        yield lot


def _first_pass(rows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """A row for each text of at most ``chunk`` characters (n_tokens), and one for each chunk of the others (uid, part, parts, text)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for batch in slices(batches):
            ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            long = [i for i, t in enumerate(texts) if len(t) > chunk and of.chunks]
            cut = set(long)
            short = [i for i in range(len(texts)) if i not in cut]
            n = [c for lot in _lots([texts[i] for i in short]) for c in of.counts(lot)]
            none = pa.nulls(len(short))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(short, pa.int64())), pa.array([len(texts[i].encode()) for i in short], pa.int64()), pa.array(n, pa.int64()),
                 none.cast(pa.string()), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.string())], names=names)
            for i in long:
                t, uid = texts[i], uuid.uuid4().hex
                parts = -(-len(t) // chunk)
                size = len(t.encode())
                for k in range(parts):
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(i, 1), pa.array([size], pa.int64()), pa.nulls(1, pa.int64()), pa.array([uid]), pa.array([k], pa.int32()),
                         pa.array([parts], pa.int32()), pa.array([t[k * chunk:(k + 1) * chunk + overlap]])], names=names)

    names = ["doc_id", "n_bytes", "n_tokens", "uid", "part", "parts", "text"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, uid string, part int, parts int, text string")


def _encoded(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(uid, part, parts, n, marks): the tokens that start in an overlap.

    A mark's ``at`` is its token's number in the chunk, ``seam`` the part
    before the seam, ``start`` its place after the seam. ``n`` is null for a
    chunk without offsets.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        mark = pa.list_(pa.struct([("left", pa.bool_()), ("seam", pa.int32()), ("start", pa.int64()), ("id", pa.int64()), ("at", pa.int64())]))
        for batch in slices(batches, 64):
            counts, marks = [], []
            for part, parts, text in zip(*(batch.column(c).to_pylist() for c in ("part", "parts", "text"))):
                if parts == 1:
                    counts.append(of.counts([text])[0])
                    marks.append([])
                    continue
                found = of.offsets(text)
                counts.append(None if found is None else len(found[0]))
                if found is None:
                    marks.append([])
                    continue
                ids, starts = found
                own = []
                for left, seam, lo in ((False, part - 1, 0), (True, part, chunk)):
                    at = np.flatnonzero((starts >= lo) & (starts < lo + overlap) & ~of.inner[ids])
                    own += [(left, seam, s, i, a) for s, i, a in zip((starts[at] - lo).tolist(), ids[at].tolist(), at.tolist())]
                marks.append([dict(zip(("left", "seam", "start", "id", "at"), m)) for m in own])
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("part"), batch.column("parts"), pa.array(counts, pa.int64()), pa.array(marks, mark)],
                                             names=["uid", "part", "parts", "n", "marks"])

    spread = chunks.select("uid", "part", "parts", "text").repartition("uid", "part")
    return spread.mapInArrow(run, "uid string, part int, parts int, n long, marks array<struct<left:boolean,seam:int,start:bigint,id:bigint,at:bigint>>")


def _spliced(encoded: DataFrame) -> DataFrame:
    """(uid, n_tokens) of each text; null where a seam has no common token."""
    marks = encoded.select("uid", F.explode("marks").alias("m")).select("uid", "m.*")
    key = ["uid", "seam", "start", "id"]
    common = marks.where("left").select(*key, F.col("at").alias("before")).join(marks.where("not left").select(*key, F.col("at").alias("after")), key)
    seams = common.groupBy("uid", "seam").agg(F.min_by(F.col("before") - F.col("after"), "start").alias("gain"))
    gains = seams.groupBy(F.col("uid").alias("u")).agg(F.sum("gain").alias("gain"), F.count("*").alias("seams"))
    texts = encoded.groupBy("uid").agg(F.max("parts").alias("parts"), F.count("n").alias("known"), F.max(F.when(F.col("part") == F.col("parts") - 1, F.col("n"))).alias("last"))
    whole = (F.col("known") == F.col("parts")) & (F.coalesce("seams", F.lit(0)) == F.col("parts") - 1)
    return texts.join(gains, F.col("uid") == F.col("u"), "left").select("uid", F.when(whole, F.col("last") + F.coalesce("gain", F.lit(0))).alias("n_tokens"))


def _widened(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """The same texts in chunks and overlaps ``WIDEN`` times as long; at most ``WIDEN`` chunks and a start are in a group."""
    group = F.floor(F.col("part") / WIDEN).cast("int")
    core = F.struct("part", F.substring("text", 1, chunk).alias("t"))
    start = F.struct("part", F.substring("text", 1, overlap * WIDEN).alias("t"))
    pieces = chunks.select("uid", "parts", group.alias("g"), core.alias("c")).union(
        chunks.where((F.col("part") % WIDEN == 0) & (F.col("part") > 0)).select("uid", "parts", group - 1, start))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["t"]), "")
    return pieces.groupBy("uid", F.ceil(F.col("parts") / WIDEN).cast("int").alias("parts"), F.col("g").alias("part")).agg(joined.alias("text"))


def count_tokens(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row. ``overlap`` is at most a quarter of ``chunk``."""
    if not 0 < overlap * WIDEN <= chunk:
        raise ValueError("an overlap is at most a quarter of a chunk")
    spark = docs.sparkSession
    ship(spark)
    path = path or default_vocabulary()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    first = stage(_first_pass(rows, path, chunk, overlap), "counted")
    chunks, found = first.where("uid is not null").select("uid", "part", "parts", "text"), []
    while not chunks.isEmpty():
        counts = stage(_spliced(stage(_encoded(chunks, path, chunk, overlap), "encoded")), "spliced")
        found.append(counts.where("n_tokens is not null"))
        failed = counts.where("n_tokens is null").select(F.col("uid").alias("u"))
        if failed.isEmpty():
            break
        again = chunks.join(failed, F.col("uid") == F.col("u"), "left_semi")
        chunks = stage(_widened(again, chunk, overlap), "widened")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
    out = first.where("uid is null").select("doc_id", "n_bytes", "n_tokens")
    heads = first.where("part = 0").select("doc_id", "n_bytes", F.col("uid").alias("u"))
    for counts in found:
        out = out.union(heads.join(counts, F.col("u") == F.col("uid")).select("doc_id", "n_bytes", "n_tokens"))
    return out


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
