"""Secret scans: fixed patterns and a battery of randomness tests.

Base spans: assignments to password-like names, access keys and long hex
strings, each leftmost and non-overlapping among its kind. The method adds
spans: a candidate is a run of 20 or more characters of the base64 alphabets
that holds a letter. Its encoding is inferred as the smallest of a few
alphabets that holds all its characters, and tests ask whether it could be
drawn evenly from it: chi-squared uniformity of the symbols, the number of
runs of one class (capitals, small letters, digits, others), lag-1 serial
correlation, and, for a run without digits, how likely that is. The tests see
the same characters, so the sum of their -log p is not taken for Fisher's
chi-squared: its distribution is simulated once for each alphabet and length
of a grid (``DRAWS`` seeded strings), with an exponential tail above its 99th
percentile, and one p-value is read from it at the nearest length. A run that
fits no alphabet is cut at each = inside it (NAME=value), and parts that still
fit none are cut at the characters outside either alphabet of 64 symbols;
every part of 20 or more characters is then a candidate, and of random spans
inside each other the outer one is reported.

Two false-discovery controls (Benjamini-Hochberg, over the candidates of all
documents, within bands of length) decide. First, randomness is rejected at
the rate ``fdr``. Second, a candidate is a secret only if it also looks too
random for an ordinary identifier: names in camel case, snake case, as paths
and so on are made of words of the corpus (one for each document that has
words, at a place given by its hash) and of a small word list (``PRIOR`` a
band, so that few documents suffice), go through the same battery, and the
share of them that looks at least as random as a candidate is its second
p-value; at most the rate ``false_secrets`` of what is reported is expected to
be ordinary. A candidate that passes both, and is not inside a base span, is a
span of kind random. The step-up rules need only counts of levels on a fixed
grid, so no band is ever sorted in one task.

Nulls and edge cases: a null or empty text has no spans. Texts of any length
are scanned whole. Rows are independent apart from the shared thresholds;
repeated rows count as often as they occur. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship, slices, stage
from .tokens import release

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs of 20 or more characters
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
VALUE = re.compile(r"[^=]+(?:=+\Z)?")  # what stands between signs, with the padding at a run's end
PIECES = [re.compile(r"[A-Za-z0-9+/=]{20,}"), re.compile(r"[A-Za-z0-9_=-]{20,}")]
FITS = [re.compile(r"[A-Za-z0-9+/]+"), re.compile(r"[A-Za-z0-9_-]+")]
MIN_RUN = 20
ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz",
             "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"]
_PLACES = [{c: i for i, c in enumerate(a)} for a in ALPHABETS]
_CLASSES = [np.array([0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 for c in a]) for a in ALPHABETS]
BANDS = [32, 64, 128]
FDR = 0.01
FALSE_SECRETS = 0.05
#: Lengths at which the distribution of the battery's sum is simulated, and the strings drawn for it (fewer of the longest).
LENGTHS = [20, 22, 24, 28, 32, 40, 48, 64, 96, 128, 192, 256]
DRAWS = 20_000
SYMBOLS = 1_280_000
#: Ordinary identifiers of the word list, for each band of lengths.
PRIOR = 4_000
WORDS = """get set is has make find load save read write open close update delete create user account name list item value index count
total size time date start end first last next token key hash data file path line text page query table column row group order
price customer product vendor shipment delivery status message request response error handler service manager factory builder
config option default version number string object module client server session buffer stream parser format result info""".split()
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,12}(?![A-Za-z0-9+/_=-])")
#: Characters of a text, from the place of its hash on, whose words make its identifier.
AROUND = 600
#: p-values are kept as whole steps of -10 log10(p), at most so many.
STEPS = 2000
REDACTED = "[SECRET]"
#: Texts that are Python objects at once.
ROWS = 256


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _log_tail(z: np.ndarray) -> np.ndarray:
    """-log P(N(0, 1) > z)."""
    return -np.log(np.maximum(0.5 * _erfc(z / math.sqrt(2)).astype(float), 1e-300))


def evidence(x: np.ndarray, k: int) -> np.ndarray:
    """For each row of symbols of alphabet ``k``: the sum of the tests' -log p."""
    rows, n = x.shape
    size, of = len(ALPHABETS[k]), _CLASSES[k]
    counts = np.bincount((x + np.arange(rows)[:, None] * size).ravel(), minlength=rows * size).reshape(rows, size)
    chi2 = ((counts - n / size) ** 2).sum(1) * size / n
    # Wilson-Hilferty: the cube root of chi-squared over its degrees of freedom is close to normal
    df = size - 1
    uniform = _log_tail(((chi2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    share = np.bincount(of, minlength=4) / size
    change = 1 - float((share ** 2).sum())  # two neighbours are of unlike classes
    both = float((share * (1 - share) ** 2).sum())  # so are three in a row, pairwise
    spread = math.sqrt((n - 1) * change * (1 - change) + 2 * (n - 2) * (both - change ** 2))
    kinds = of[x]
    runs = _log_tail(np.abs((kinds[:, 1:] != kinds[:, :-1]).sum(1) - (n - 1) * change) / spread) - math.log(2)
    d = x - x.mean(1, keepdims=True)
    power = (d * d).sum(1)
    r = np.where(power > 0, (d[:, 1:] * d[:, :-1]).sum(1) / np.where(power > 0, power, 1), 1.0)
    serial = _log_tail(np.abs(r + 1 / n) * math.sqrt(n)) - math.log(2)
    without = np.where((kinds == 2).any(1), 0.0, -n * math.log(1 - share[2]))
    return uniform + runs + serial + without


@lru_cache(maxsize=None)
def null(k: int, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """For even strings of length ``n``: quantiles of the evidence, their log tails, and the mean excess over the last."""
    rng = np.random.default_rng([k, n])
    draws = min(DRAWS, SYMBOLS // n)
    at_once = max(1, 64_000 // n)  # rows: bounds the arrays, not the draws
    found = np.sort(np.concatenate([evidence(rng.integers(0, len(ALPHABETS[k]), (min(at_once, draws - i), n)), k) for i in range(0, draws, at_once)]))
    tails = np.linspace(1, 0.01, 199)
    cut = np.quantile(found, 1 - tails)
    return cut, np.log(tails), float((found[found > cut[-1]] - cut[-1]).mean())


def battery(text: str) -> tuple[int, float] | None:
    """Alphabet's number and log p-value of an even draw from it; None if no encoding is inferred."""
    body = text.rstrip("=")
    for k, place in enumerate(_PLACES):
        if all(c in place for c in body):
            break
    else:
        return None
    n = len(body)
    if n < 2:
        return None
    found = float(evidence(np.fromiter(map(place.__getitem__, body), np.int64, n)[None, :], k)[0])
    cut, tails, excess = null(k, min(LENGTHS, key=lambda x: abs(math.log(x / n))))
    return k, float(np.interp(found, cut, tails)) if found <= cut[-1] else float(tails[-1]) - (found - cut[-1]) / excess


def level_of(log_p: float) -> int:
    return min(STEPS, int(-10 / math.log(10) * log_p))


def band_of(length: int) -> int:
    return sum(length >= x for x in BANDS)


def identifier(words: list[str], rng: random.Random) -> str | None:
    """An ordinary name, path or constant of the words, of a length drawn over the bands; None if they do not suffice."""
    low = MIN_RUN if rng.random() < 0.5 else rng.choice(BANDS)
    length, style, parts, size = rng.randrange(low, 2 * low), rng.randrange(6), [], 0
    for w in words:
        parts.append(w.lower())
        size += len(w) + (style in (1, 2, 3, 4))
        if size >= length:
            break
    else:
        return None
    if rng.random() < 0.3:
        parts.append(str(rng.randrange(1000)))
    if style == 0:
        return parts[0] + "".join(w.capitalize() for w in parts[1:])
    if style == 5:
        return "".join(parts)
    joined = "_-/_"[style - 1].join(parts)
    return joined.upper() if style == 4 else joined


def ordinary(text: str) -> list[tuple[int, int]]:
    """(band, level) of the identifier made of the text's words, if it has enough of them."""
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    at = seed % max(1, len(text) - AROUND)
    return judged(identifier(WORD.findall(text, at, at + AROUND), random.Random(seed)))


def judged(name: str | None) -> list[tuple[int, int]]:
    tested = battery(name) if name and len(name) >= MIN_RUN else None
    return [(band_of(len(name)), level_of(tested[1]))] if tested else []


@lru_cache(maxsize=None)
def prior() -> tuple[tuple[int, int], ...]:
    """(band, level) of ``PRIOR`` identifiers of the word list for each band."""
    rng = random.Random(1)
    found: list[tuple[int, int]] = []
    missing = [PRIOR] * (len(BANDS) + 1)
    while any(missing):
        for band, level in judged(identifier(rng.choices(WORDS, k=120), rng)):
            if missing[band]:
                missing[band] -= 1
                found.append((band, level))
    return tuple(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def parts(run: str) -> list[tuple[int, int]]:
    """Places in a run that fits no alphabet of what may fit one, by start."""
    found = set()
    for m in VALUE.finditer(run):
        if m.end() - m.start() < MIN_RUN:
            continue
        if any(x.fullmatch(m.group().rstrip("=")) for x in FITS):
            found.add(m.span())
        else:
            found |= {(m.start() + x.start(), m.start() + x.end()) for p in PIECES for x in p.finditer(m.group())}
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, band, level) of what the battery judges; level: -10 log10 of the p-value."""
    out = []
    k = reach = 0  # base spans that begin at or before the run, and how far they go
    for m in CANDIDATE.finditer(text):
        at = m.start()
        whole = any(x.fullmatch(m.group().rstrip("=")) for x in FITS)
        for a, b in [(0, len(m.group()))] if whole else parts(m.group()):
            s, e, run = at + a, at + b, m.group()[a:b]
            while k < len(base) and base[k][0] <= s:
                reach = max(reach, base[k][2])
                k += 1
            if e <= reach or not any(c.isalpha() for c in run):
                continue
            tested = battery(run)
            if tested:
                out.append((s, e, band_of(e - s), level_of(tested[1])))
    return out


SPAN = "struct<start:bigint,kind:int,end:bigint>"
CAND = "struct<start:bigint,end:bigint,band:int,level:int>"
NAME = "struct<band:int,level:int>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base array<struct>, tested array<struct>, ordinary array<struct>) for each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        cand = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("band", pa.int32()), ("level", pa.int32())]))
        name = pa.list_(pa.struct([("band", pa.int32()), ("level", pa.int32())]))
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            tested = [candidates(t, b) for t, b in zip(texts, base)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([[dict(zip(("start", "kind", "end"), x)) for x in b] for b in base], span),
                 pa.array([[dict(zip(("start", "end", "band", "level"), x)) for x in c] for c in tested], cand),
                 pa.array([[dict(zip(("band", "level"), x)) for x in ordinary(t)] for t in texts], name)], names=["doc_id", "base", "tested", "ordinary"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, base array<{SPAN}>, tested array<{CAND}>, ordinary array<{NAME}>")


def decision_levels(scanned: DataFrame, fdr: float = FDR, false_secrets: float = FALSE_SECRETS) -> list[int]:
    """For each band, the level below which a candidate is a secret (two Benjamini-Hochberg rules on the grid of levels)."""
    each = F.array(F.struct(F.lit(0).alias("name"), F.col("tested.band").alias("bands"), F.col("tested.level").alias("levels")),
                   F.struct(F.lit(1).alias("name"), F.col("ordinary.band").alias("bands"), F.col("ordinary.level").alias("levels")))
    pairs = scanned.select(F.explode(each).alias("e")).select("e.name", F.explode(F.arrays_zip("e.bands", "e.levels")).alias("t"))
    n = np.zeros((2, len(BANDS) + 1, STEPS + 1), np.int64)
    for name, band, level, count in pairs.groupBy("name", F.col("t.bands"), F.col("t.levels")).count().collect():  # (2 x bands x levels) rows at most
        n[name, band, level] = count
    for band, level in prior():
        n[1, band, level] += 1
    levels = []
    for tested, names in zip(n[0], n[1]):
        total = tested.sum()
        at_least, at_most = tested[::-1].cumsum()[::-1], tested.cumsum()
        grid = np.arange(STEPS + 1)
        rejected = np.flatnonzero((tested > 0) & (10.0 ** (-grid / 10) * total <= fdr * at_least))
        p_name = (1 + names.cumsum()) / (1 + names.sum())  # so many ordinary names look at least as random
        unlike = np.flatnonzero((tested > 0) & (p_name * total <= false_secrets * at_most))
        levels.append(min(int(rejected[0]) if len(rejected) else STEPS + 1, int(unlike[-1]) + 1 if len(unlike) else 0))
    return levels


def find_secrets(docs: DataFrame, fdr: float = FDR, false_secrets: float = FALSE_SECRETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, kind, end>>): base and random spans by start, then kind."""
    scanned = stage(scan(docs, id_col, text_col), "scanned")
    levels = F.array(*map(F.lit, decision_levels(scanned, fdr, false_secrets)))
    random = F.transform(F.filter("tested", lambda t: t["level"] < F.element_at(levels, t["band"] + 1)),
                         lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    inside = lambda t, o: (o["start"] <= t["start"]) & (o["end"] >= t["end"]) & (o["end"] - o["start"] > t["end"] - t["start"])
    scanned = scanned.withColumn("random", random)
    outer = F.filter("random", lambda t: ~F.exists("random", lambda o: inside(t, o)))
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", outer)).alias("spans"))


def _text(spans: str):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"))


def _replaced(text: str, levels: list[int]) -> str | None:
    """``text`` with its secrets replaced; None if it has none."""
    base = base_spans(text)
    spans = sorted([(s, e) for s, _, e in base] + [(s, e) for s, e, band, level in candidates(text, base) if level < levels[band]])
    if not spans:
        return None
    out, end = [], 0
    for s, e in spans:
        if s >= end:
            out += [text[end:s], REDACTED]
        end = max(end, e)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, fdr: float = FDR, false_secrets: float = FALSE_SECRETS, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with each secret replaced; rows without one stay as they are.

    Rows are judged by the thresholds of ``docs`` itself. Overlapping spans
    are one. ``length_col``, where present, becomes the new text's length.
    Only texts leave the JVM, and only changed ones come back.
    """
    levels = decision_levels(stage(scan(docs.select(F.lit(0).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))), "scanned"), fdr, false_secrets)

    @F.arrow_udf("string")
    def changed(texts: pa.Array) -> pa.Array:
        release()
        out = []
        for lo in range(0, len(texts), ROWS):
            out += [_replaced(t or "", levels) for t in texts.slice(lo, ROWS).to_pylist()]
        return pa.array(out, pa.string())

    new = "_redacted"
    while new in docs.columns:
        new += "_"
    out = docs.withColumn(new, changed(F.col(f"`{text_col}`")))
    columns = {text_col: F.coalesce(new, f"`{text_col}`")}
    if length_col in docs.columns:
        columns[length_col] = F.when(F.col(new).isNotNull(), F.length(new).cast(docs.schema[length_col].dataType)).otherwise(F.col(f"`{length_col}`"))
    return out.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])
