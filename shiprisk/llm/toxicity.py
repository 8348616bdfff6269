"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models; the
model of each category also sees the probabilities of the categories before
it. In training those are out-of-fold predictions: each labelled row is in
one of ``FOLDS`` folds, and its earlier probabilities come from models that
have not seen its fold, so later models learn from what they will meet.

Features are the distinct words of the whole text and their prefixes of four
to six letters, hashed to 64 bits; a category keeps those whose rate differs
most between its positive and negative rows. They are chosen for each fold's
model from the rows outside the fold, so out-of-fold predictions rest on
nothing seen of the row's own fold. The models are fitted on a
bounded sample of labelled rows (``sample``, the lowest hashes of the id);
each of the folds' models is fitted in a task of its own, and every document
is scored. A document is toxic from the probability on that gives the
out-of-fold predictions of the sample the best F1. The categories of the query are junk (quality 0), toxic (toxic 1)
and severe (toxic, with more signs of toxicity than the median toxic row). The
given labels hold no other category, so the toxic answer rests on junk and
toxic alone; severe comes after it, grades toxic rows by signs chosen over all
folds, and never changes the answer.

Nulls and edge cases: a null or empty text has no features and gets the
models' base rates. Labels without a document, null labels and repeated
labels of a document are left out, kept as negative, and reduced to their
largest. A category without both classes in the sample has a constant
probability, its rate. Without labels nothing is toxic. Repeated documents
are scored alike. An empty table gives an empty result. ``filter_clean``
keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, ship, slices, stage
from .tokens import release

SAMPLE = 10_000
FOLDS = 5
FEATURES = 256
LEAST_Z = 5.0
LEAST_ROWS = 2
PREFIXES = (4, 5, 6)
#: The threshold of rejection is chosen among this many equal steps.
BINS = 50
STEPS = 200
L2 = 1e-5
MARKS = "".join(map(chr, range(0x21, 0x30))) + ":;<=>?@[\\]^_`{|}~«»“”„‘’…–—"
MEMO = 200_000
#: Texts that are Python objects at once.
ROWS = 256
CHAIN = ("junk", "toxic", "severe")


def word_features(token: str) -> list[int]:
    """Signed 64-bit hashes of a word and its prefixes."""
    word = token.strip(MARKS)
    if not word:
        return []
    names = ["w" + word] + ["p" + word[:k] for k in PREFIXES if len(word) >= k]
    return [h - (1 << 64) if h >> 63 else h for h in map(xxhash.xxh64_intdigest, names)]


class Memo(dict):
    """token -> ``function(token)``, emptied when it is full."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, token):
        if len(self) >= MEMO:
            self.clear()
        value = self[token] = self.function(token)
        return value


def text_features(text: str | None, memo: Memo) -> list[int]:
    return sorted({f for token in set((text or "").lower().split()) for f in memo[token]})


def sampled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> DataFrame:
    """(fold, labels..., features) of at most ``sample`` labelled documents, staged."""
    names = [c for c in labels.columns if c != "label_id"]
    chosen = labels.where("label_id is not null").groupBy("label_id").agg(*(F.max(F.coalesce(c, F.lit(0))).cast("int").alias(c) for c in names)) \
        .withColumn("fold", F.pmod(F.xxhash64("label_id", F.lit("fold")), F.lit(FOLDS)).cast("int")) \
        .orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "label_id") \
        .select("fold", *names, "text")  # at most ``sample`` short rows are broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_features)
        for batch in slices(batches):
            found = [text_features(t, memo) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "features"])

    return stage(rows.mapInArrow(run, "fold int, " + ", ".join(f"{n} int" for n in names) + ", features array<bigint>"), "sample")


def choose_features(rows: DataFrame, categories: list[str], k: int = FEATURES) -> list[list[list[int]]]:
    """[model][category]: the features whose rates in positive and negative rows differ most, by the z of two proportions.

    Model m < FOLDS sees the rows outside fold m, the last one all rows. Counts are taken once for each fold.
    """
    chosen: list[list[list[int]]] = [[[] for _ in categories] for _ in range(FOLDS + 1)]
    size = np.zeros((FOLDS, 1 + len(categories)))
    for fold, *n in rows.groupBy("fold").agg(F.count("*"), *map(F.sum, categories)).collect():  # a row for each fold
        size[fold] = n
    in_fold = [F.col("fold") == j for j in range(FOLDS)]
    counts = rows.select("fold", *categories, F.explode("features").alias("f")).groupBy("f").agg(
        *(F.count(F.when(x, 1)).alias(f"n{j}_0") for j, x in enumerate(in_fold)),
        *(F.count(F.when(x & (F.col(c) == 1), 1)).alias(f"n{j}_{i}") for i, c in enumerate(categories, 1) for j, x in enumerate(in_fold)))
    tests = []
    for model in range(FOLDS + 1):
        seen = [j for j in range(FOLDS) if j != model]
        total = lambda i: sum((F.col(f"n{j}_{i}") for j in seen), F.lit(0))  # noqa: B023, E731 (used at once)
        n = size[seen].sum(0)
        for i in range(1, len(categories) + 1):
            n1, n0 = float(n[i]), float(n[0] - n[i])
            if not n1 or not n0:
                continue
            p = total(0) / (n1 + n0)
            z = F.abs((total(i) / n1 - (total(0) - total(i)) / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)))
            fits = (total(i) >= LEAST_ROWS) & (total(0) < n1 + n0)
            tests.append(F.when(fits, F.struct(F.lit(model).alias("model"), F.lit(i - 1).alias("category"), z.alias("z"))))
    if tests:
        best = Window.partitionBy("model", "category").orderBy(F.desc("z"), "f")
        found = counts.select("f", F.explode(F.array(*tests)).alias("t")).select("f", "t.*").where(F.col("z") >= LEAST_Z) \
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        for r in sorted(found.collect(), key=lambda r: r["rank"]):  # at most k for each model and category
            chosen[r["model"]][r["category"]].append(r["f"])
    return chosen


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def logistic(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Weights of ``size`` binary features (given as coordinates), the extra columns and a constant, by accelerated gradient descent."""
    n, k = len(y), extra.shape[1]
    w = np.zeros(size + k + 1)
    rate = y.mean() if n else 0.0
    if not 0 < rate < 1:
        w[-1] = 30.0 if rate else -30.0
        return w
    w[-1] = np.log(rate / (1 - rate))
    # Each weight's own bound of the curvature: a quarter of its column times the row sums
    sums = np.bincount(rows, minlength=n) + np.abs(extra).sum(1) + 1
    step = 1 / (0.25 / n * np.concatenate([np.bincount(cols, weights=sums[rows], minlength=size), np.abs(extra).T @ sums, [sums.sum()]]) + L2)
    at, before = w.copy(), w.copy()
    for i in range(STEPS):
        p = sigmoid(np.bincount(rows, weights=at[cols], minlength=n) + extra @ at[size:-1] + at[-1])
        error = (p - y) / n
        slope = np.concatenate([np.bincount(cols, weights=error[rows], minlength=size), extra.T @ error, [error.sum()]])
        slope[:-1] += L2 * at[:-1]
        w = at - step * slope
        at = w + i / (i + 3) * (w - before)
        before = w
    return w


class Chain:
    """``features``: hash -> column; ``weights[category][fold]``, the last of each fitted on all folds.

    ``own[model]``: which columns the model of that number may use.
    """

    def __init__(self, categories: tuple[str, ...], features: list[list[int]]):
        self.categories, self.weights, self.threshold = categories, [], 0.5
        self.column = {f: i for i, f in enumerate(dict.fromkeys(f for fs in features for f in fs))}
        self.own = np.zeros((len(features), len(self.column)), bool)
        for model, fs in enumerate(features):
            self.own[model, [self.column[f] for f in fs]] = True

    def coordinates(self, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of each known feature, in the order given."""
        sizes = np.fromiter(map(len, features), np.int64, len(features))
        flat = np.concatenate([np.zeros(0, np.int64), *(np.asarray(fs, np.int64) for fs in features)])
        known = np.fromiter(self.column, np.int64, len(self.column))
        order = np.argsort(known)
        at = np.searchsorted(known, flat, sorter=order)
        hit = at < len(known)
        hit[hit] = known[order[at[hit]]] == flat[hit]
        return np.repeat(np.arange(len(features)), sizes)[hit], order[at[hit]]

    def probabilities(self, rows: np.ndarray, cols: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """(rows, categories fitted so far): each row by the models of its fold's number."""
        n, size = len(fold), len(self.column)
        p = np.zeros((n, 0))
        for weights in self.weights:
            w = np.array(weights)
            own = fold[rows]
            score = np.bincount(rows, weights=w[own, cols], minlength=n) + (p * w[fold, size:-1]).sum(1) + w[fold, -1]
            p = np.concatenate([p, sigmoid(score)[:, None]], 1)
        return p


def _fitter(chain: Chain, category: str):
    def fit(group: pd.DataFrame) -> pd.DataFrame:
        model = int(group.model.iloc[0])
        group = group[group.fold != model]
        r, c = chain.coordinates(list(group.features))
        earlier = chain.probabilities(r, c, group.fold.to_numpy())
        r, c = r[chain.own[model, c]], c[chain.own[model, c]]
        return pd.DataFrame({"model": [model], "w": [logistic(r, c, earlier, group[category].to_numpy(float), len(chain.column))]})

    return fit


def choose_threshold(rows: DataFrame, chain: Chain, category: str) -> float:
    """The step whose out-of-fold predictions have the best F1; the middle one of equals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            r, c = chain.coordinates(batch.column("features").to_pylist())
            p = chain.probabilities(r, c, batch.column("fold").to_numpy())[:, chain.categories.index(category)]
            yield pa.RecordBatch.from_arrays([batch.column(category), pa.array((p * BINS).astype(np.int32))], names=["y", "bin"])

    counts = np.zeros((2, BINS + 1))
    for y, b, n in rows.mapInArrow(run, "y int, bin int").groupBy("y", "bin").count().collect():  # two rows a step at most
        counts[y, b] = n
    caught, false = (counts[k, ::-1].cumsum()[::-1][1:BINS] for k in (1, 0))  # at thresholds 1/BINS, 2/BINS, ...
    if not counts[1].sum():
        return 0.5
    f1 = 2 * caught / (caught + false + counts[1].sum())
    best = np.flatnonzero(f1 == f1.max()) + 1
    return float(best[len(best) // 2]) / BINS


def fit_chain(rows: DataFrame, categories: tuple[str, ...], features: list[list[int]]) -> Chain:
    """``rows``: fold, a 0/1 column for each category, features; ``features``: those of each model.

    At most ``sample`` rows are in a group.
    """
    chain = Chain(categories, features)
    size = len(chain.column)
    copies = rows.withColumn("model", F.explode(F.array(*map(F.lit, range(FOLDS + 1)))))
    for category in categories:
        fits = copies.groupBy("model").applyInPandas(_fitter(chain, category), "model int, w array<double>")
        found = {r["model"]: r["w"] for r in fits.collect()}
        empty = [0.0] * (size + len(chain.weights)) + [-30.0]
        chain.weights.append([found.get(m, empty) for m in range(FOLDS + 1)])
    return chain


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """The chain junk, toxic, severe from labels (doc_id, quality, toxic)."""
    ship(docs.sparkSession)
    marked = labels.select(F.col("doc_id").alias("label_id"), (F.col("quality") == 0).cast("int").alias("junk"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    rows = sampled(docs, marked, sample, id_col, text_col)
    first = choose_features(rows, ["junk", "toxic"])
    signs = first[FOLDS][1]
    if signs:
        n_signs = F.size(F.array_intersect("features", F.array(*map(F.lit, signs))))
        rows = stage(rows.withColumn("signs", F.when(F.col("toxic") == 1, n_signs)), "sample")
        middle = rows.agg(F.median("signs")).first()[0]
        rows = rows.withColumn("severe", F.coalesce((F.col("signs") > F.lit(middle)).cast("int"), F.lit(0)))
    else:
        rows = rows.withColumn("severe", F.lit(0))
    last = choose_features(rows, ["severe"])
    features = [[*f[0], *f[1], *s[0]] for f, s in zip(first, last)]
    keep = F.array(*map(F.lit, dict.fromkeys(f for fs in features for f in fs))).cast("array<bigint>")
    slim = stage(rows.select("fold", *CHAIN, F.array_intersect("features", keep).alias("features")), "sample")
    chain = fit_chain(slim, CHAIN, features)
    chain.threshold = choose_threshold(slim, chain, "toxic")
    return chain


def _scorer(chain: Chain):
    """texts -> (rows, categories) probabilities by the models of all folds."""
    column = {f: c for f, c in chain.column.items() if chain.own[FOLDS, c]}  # the other columns have no weight here

    def columns(token: str) -> list[int]:
        return [column[f] for f in word_features(token) if f in column]

    memo = Memo(columns)

    def score(texts: list[str | None]) -> np.ndarray:
        rows, cols = [], []
        for i, t in enumerate(texts):
            found = {c for token in set((t or "").lower().split()) for c in memo[token]}
            rows += [i] * len(found)
            cols += found
        return chain.probabilities(np.array(rows, np.int64), np.array(cols, np.int64), np.full(len(texts), FOLDS))

    return score


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category>..., toxic) for each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(chain)
        for batch in slices(batches):
            p = of(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(x)) for x in p.T),
                                              pa.array(p[:, chain.categories.index("toxic")] >= chain.threshold)],
                                             names=["doc_id", *(f"p_{c}" for c in chain.categories), "toxic"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"p_{c} double" for c in chain.categories) + ", toxic boolean")


def filter_clean(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose probability of being toxic is below the threshold. Only texts leave the JVM."""
    ship(docs.sparkSession)
    toxic = chain.categories.index("toxic")
    scorer: list = []  # one for each task: the function is unpickled there

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        if not scorer:
            release()
            scorer.append(_scorer(chain))
        below = [scorer[0](texts.slice(lo, ROWS).to_pylist())[:, toxic] < chain.threshold for lo in range(0, len(texts), ROWS)]
        return pa.array(np.concatenate(below) if below else [], pa.bool_())

    return docs.where(clean(F.col(f"`{text_col}`")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
