"""Three-stage delay model.

Stage 1: soft vote of a random forest and two boosted classifiers (delay
probability). Stage 2: boosted regressor on delayed rows (delay days).
Stage 3: k-means pseudo-labels on the delayed rows, learned by one boosted
classifier a class (delay reason).

Preprocessing is column arithmetic against a one-row statistics table and
splits are row-local hashes (no shuffle, no sort). Statistics, bin bounds and
k-means (``clusters``) see all training rows, and so does every tree part:
fitted by a task of its own (``boosting``) where the rows fit one, else by
passes of many tasks (``passes``). Independent parts are fitted at the same
time, and only those that a query needs.
Scoring evaluates them for every row in place, in Arrow batches.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import RLock

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import aggregates as A
from ..operators import metrics as MT
from ..operators import quality as Q
from ..schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from ..session import cut_lineage, ship
from . import boosting as B
from . import clusters as K
from . import passes as PS
from .assemble import score_assemble


@dataclass
class TrainParams:
    """Model settings; the defaults are the reference's.

    Every part is fitted on all of its training rows. Up to ``fit_rows`` of
    them, one task fits a part by itself; more are fitted by passes of many
    tasks (``passes``).
    """
    rf_trees: int = 100
    rf_depth: int = 10
    rf_min_leaf: int = 10
    gbt_a_iter: int = 200
    gbt_a_lr: float = 0.05
    gbt_a_depth: int = 8
    gbt_b_iter: int = 100
    gbt_b_lr: float = 0.05
    gbt_b_depth: int = 6
    reg_iter: int = 200
    reg_lr: float = 0.05
    reg_depth: int = 10
    kmeans_k: int = 4
    kmeans_restarts: int = 10
    reason_iter: int = 200
    reason_lr: float = 0.05
    reason_depth: int = 8
    leaves: int = 31
    test_percent: int = 20
    seed: int = 42
    fit_rows: int = 500_000

    @classmethod
    def quick(cls) -> "TrainParams":
        """Small forests and few boosting rounds (for tests)."""
        return cls(rf_trees=8, rf_depth=5, gbt_a_iter=5, gbt_a_depth=4, gbt_b_iter=5, gbt_b_depth=3,
                   reg_iter=5, reg_depth=4, kmeans_restarts=2, reason_iter=5, reason_depth=5)

    def tree_parts(self) -> dict[str, B.Settings]:
        """Settings of each task's trees. The forest is fitted in ``FOREST_TASKS`` independent lots of trees."""
        lots = {f"rf_{i}": B.Settings("forest", self.rf_trees // FOREST_TASKS, depth=self.rf_depth, leaves=1 << self.rf_depth,
                                      least_rows=self.rf_min_leaf, balanced=True, seed=self.seed + i) for i in range(FOREST_TASKS)}
        reasons = {f"reason_{k}": B.Settings("logistic", self.reason_iter, self.reason_lr, self.reason_depth, self.leaves, balanced=True)
                   for k in range(self.kmeans_k)}
        return {
            "gbt_a": B.Settings("logistic", self.gbt_a_iter, self.gbt_a_lr, self.gbt_a_depth, self.leaves, balanced=True),
            "gbt_b": B.Settings("logistic", self.gbt_b_iter, self.gbt_b_lr, self.gbt_b_depth, 1 << self.gbt_b_depth, least_rows=1, least_hessian=1.0, l2=1.0),
            "regressor": B.Settings("squared", self.reg_iter, self.reg_lr, self.reg_depth, self.leaves), **lots, **reasons}


def _kind(part: str) -> str:
    """The stage whose rows a part is fitted on."""
    return "days" if part == "regressor" else "reason" if part.startswith("reason_") else "vote"


def _wanted(part: str) -> int | None:
    return int(part.split("_")[1]) if part.startswith("reason_") else None


FOREST_TASKS = 4
FEATURES = [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES]
CATEGORIES = {"carrier_type": C.CARRIER_TYPES, "priority_level": C.PRIORITY_LEVELS}


# M1 / M2 ----------------------------------------------------------------
def hash_percent(key, salt: str = "") -> Column:
    """0..99 from the first 8 hex digits of md5(salt || key): row-local and reproducible."""
    k = F.concat(F.lit(salt), F.col(key).cast("string")) if salt else F.col(key).cast("string")
    return F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("long") % 100


def stratified_split(df: DataFrame, key: str = "shipment_id", test_percent: int = 20) -> DataFrame:
    """M1: ``is_test`` flag; stratified in expectation (the hash ignores the label)."""
    return df.withColumn("is_test", hash_percent(key) < test_percent)


def random_split(df: DataFrame, key: str = "shipment_id", test_percent: int = 20, salt: str = "reg:") -> DataFrame:
    """M2: unstratified split (own salt, so it is independent of M1)."""
    return df.withColumn("is_test", hash_percent(key, salt) < test_percent)


def stratified_split_exact(df: DataFrame, key: str = "shipment_id", label: str = "delay_flag",
                           test_percent: int = 20) -> DataFrame:
    """M1, exact mode: per label exactly ceil(test_percent % of its rows) test rows, those with the smallest (md5(key), key).

    Rows are range-sorted by (label, md5, key), with a unique tie so that an
    id with very many copies is split too, numbered within their partition,
    and shifted by the counts of the partitions before. No label is sorted in
    one task, and nothing goes to the driver. Which of several rows with
    equal ids are taken at the boundary is open; how many is not.
    """
    order = [label, "_h", key, "_tie"]
    placed = df.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_tie", F.monotonically_increasing_id())
    placed = cut_lineage(placed.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(F.col(label).alias("_l"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    one = Window.partitionBy("_l")  # a row for each partition
    before = one.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(one))
    joined = placed.join(counts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_part") == F.col("_p")))
    place = F.col("_at") - F.col("_from") + F.col("_before")
    return joined.select(*df.columns, (place < F.ceil(F.col("_all") * test_percent / 100.0)).alias("is_test"))


# M3 ---------------------------------------------------------------------
def ordinal_code(c, categories: list[str]) -> Column:
    """Fixed category order -> 0..n-1; unknown or null -> -1."""
    m = F.create_map(*[x for i, v in enumerate(categories) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(F.element_at(m, F.col(c) if isinstance(c, str) else c), F.lit(C.UNKNOWN_CATEGORY_CODE))


def ordinal_encode(df: DataFrame) -> DataFrame:
    return df.withColumns({"carrier_type_code": ordinal_code("carrier_type", C.CARRIER_TYPES),
                           "priority_level_code": ordinal_code("priority_level", C.PRIORITY_LEVELS)})


# M4 ---------------------------------------------------------------------
def standardize(df: DataFrame, stats: DataFrame, features: list[str] = NUMERIC_FEATURES) -> DataFrame:
    """M4: (x - mean) / std with population statistics.

    The statistics are one row per feature (bounded by the feature list, not
    the data), read once and inlined as literals, as a fitted scaler holds
    its vectors: the scaling is then plain arithmetic inside codegen.
    """
    rows = {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}

    def lit(v):
        return F.lit(None).cast("double") if v is None else F.lit(float(v))
    scaled = {f"{f}_scaled": (F.col(f).cast("double") - lit(rows.get(f, (None, None))[0])) / lit(rows.get(f, (None, None))[1])
              for f in features}
    return df.withColumns(scaled)


# M5 ---------------------------------------------------------------------
FEATURE_VECTOR_INPUTS = [f"{f}_scaled" for f in NUMERIC_FEATURES] + [f"{c}_code" for c in CATEGORICAL_FEATURES]


def assemble_features(df: DataFrame, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=FEATURE_VECTOR_INPUTS, outputCol=out, handleInvalid="keep").transform(df)


def prepare(df: DataFrame, stats: DataFrame) -> DataFrame:
    """M3 + M4 + M5."""
    return assemble_features(standardize(ordinal_encode(df), stats))


# M7 / M10 ---------------------------------------------------------------
def soft_vote(*probabilities) -> Column:
    """M7: mean of the members' P(delay)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in probabilities]
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total / float(len(cols))


def reason_labels(index) -> Column:
    from .assemble import reason_label
    return reason_label(index)


# features of the trees ----------------------------------------------------
def tree_inputs() -> list[Column]:
    """The 27 features as doubles, categories by their fixed codes; trees need no scaling."""
    return [F.col(f).cast("double") for f in NUMERIC_FEATURES] + [ordinal_code(c, CATEGORIES[c]).cast("double") for c in CATEGORICAL_FEATURES]


def bin_bounds(train: DataFrame) -> list[np.ndarray]:
    """For each feature, the distinct quantiles of all training rows (one mergeable sketch a feature, ``BINS`` numbers to the driver)."""
    steps = [i / B.BINS for i in range(1, B.BINS)]
    row = train.agg(*[F.percentile_approx(x, steps, 10_000).alias(f"q{i}") for i, x in enumerate(tree_inputs())]).first()
    return [np.unique(np.array(q or [], float)) for q in row]


def _columns(arrays) -> list[np.ndarray]:
    return [a.to_numpy(zero_copy_only=False) for a in arrays]


def codes_column(edges: list[np.ndarray]) -> Column:
    """A row's features as one byte each."""
    @F.arrow_udf("binary")
    def codes(*arrays: pa.Array) -> pa.Array:
        c = B.codes_of(_columns(arrays), edges)
        offsets = np.arange(len(c) + 1, dtype=np.int32) * c.shape[1]
        return pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(offsets), pa.py_buffer(c.tobytes())])

    return codes(*tree_inputs())


# fitted model ------------------------------------------------------------
OUTPUTS = {"p_rf": ("rf",), "p_gbt_a": ("gbt_a",), "p_gbt_b": ("gbt_b",), "raw_days": ("regressor",), "reason_index": ("reason",)}
NODE_SCHEMA = "part string, base double, mean boolean, depth int, root boolean, node int, feature int, bin int, `left` int, `right` int, value double"


@dataclass
class DelayModel:
    """``forests``: rf, gbt_a, gbt_b, regressor, reason_0, ...; any of them may be absent until it is needed."""
    stats: DataFrame
    edges: list[np.ndarray]
    forests: dict[str, B.Forest] = field(default_factory=dict)
    kmeans: K.Clusters | None = None

    # S10 ------------------------------------------------------------------
    def save(self, path: str) -> None:
        """Statistics, bounds, tree nodes and cluster centers as Parquet tables."""
        spark = self.stats.sparkSession
        self.stats.write.mode("overwrite").parquet(f"{path}/scaler")
        spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(self.edges)], "feature int, bounds array<double>") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")
        nodes = pd.concat([pd.DataFrame({"part": n, "base": f.base, "mean": f.mean, "depth": f.depth, "root": np.isin(np.arange(len(f.value)), f.roots),
                                         "node": np.arange(len(f.value), dtype=np.int32), "feature": f.feature, "bin": f.bin, "left": f.left, "right": f.right,
                                         "value": f.value}) for n, f in self.forests.items()])
        spark.createDataFrame(nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/forests")
        spark.createDataFrame([(i, c.tolist(), self.kmeans.inputs, self.kmeans.cost) for i, c in enumerate(self.kmeans.centers)],
                              "cluster int, center array<double>, inputs array<string>, cost double").coalesce(1).write.mode("overwrite").parquet(f"{path}/kmeans")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "DelayModel":
        edges = [np.array(r["bounds"], float) for r in spark.read.parquet(f"{path}/bounds").orderBy("feature").collect()]
        nodes = spark.read.parquet(f"{path}/forests").toPandas()  # as many rows as the model has nodes
        forests = {}
        for name, of in nodes.sort_values(["part", "node"]).groupby("part"):
            first = of.iloc[0]
            forests[name] = B.Forest(float(first.base), bool(first["mean"]), int(first.depth), of.node[of.root].to_numpy(np.int32),
                                     *(of[c].to_numpy(np.int32) for c in ("feature", "bin", "left", "right")), of.value.to_numpy(float))
        rows = spark.read.parquet(f"{path}/kmeans").orderBy("cluster").collect()  # a row for each center
        kmeans = K.Clusters(np.array([r["center"] for r in rows]), rows[0]["inputs"], rows[0]["cost"])
        return cls(spark.read.parquet(f"{path}/scaler"), edges, forests, kmeans)

    # scoring --------------------------------------------------------------
    def raw_scores(self, features: DataFrame, outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
        """``features`` with the wanted outputs, and raw_p (soft vote) where all voters are wanted. One pass of Python for all parts."""
        forests, edges = self.forests, self.edges
        reasons = sorted(n for n in forests if n.startswith("reason_"))
        kinds = {o: "int" if o == "reason_index" else "double" for o in outputs}

        @F.arrow_udf("struct<" + ",".join(f"{o}:{k}" for o, k in kinds.items()) + ">")
        def scores(*arrays: pa.Array) -> pa.Array:
            codes = B.codes_of(_columns(arrays), edges)
            made = []
            for o, kind in kinds.items():
                if o == "reason_index":
                    x = np.stack([forests[n].raw(codes) for n in reasons]).argmax(0).astype(np.int32)
                elif o == "raw_days":
                    x = forests["regressor"].raw(codes)
                else:
                    x = forests[o[2:]].probability(codes)
                made.append(pa.array(x, pa.int32() if kind == "int" else pa.float64()))
            return pa.StructArray.from_arrays(made, names=list(kinds))

        ship(features.sparkSession)
        x = features.withColumn("_scores", scores(*tree_inputs()))
        x = x.withColumns({o: F.col(f"_scores.{o}") for o in outputs}).drop("_scores")
        voters = ("p_rf", "p_gbt_a", "p_gbt_b")
        return x.withColumn("raw_p", soft_vote(*voters)) if set(voters) <= set(outputs) else x


# M6 / M8 / M9 / M11 -----------------------------------------------------
class DelayTrainer:
    """Fits parts of the model when they are first asked for, independent ones at the same time.

    ``train_table`` is written once to the shared folder: every part, the
    statistics and the held-out metrics read that narrow table.
    """

    def __init__(self, train_table: DataFrame, params: TrainParams | None = None):
        from ..sources.files import scratch_path
        self.params, self.spark = params or TrainParams(), train_table.sparkSession
        ship(self.spark)
        path = scratch_path(self.spark, "training-rows")
        rows = train_table.select("shipment_id", "delay_flag", "delay_days", *FEATURES)
        # both splits are stored beside the rows: every pass reads a flag and makes no digest
        rows = stratified_split(rows, test_percent=self.params.test_percent).withColumnRenamed("is_test", "vote_test")
        rows = random_split(rows, test_percent=self.params.test_percent).withColumnRenamed("is_test", "days_test")
        rows.write.parquet(path)
        stored = self.spark.read.parquet(path)
        self.table = stored.drop("vote_test", "days_test")
        self.split = stored.drop("days_test").withColumnRenamed("vote_test", "is_test")
        # Stages 2 and 3 have the delayed rows, with a split of their own (M2)
        self.delayed = Q.delayed_subset(stored.drop("vote_test").withColumnRenamed("days_test", "is_test"))
        self._lock, self._made = RLock(), {}

    def _once(self, name: str, make):
        with self._lock:
            if name not in self._made:
                self._made[name] = make()
            return self._made[name]

    @property
    def model(self) -> DelayModel:
        """Without trees or clusters until ``fit`` has been asked for them."""
        def make():
            train = self.split.where(~F.col("is_test"))
            fitted_stats = A.fit_scaler(train, NUMERIC_FEATURES)  # 25 rows: a literal table carries no lineage
            stats = self.spark.createDataFrame(fitted_stats.collect(), fitted_stats.schema)
            return DelayModel(stats, bin_bounds(train))
        return self._once("model", make)

    def _sample(self, rows: DataFrame) -> DataFrame:
        """At most ``fit_rows`` rows, those with the smallest hashes. For trial runs only: no part is fitted on it.

        Counts by the hash's first 16 bits tell how far they reach, so that
        only about ``fit_rows`` rows are sorted, not as many from each task.
        """
        h = F.xxhash64("shipment_id", F.lit(self.params.seed))
        counts = rows.groupBy(F.shiftright(h, 48).alias("b")).count().orderBy("b").collect()  # at most 65,536 rows
        reach = np.cumsum([r["count"] for r in counts]).searchsorted(self.params.fit_rows)
        if reach < len(counts):
            rows = rows.where(F.shiftright(h, 48) <= counts[reach]["b"])
        return rows.orderBy(h, "shipment_id").limit(self.params.fit_rows)

    def _stored(self, name: str, rows: DataFrame) -> DataFrame:
        from ..sources.files import scratch_path
        path = scratch_path(self.spark, name)
        rows.write.parquet(path)
        return self.spark.read.parquet(path)

    def _rows(self, kind: str) -> tuple[DataFrame, bool]:
        """All binned training rows of a stage, (y, codes), and whether one task may hold them (they then lie in the order of their hashes)."""
        model = self.model

        def make():
            train = (self.split if kind == "vote" else self.delayed).where(~F.col("is_test"))
            one = train.count() <= self.params.fit_rows
            if kind == "reason":
                train = self.clusters().transform(prepare(train, model.stats))
            y = F.col({"vote": "delay_flag", "days": "delay_days", "reason": "cluster"}[kind]).cast("double").alias("y")
            rows = train.select(y, codes_column(model.edges).alias("codes"), F.xxhash64("shipment_id", F.lit(self.params.seed)).alias("h"), "shipment_id")
            rows = rows.repartition(1).sortWithinPartitions("h", "shipment_id") if one else rows
            return self._stored(f"binned-{kind}", rows.select("y", "codes")), one
        return self._once(f"rows-{kind}", make)

    def clusters(self) -> K.Clusters:
        """M9: the restart with the least cost; each pass over all delayed training rows serves all restarts (``clusters``)."""
        model = self.model

        def make():
            p = self.params
            rows = prepare(self.delayed.where(~F.col("is_test")), model.stats).select(K.row_bytes(FEATURE_VECTOR_INPUTS).alias("x"))
            return K.fit(self._stored("cluster-rows", rows), FEATURE_VECTOR_INPUTS, p.kmeans_k, [p.seed + r for r in range(p.kmeans_restarts)])
        model.kmeans = self._once("kmeans", make)
        return model.kmeans

    def _fit_one(self, name: str, settings: B.Settings) -> B.Forest:
        """One part, in one task over all rows of its stage."""
        rows, wanted = self._rows(_kind(name))[0], _wanted(name)

        def run(batches):
            codes, y = [], []
            for batch in batches:
                codes.append(np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1))
                y.append(batch.column("y").to_numpy())
            y = np.concatenate(y) if y else np.zeros(0)
            codes = np.concatenate(codes) if codes else np.zeros((0, 0), np.uint8)
            f = B.fit(codes, y if wanted is None else (y == wanted).astype(float), settings)
            n = len(f.value)
            columns = [pa.array([f.base] * max(n, 1)), pa.array([f.mean] * max(n, 1)), pa.array([f.depth] * max(n, 1), pa.int32()),
                       pa.array(np.isin(np.arange(max(n, 1)), f.roots)), pa.array(np.arange(max(n, 1)) if n else [-1], pa.int32())]
            columns += [pa.array(x if n else [0], t) for x, t in ((f.feature, pa.int32()), (f.bin, pa.int32()), (f.left, pa.int32()), (f.right, pa.int32()), (f.value, pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

        names = ["base", "mean", "depth", "root", "node", "feature", "bin", "left", "right", "value"]
        got = rows.coalesce(1).mapInArrow(run, NODE_SCHEMA.split(", ", 1)[1]).toPandas()
        nodes = got[got.node >= 0].sort_values("node")
        first = got.iloc[0]
        return B.Forest(float(first.base), bool(first["mean"]), int(first.depth), nodes.node[nodes.root].to_numpy(np.int32),
                        *(nodes[c].to_numpy(np.int32) for c in ("feature", "bin", "left", "right")), nodes.value.to_numpy(float))

    def _fit_by_passes(self, kind: str, parts: dict[str, B.Settings]) -> dict[str, B.Forest]:
        """Parts of a stage, in passes over all of its rows."""
        blocks = PS.blocks(self._rows(kind)[0])
        try:
            return PS.fit(blocks, {n: (s, _wanted(n)) for n, s in parts.items()})
        finally:
            blocks.unpersist()

    def _fit_parts(self, parts: dict[str, B.Settings]) -> dict[str, B.Forest]:
        """Each part in a task of its own, or the parts of a stage together in passes; all of them at the same time."""
        alone = {n: s for n, s in parts.items() if self._rows(_kind(n))[1]}
        together: dict[str, dict] = {}
        for n in parts.keys() - alone.keys():
            together.setdefault(_kind(n), {})[n] = parts[n]
        with ThreadPoolExecutor(len(alone) + len(together)) as pool:
            singles = {n: pool.submit(self._fit_one, n, s) for n, s in alone.items()}
            several = [pool.submit(self._fit_by_passes, k, some) for k, some in together.items()]
            found = {n: f.result() for n, f in singles.items()} | {n: f for k in several for n, f in k.result().items()}
        return {n: found[n] for n in parts}

    def fit(self, *outputs: str) -> DelayModel:
        """The model with all parts that ``outputs`` need (see OUTPUTS; cluster: k-means)."""
        model, all_parts = self.model, self.params.tree_parts()
        wanted = {start for o in outputs if o in OUTPUTS for start in OUTPUTS[o]}
        if "reason" in wanted or "cluster" in outputs:
            self.clusters()
        missing = {n: s for n, s in all_parts.items() if n.split("_")[0] in wanted or n in wanted}
        missing = {n: s for n, s in missing.items() if (n if not n.startswith("rf_") else "rf") not in model.forests}
        for kind in sorted({_kind(n) for n in missing}):  # the rows first, so that parts do not wait for each other's
            self._rows(kind)
        if missing:
            found = self._fit_parts(missing)
            lots = [f for n, f in found.items() if n.startswith("rf_")]
            model.forests.update({n: f for n, f in found.items() if not n.startswith("rf_")})
            if lots:
                model.forests["rf"] = B.joined(lots)
        return model

    def metrics(self) -> DataFrame:
        """One row: accuracy and AUC of the vote on the test split, MAE and RMSE of the regressor on the delayed test rows,
        and how often the reason classifier agrees with k-means there."""
        model = self.fit(*OUTPUTS)

        def make():
            scored = self._stored("held-out", model.raw_scores(self.split.where("is_test"), ("p_rf", "p_gbt_a", "p_gbt_b")).select("raw_p", "delay_flag"))
            acc = MT.accuracy(scored.withColumn("yhat", (F.col("raw_p") >= C.DELAY_THRESHOLD).cast("int")), "yhat", "delay_flag")
            auc = MT.roc_auc(scored, "raw_p", "delay_flag")
            late = prepare(self.delayed.where("is_test"), model.stats)
            late = self._stored("held-out-late", model.kmeans.transform(model.raw_scores(late, ("raw_days", "reason_index")))
                                .select("raw_days", "delay_days", "reason_index", F.col("cluster").cast("int").alias("c")))
            err = MT.mae_rmse(late, "raw_days", "delay_days")
            same = MT.accuracy(late, "reason_index", "c").withColumnRenamed("accuracy", "reason_accuracy")
            return self._stored("metrics", acc.crossJoin(auc).crossJoin(err).crossJoin(same))  # one-row frames
        return self._once("metrics", make)


def fit_delay_model(train_table: DataFrame, params: TrainParams | None = None) -> tuple[DelayModel, DataFrame]:
    """Fit all stages on the training split; returns the model and held-out metrics."""
    trainer = DelayTrainer(train_table, params)
    return trainer.fit(*OUTPUTS, "cluster"), trainer.metrics()


# M12 ----------------------------------------------------------------------
def score_shipments(features: DataFrame, model: DelayModel) -> DataFrame:
    """Full scoring: features -> raw outputs -> result record."""
    raw = model.raw_scores(features)
    return score_assemble(raw.select("shipment_id", "raw_p", "raw_days", "reason_index", "vendor_on_time_rate"))
