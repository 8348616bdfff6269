"""Registered model queries.

SQL-expressible parts (splits, encodings, scaling, vote, assembly) carry
an oracle, and so have the counts and domains of all held-out outputs. The
fitted parts are shared by the model queries of one session and data folder.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import expressions as X
from ..models import pipeline as MP
from ..models.assemble import explain_context, score_assemble
from ..operators import enrich as E
from ..operators import quality as Q
from ..schemas import NUMERIC_FEATURES
from ..sources import files as FS
from ..sources import sinks as SK
from ..sources import testdata as td
from .catalog import register
from .expressions_q import _TRAIN_FIX, _TRAIN_SQL, training_table
from .reports_q import _SCALER_SQL

_TRAINERS: dict = {}


def trainer(spark, sf, params: MP.TrainParams | None = None) -> MP.DelayTrainer:
    """The trainer over the training table of ``sf`` (the reference's settings unless given); parts are fitted when first needed."""
    params = params or MP.TrainParams()
    key = (spark.sparkContext.applicationId, sf, repr(params))
    if key not in _TRAINERS:
        _TRAINERS[key] = MP.DelayTrainer(training_table(spark, sf), params)
    return _TRAINERS[key]


def fitted(spark, sf, *outputs: str) -> MP.DelayModel:
    """The model with the parts that ``outputs`` need (all, if none are named)."""
    return trainer(spark, sf).fit(*(outputs or MP.OUTPUTS), *(() if outputs else ("cluster",)))


def _hash_sql(expr: str) -> str:
    return f"(CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT) % 100)"


@register("stratified_split", ["given_scores"],
          f"SELECT shipment_id, delay_flag, {_hash_sql('shipment_id')} < 20 AS is_test FROM given_scores")
def q_stratified_split(spark, sf):
    """M1: reproducible 80/20 split by a hash of the id."""
    return MP.stratified_split(td.given_scores(spark, sf).select("shipment_id", "delay_flag"))


@register("stratified_split_exact", ["given_scores"], """
SELECT shipment_id, delay_flag,
       row_number() OVER (PARTITION BY delay_flag ORDER BY md5(shipment_id), shipment_id)
         <= ceil(count(*) OVER (PARTITION BY delay_flag) * 20 / 100.0) AS is_test
FROM given_scores""")
def q_stratified_split_exact(spark, sf):
    """M1 exact mode: exactly 20 % (rounded up) of each label as test rows."""
    return MP.stratified_split_exact(td.given_scores(spark, sf).select("shipment_id", "delay_flag"))


@register("random_split", ["given_scores"], f"""
SELECT shipment_id, {_hash_sql("'reg:' || shipment_id")} < 20 AS is_test FROM given_scores
WHERE delay_flag = 1 AND delay_days IS NOT NULL AND delay_days > 0""")
def q_random_split(spark, sf):
    """M2: split of the delayed subset, independent of M1."""
    return MP.random_split(Q.delayed_subset(td.given_scores(spark, sf)).select("shipment_id"))


@register("ordinal_encode", ["requests"], """
SELECT shipment_id,
       COALESCE(CASE CASE WHEN l_partkey % 8 <> 0 THEN carrier_type END WHEN 'FTL' THEN 0 WHEN 'LTL' THEN 1
                WHEN 'Intermodal' THEN 2 WHEN 'Ocean' THEN 3 WHEN 'Air' THEN 4 END, -1) AS carrier_type_code,
       COALESCE(CASE priority_level WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2
                WHEN 'CRITICAL' THEN 3 END, -1) AS priority_level_code
FROM requests""")
def q_ordinal_encode(spark, sf):
    """M3: fixed category order, unknown (here: missing carrier) -> -1."""
    r = td.typed_shipments(spark, sf).select(
        "shipment_id", F.when(F.col("l_partkey") % 8 != 0, F.col("carrier_type")).alias("carrier_type"),
        "priority_level")
    return MP.ordinal_encode(r).select("shipment_id", "carrier_type_code", "priority_level_code")


_STD_COLS = ", ".join(f"round((CAST(t.{f} AS DOUBLE) - s_{i}.mean) / s_{i}.std, 6) AS {f}_scaled"
                      for i, f in enumerate(NUMERIC_FEATURES))
_STD_JOINS = " ".join(f"CROSS JOIN (SELECT mean, std FROM stats WHERE feature = '{f}') s_{i}"
                      for i, f in enumerate(NUMERIC_FEATURES))


@register("standardize", _TRAIN_FIX, f"""
WITH train AS ({_TRAIN_SQL}), stats AS ({_SCALER_SQL})
SELECT t.shipment_id, {_STD_COLS} FROM train t {_STD_JOINS}""")
def q_standardize(spark, sf):
    """M4: population-std scaling of the 25 numeric features."""
    from ..operators import aggregates as A
    t = training_table(spark, sf)
    out = MP.standardize(t, A.fit_scaler(t, NUMERIC_FEATURES))
    # fixed output rounding: the mean's last bits depend on summation order
    return out.select("shipment_id", *[F.round(f"{f}_scaled", 6).alias(f"{f}_scaled") for f in NUMERIC_FEATURES])


_M5_CODES = """
COALESCE(CASE t.carrier_type WHEN 'FTL' THEN 0 WHEN 'LTL' THEN 1 WHEN 'Intermodal' THEN 2 WHEN 'Ocean' THEN 3 WHEN 'Air' THEN 4 END, -1),
COALESCE(CASE t.priority_level WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'CRITICAL' THEN 3 END, -1)"""
_M5_SCALED = ", ".join(f"round((CAST(t.{f} AS DOUBLE) - s_{i}.mean) / s_{i}.std, 6)" for i, f in enumerate(NUMERIC_FEATURES))


@register("assemble_features", _TRAIN_FIX, f"""
WITH train AS ({_TRAIN_SQL}), stats AS ({_SCALER_SQL})
SELECT t.shipment_id, CAST([{_M5_SCALED}, {_M5_CODES}] AS DOUBLE[]) AS features FROM train t {_STD_JOINS}""")
def q_assemble_features(spark, sf):
    """M5: 25 scaled + 2 encoded features -> one vector (shown as an array, in the output rounding of M4)."""
    from ..operators import aggregates as A
    t = training_table(spark, sf)
    x = MP.prepare(t, A.fit_scaler(t, NUMERIC_FEATURES))
    return x.select("shipment_id", F.transform(vector_to_array("features"), lambda v: F.round(v, 6)).alias("features"))


_P2 = "CAST((l_partkey * 53) % 1000 AS DOUBLE) / 999.0"
_P3 = "CAST((l_suppkey * 71 + l_linenumber) % 1000 AS DOUBLE) / 999.0"


@register("soft_vote", ["shipments"], f"""
SELECT shipment_id, (CAST((l_partkey * 37) % 1000 AS DOUBLE) / 999.0 + {_P2} + {_P3}) / 3.0 AS raw_p
FROM shipments""")
def q_soft_vote(spark, sf):
    """M7: mean of three members' probabilities (given columns)."""
    sh = td.shipments(spark, sf)
    p1 = (F.col("l_partkey") * 37 % 1000) / 999.0
    p2 = (F.col("l_partkey") * 53 % 1000) / 999.0
    p3 = ((F.col("l_suppkey") * 71 + F.col("l_linenumber")) % 1000) / 999.0
    return sh.select("shipment_id", MP.soft_vote(p1, p2, p3).alias("raw_p"))


@register("reason_labels", ["given_scores"], """
SELECT shipment_id, reason_index, ['WEATHER', 'VENDOR', 'ROUTE', 'CUSTOMS'][reason_index + 1] AS delay_reason
FROM given_scores""")
def q_reason_labels(spark, sf):
    """Cluster index -> reason label."""
    g = td.given_scores(spark, sf)
    return g.select("shipment_id", "reason_index", MP.reason_labels("reason_index").alias("delay_reason"))


def assemble_select(a: str = "g", rate: str = "COALESCE(v.on_time_rate, 0.5)", key: bool = True) -> str:
    """SQL select list of the result record from raw outputs on alias ``a`` and the vendor's rate; ``key``: with the id and rate."""
    return f"""{f"{a}.shipment_id, " if key else ""}{a}.raw_p >= 0.5 AS delay_predicted, {a}.raw_p AS delay_probability,
       greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE),
         CASE WHEN {rate} >= 0.65 THEN {a}.raw_p + -0.1
              WHEN {rate} >= 0.50
                THEN {a}.raw_p + ({rate} - 0.5) / (CAST(0.65 AS DOUBLE) - CAST(0.5 AS DOUBLE)) * -0.1
              ELSE {a}.raw_p + 0.15 END)) AS adjusted_delay_probability,
       CASE WHEN {a}.raw_p >= 0.5 THEN greatest(CAST(0 AS DOUBLE), {X.sql_round_half_even_exact(f'{a}.raw_days', 1)})
            ELSE CAST(0 AS DOUBLE) END AS estimated_delay_days,
       CASE WHEN {a}.raw_p >= 0.5 THEN ['WEATHER', 'VENDOR', 'ROUTE', 'CUSTOMS'][{a}.reason_index + 1] ELSE '' END
         AS delay_reason,
       CASE WHEN {rate} >= 0.65 THEN 'EXCELLENT' WHEN {rate} >= 0.50 THEN 'AVERAGE' ELSE 'POOR' END AS vendor_tier
       {f", {rate} AS vendor_on_time_rate" if key else ""}"""


_ASSEMBLE_SQL = f"""
SELECT {assemble_select("g")}
FROM given_scores g LEFT JOIN vendor_stats v ON v.vendor_name = g.vendor_name"""


def _assembled(spark, sf):
    g = td.given_scores(spark, sf).select("shipment_id", "vendor_name", "raw_p", "raw_days", "reason_index")
    return score_assemble(E.join_vendor(g, td.vendor_stats(spark, sf)))


@register("score_assemble", ["given_scores", "vendor_stats"], _ASSEMBLE_SQL)
def q_score_assemble(spark, sf):
    """Given raw outputs -> result record (threshold, rounding, reason, tier, adjusted p)."""
    return _assembled(spark, sf)


@register("explain_context", ["requests", "vendor_stats", "country_risk", "trade_lanes"], f"""
SELECT {assemble_select("r")},
       COALESCE(cd.lpi_score, 3.0) AS destination_lpi_score,
       CAST(COALESCE(cd.customs_tier, 2) AS INTEGER) AS destination_customs_tier,
       COALESCE(cd.geopolitical_risk, 0.2) AS destination_geopolitical_risk,
       COALESCE(l.avg_customs_days, 2.5) AS lane_avg_customs_days
FROM requests r
LEFT JOIN vendor_stats v ON v.vendor_name = r.vendor_name
LEFT JOIN country_risk cd ON upper(trim(cd.country_code)) = upper(trim(upper(r.destination_country)))
LEFT JOIN trade_lanes l ON upper(trim(l.origin_country)) = upper(trim(upper(r.origin_country)))
                       AND upper(trim(l.destination_country)) = upper(trim(upper(r.destination_country)))""")
def q_explain_context(spark, sf):
    """Result record + destination risk and lane figures, from the same enriched row."""
    from .enrichment import _dims
    feats = E.enrich_shipments(td.typed_shipments(spark, sf), keep=("raw_p", "raw_days", "reason_index"),
                               **_dims(spark, sf))
    return explain_context(feats)


# fitting and scoring (rows-only) ------------------------------------------------
_VOTERS = ("p_rf", "p_gbt_a", "p_gbt_b")


@register("train_delay_classifier")
def q_train_delay_classifier(spark, sf):
    """M6: members' and voted P(delay) on the held-out split."""
    model = fitted(spark, sf, *_VOTERS)
    return model.raw_scores(trainer(spark, sf).split.where("is_test"), _VOTERS).select("shipment_id", "delay_flag", *_VOTERS, "raw_p")


@register("train_delay_regressor")
def q_train_delay_regressor(spark, sf):
    """M8: predicted delay days on the held-out delayed rows."""
    model = fitted(spark, sf, "raw_days")
    return model.raw_scores(trainer(spark, sf).delayed.where("is_test"), ("raw_days",)).select("shipment_id", "delay_days", "raw_days")


@register("cluster_reasons")
def q_cluster_reasons(spark, sf):
    """M9: k-means cluster of every delayed row (best of the restarts)."""
    model = fitted(spark, sf, "cluster")
    d = MP.prepare(trainer(spark, sf).delayed, model.stats)
    return model.kmeans.transform(d).select("shipment_id", F.col("cluster").cast("int").alias("cluster"))


@register("train_reason_classifier")
def q_train_reason_classifier(spark, sf):
    """Reason classifier against k-means labels on the held-out delayed rows."""
    model = fitted(spark, sf, "reason_index", "cluster")
    d = MP.prepare(trainer(spark, sf).delayed.where("is_test"), model.stats)
    s = model.kmeans.transform(model.raw_scores(d, ("reason_index",)))
    return s.select("shipment_id", F.col("cluster").cast("int").alias("cluster"), "reason_index", MP.reason_labels("reason_index").alias("delay_reason"))


@register("held_out_domains", _TRAIN_FIX, f"""
WITH t AS ({_TRAIN_SQL}),
v AS (SELECT * FROM t WHERE {{vote}} < 20),
d AS (SELECT * FROM t WHERE delay_flag = 1 AND delay_days IS NOT NULL AND delay_days > 0 AND {{days}} < 20)
SELECT (SELECT count(*) FROM v) AS vote_rows, (SELECT count(*) FROM v) AS probabilities, (SELECT count(*) FROM v) AS votes,
       (SELECT count(*) FROM d) AS late_rows, (SELECT count(*) FROM d) AS days, (SELECT count(*) FROM d) AS reasons,
       true AS better_than_chance, true AS better_than_mean""".replace(
    "{vote}", "(CAST(('0x' || substr(md5(shipment_id), 1, 8)) AS BIGINT) % 100)").replace(
    "{days}", "(CAST(('0x' || substr(md5('reg:' || shipment_id), 1, 8)) AS BIGINT) % 100)"))
def q_held_out_domains(spark, sf):
    """Over all held-out rows, how many outputs lie in their domains (every one must), that each vote is its
    members' mean, and that vote and regressor beat the best constant (AUC above a half, RMSE below the days' deviation)."""
    model, t = fitted(spark, sf), trainer(spark, sf)
    v = model.raw_scores(t.split.where("is_test"), _VOTERS)
    inside = F.lit(True)
    for p in _VOTERS:
        inside = inside & F.col(p).between(0, 1)
    votes = v.agg(F.count("*").alias("vote_rows"), F.count_if(inside).alias("probabilities"),
                  F.count_if(F.abs(F.col("raw_p") - (F.col("p_rf") + F.col("p_gbt_a") + F.col("p_gbt_b")) / 3) < 1e-12).alias("votes"))
    d = model.raw_scores(t.delayed.where("is_test"), ("raw_days", "reason_index"))
    late = d.agg(F.count("*").alias("late_rows"), F.count_if(F.col("raw_days").between(-1e6, 1e6)).alias("days"),
                 F.count_if(F.col("reason_index").between(0, len(C.REASON_LABELS) - 1)).alias("reasons"),
                 F.stddev_pop("delay_days").alias("spread"))
    m = t.metrics()
    return votes.crossJoin(late).crossJoin(m).select(  # one-row frames
        "vote_rows", "probabilities", "votes", "late_rows", "days", "reasons",
        (F.col("auc") > 0.5).alias("better_than_chance"), (F.col("rmse") < F.col("spread")).alias("better_than_mean"))


def _scoring_features(spark, sf):
    from .enrichment import q_enrich_shipments
    return q_enrich_shipments(spark, sf)


@register("score_shipments")
def q_score_shipments(spark, sf):
    """Enrich -> encode/scale -> vote -> days -> reason -> tier adjustment, every shipment."""
    model = fitted(spark, sf)
    return MP.score_shipments(_scoring_features(spark, sf), model)


@register("model_save_load")
def q_model_save_load(spark, sf):
    """Save all fitted parts, load them back, score with the loaded model."""
    model = fitted(spark, sf)
    path = FS.scratch_path(spark, "delay-model")
    model.save(path)
    return MP.score_shipments(_scoring_features(spark, sf), MP.DelayModel.load(spark, path))


@register("batch_predict")
def q_batch_predict(spark, sf):
    """Q2: validate -> enrich valid rows -> score -> append to the log -> read the log back."""
    from .enrichment import _dims
    from .reports_q import AS_OF
    model = fitted(spark, sf)
    checked = Q.validate_shipments(td.typed_shipments(spark, sf), AS_OF)
    valid = checked.where("is_valid").drop("errors", "is_valid")
    feats = E.enrich_shipments(valid, sanitize_vendor_key=True, **_dims(spark, sf, sanitize_vendor_key=True))
    scored = MP.score_shipments(feats, model)
    path = FS.scratch_path(spark, "batch-log")
    SK.append_prediction_log(scored, path)
    return spark.read.parquet(path)


@register("train_pipeline")
def q_train_pipeline(spark, sf):
    """Q5: raw orders -> training table -> all stages -> held-out metrics (one row)."""
    return trainer(spark, sf).metrics().withColumn("delay_threshold", F.lit(C.DELAY_THRESHOLD))
