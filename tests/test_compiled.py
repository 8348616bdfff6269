"""Steps whose generated methods must stay short enough to be compiled (8,000 bytes), with the results of the plain forms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _longest_method(df) -> int:
    sizes = []
    stages = df._jdf.queryExecution().debug().codegenToSeq().iterator()
    while stages.hasNext():
        sizes.append(stages.next()._3().maxMethodCodeSize())
    return max(sizes, default=0)


def test_prompt_is_compiled_and_reads_as_before(spark):
    from shiprisk.functions import text as TX
    names = ["shipment_id", "origin_city", "origin_country", "destination_city", "destination_country", "vendor_name", "carrier_type",
             "priority_level", "vendor_tier", "delay_reason"]
    numbers = ["distance_km", "weather_risk_score", "vendor_on_time_rate", "destination_lpi_score", "destination_geopolitical_risk",
               "lane_avg_customs_days", "estimated_delay_days", "adjusted_delay_probability"]
    schema = ", ".join([*(f"{n} string" for n in names), *(f"{n} double" for n in numbers),
                        "planned_transit_days int, destination_customs_tier int, is_hazmat int, delay_predicted boolean, language string"])
    odd = [(x,) * 8 for x in (0.125, 0.5, 2.675, -0.004, 1e17, 1e300, INF, NAN, 0.0, None)]
    rows = [tuple("a-b c" if i % 2 else " V#1é\t" for i in range(10)) + x + (3, 2, 1, True, "French") for x in odd]
    rows.append((None,) * 10 + (None,) * 8 + (None, None, None, None, None))
    df = spark.createDataFrame(rows, schema)
    got = df.select(TX.explain_prompt(F.col("language")).alias("p"))
    assert _longest_method(df.repartition(2).select(TX.explain_prompt(F.col("language")).alias("p"))) < 8000
    texts = [r.p for r in got.collect()]
    assert texts[0].split("\n")[0] == "Shipment V1 from a-b c, V1 to a-b c, V1 via vendor a-b c."
    assert "Weather risk score: 0.12. Hazmat: True." in texts[0] and texts[0].endswith("in the French language.")
    assert texts[-1].startswith("Shipment null from null, null to null, null via vendor null.\nCarrier type: null. Distance: null km.")
    assert "Weather risk score: nu. Hazmat: False. Priority: null." in texts[-1]  # the formatter cuts null to the places
    for d in (1, 2):
        from shiprisk.functions.expressions import round_half_even_exact
        both = df.select(TX.fixed_places(F.col("distance_km"), d).alias("a"), F.format_string(f"%.{d}f", round_half_even_exact("distance_km", d)).alias("b")).collect()
        assert [r.a for r in both] == [r.b for r in both]


def test_rounding_on_the_exact_value_is_pythons(spark):
    from shiprisk.functions.expressions import round_half_even_exact
    values = [0.125, 0.375, 2.675, 0.18055, 1.005, -0.125, -2.5, 0.5, 1.5, 1e9 + 0.5, 7.0, -0.3]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    for d in (0, 1, 2, 4):
        got = [r.y for r in df.select(round_half_even_exact("x", d).alias("y")).collect()]
        assert got == [round(v, d) + 0.0 for v in values] + [None]


def test_clean_text_and_other_text_are_sanitized_alike(spark):
    from shiprisk.functions.expressions import sanitize_text
    texts = ["abc_1-x", "a b", " a", "a ", "a\tb", " a ", "A#1", "", "  ", "x\n", "été", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace(F.regexp_replace("t", r"(?U)[^A-Za-z0-9\s_\-]", ""), r"(?U)^\s+|\s+$", "")
    for r in df.select(sanitize_text("t").alias("a"), plain.alias("b")).collect():
        assert r.a == r.b


def test_scaler_is_compiled_and_keeps_every_feature(spark):
    from shiprisk.operators import aggregates as A
    names = [f"f{i}" for i in range(25)]
    df = spark.range(100).select(*[((F.col("id") * (i + 1)) % 7 if i else F.lit(3)).alias(n) for i, n in enumerate(names)]).repartition(3)
    stats = A.fit_scaler(df, names)
    assert _longest_method(stats) < 8000
    found = {r.feature: (r["mean"], r["std"]) for r in stats.collect()}
    assert list(found) and len(found) == 25 and found["f0"] == (3.0, 1.0)
    x = [(i * 3) % 7 for i in range(100)]
    m = sum(x) / 100
    assert math.isclose(found["f2"][0], m) and math.isclose(found["f2"][1], math.sqrt(sum((v - m) ** 2 for v in x) / 100))
    assert {(r.feature, r["mean"], r["std"]) for r in A.fit_scaler(df.limit(0), names).collect()} == {(n, None, None) for n in names}


def test_training_passes_read_a_stored_split(spark):
    """A pass over the training rows makes no digest of the ids; the flags are those of the split functions."""
    from shiprisk.models import pipeline as MP
    numbers = [F.lit(1.0).alias(f) for f in MP.NUMERIC_FEATURES]
    rows = spark.range(500).select(F.concat(F.lit("s"), "id").alias("shipment_id"), (F.col("id") % 2).cast("int").alias("delay_flag"),
                                   (F.col("id") % 2).cast("double").alias("delay_days"), *numbers, F.lit("FTL").alias("carrier_type"),
                                   F.lit("LOW").alias("priority_level"))
    t = MP.DelayTrainer(rows)
    for df, split in ((t.split, MP.stratified_split(rows)), (t.delayed, MP.random_split(rows.where("delay_flag = 1")))):
        assert "md5" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert {(r.shipment_id, r.is_test) for r in df.collect()} == {(r.shipment_id, r.is_test) for r in split.collect()}
