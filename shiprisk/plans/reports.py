"""User-facing reports (Q1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators.enrich import _norm, _unique


def country_risk_report(asked: DataFrame, risk: DataFrame, code: str = "code", strict_case: bool = False) -> DataFrame:
    """Q1: one row per requested country code found in the risk table.

    Codes are upper-cased before the lookup; an unknown code gives no row
    (inner join). The table's key is normalised in the same way, unless
    ``strict_case`` takes it as stored.
    """
    q = asked.select(X.upper_country(F.col(code)).alias("country_code")).distinct()
    key = _norm(F.col("country_code"), strict_case)
    j = q.select(key.alias("country_code")).distinct().join(_unique(risk.withColumn("country_code", key), ["country_code"]), "country_code")
    s = X.country_risk_score("lpi_score", "customs_tier", "geopolitical_risk", "port_congestion")
    return j.select("country_code", "lpi_score", "customs_tier", "geopolitical_risk", "port_congestion",
                    X.country_risk_category(s).alias("risk_category"))
