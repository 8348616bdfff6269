"""Explanation prompt text (P20), one concatenation per row.

Only the prompt column is produced; sending it to a language model is an
external call and not part of the engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .expressions import round_half_even_exact, sanitize_text

# FIXED VALUES: the prompt lines, in order; each {} takes the next value.
PROMPT_LINES = [
    "Shipment {} from {}, {} to {}, {} via vendor {}.",
    "Carrier type: {}. Distance: {} km. Planned transit: {} days.",
    "Weather risk score: {}. Hazmat: {}. Priority: {}.",
    "Vendor on-time rate: {}%. Vendor tier: {}.",
    "Cross-border context: Destination LPI Score is {}/5.0. Customs Tier: {}/4. Geopolitical Risk: {}. "
    "Historical avg customs delay for this lane: {} days.",
    "ML prediction - delay: {}. Estimated delay: {} days. Reason category: {}.",
    "Adjusted delay probability: {}%.",
    "In 2 to 4 sentences, explain why this shipment is predicted to {} and what the supply chain manager should "
    "do about it, specifically addressing any customs or geopolitical risks if applicable.",
    "IMPORTANT: You MUST write your explanation in the {} language.",
]
STATUS_DELAYED, STATUS_ON_TIME = "be delayed", "arrive on time"


def _bool_text(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), F.lit("True")).otherwise(F.lit("False"))


def prompt_language(lang: Column) -> Column:
    return F.when(lang.isin(*C.PROMPT_LANGUAGES), lang).otherwise(F.lit("English"))


def fixed_places(x: Column, digits: int) -> Column:
    """``x`` rounded half-even to ``digits`` places, as text with all of them.

    The decimal's text is what the formatter gives and is made much faster;
    what no decimal holds (null, NaN, infinite or huge) goes to the formatter.
    """
    v = round_half_even_exact(x, digits)  # the formatter alone rounds ties up
    return F.coalesce(v.try_cast(f"decimal(18,{digits})").cast("string"), F.format_string(f"%.{digits}f", v))


def explain_prompt(language: Column) -> Column:
    """Prompt text from the result record, request and context columns of the row; a null value reads "null"."""
    s = sanitize_text
    values = [
        s("shipment_id"), s("origin_city"), s("origin_country"), s("destination_city"), s("destination_country"), s("vendor_name"),
        s("carrier_type"), F.col("distance_km").cast("string"), F.col("planned_transit_days").cast("string"),
        fixed_places(F.col("weather_risk_score"), 2), _bool_text(F.col("is_hazmat").cast("boolean")), s("priority_level"),
        fixed_places(F.col("vendor_on_time_rate") * 100, 1), s("vendor_tier"),
        fixed_places(F.col("destination_lpi_score"), 1), F.col("destination_customs_tier").cast("string"),
        fixed_places(F.col("destination_geopolitical_risk"), 2), fixed_places(F.col("lane_avg_customs_days"), 1),
        _bool_text(F.col("delay_predicted")), F.col("estimated_delay_days").cast("string"), s("delay_reason"),
        fixed_places(F.col("adjusted_delay_probability") * 100, 1),
        F.when(F.col("delay_predicted"), F.lit(STATUS_DELAYED)).otherwise(F.lit(STATUS_ON_TIME)),
        prompt_language(language),
    ]
    *texts, last = "\n".join(PROMPT_LINES).split("{}")
    # zip_with has no generated code of its own, so Spark evaluates this projection apart from the joins below it, in
    # many short methods: as a part of theirs it made one over 8,000 bytes, which HotSpot interprets and never compiles.
    pieces = F.zip_with(F.array(*map(F.lit, texts)), F.array(*values), lambda text, value: F.concat(text, F.coalesce(value, F.lit("null"))))
    return F.concat(F.array_join(pieces, ""), F.lit(last))
