"""Shipment-delay risk analytics as composable Spark DataFrame operators.

Modules:
  functions.expressions  scalar rules as Column functions (no session, no action)
  functions.text         explanation prompt text
  operators.enrich       dimension lookups and the scoring-path enrichment
  operators.training     raw orders -> labelled training table
  operators.quality      keep-first, checks, request validation, filters
  operators.aggregates   counts, ranges, scaler statistics, class weights, stats tables
  operators.metrics      accuracy, exact AUC, MAE/RMSE
  operators.prefix       distributed running totals over a global order
  operators.sequence     ordered per-key steps that survive a hot key
  operators.weather      payload explode, backfill plan, ingest
  operators.geo          city lookup, sea lanes, polylines, route geometry
  operators.monitor      monitoring jobs (batch)
  models.pipeline        three-stage MLlib model: splits, scaling, fit, save/load, scoring
  models.assemble        result record and explanation context
  sources.files          CSV / JSON sources, seeding;  sources.sinks: prediction log, weather appends
  streaming.jobs         Structured Streaming forms
  plans                  registered queries with their DuckDB oracle SQL
"""

__all__ = ["session", "constants", "schemas"]
