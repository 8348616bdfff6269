"""Names of the registered queries, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op3_bpe_round_trip
from .chat import op9_chat_format
from .embedding_dedup import op8_embedding_near_dedup
from .license_scan import op5_license_scan
from .merkle import op13_merkle_manifest
from .oracles import ORACLE  # noqa: F401
from .packing import op2_best_fit_packing
from .records import op10_token_records
from .repair import op12_conversation_repair
from .secret_scan import op6_secret_scan
from .simhash import op7_simhash_near_dedup
from .token_counts import op11_token_counts
from .topk import op4_exact_top_k
from .toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_best_fit_packing, op3_bpe_round_trip, op4_exact_top_k, op5_license_scan,
                            op6_secret_scan, op7_simhash_near_dedup, op8_embedding_near_dedup, op9_chat_format, op10_token_records, op11_token_counts,
                            op12_conversation_repair, op13_merkle_manifest)}
