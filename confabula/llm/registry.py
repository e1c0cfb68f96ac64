"""The queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op11_token_alignment
from .decontamination import op6_decontamination, op6_sql
from .language_id import op8_language_id
from .near_dedup import op9_near_dedup
from .packing import op10_packing
from .quality_pu import op4_quality_classifier
from .quality_rules import op7_quality_rules, op7_sql
from .sharding import op2_sharding, op2_sql
from .simhash import op13_simhash
from .suffix_dedup import op5_suffix_dedup
from .token_output import op1_token_output
from .toxicity import op3_toxicity
from .vector_codes import op12_sql, op12_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_near_dedup": op9_near_dedup,
    "op10_packing": op10_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_vector_codes": op12_vector_codes,
    "op13_simhash": op13_simhash,
}
ORACLE_SQL: dict[str, str] = {
    "op2_sharding": op2_sql(),
    "op6_decontamination": op6_sql(),
    "op7_quality_rules": op7_sql(),
    "op12_vector_codes": op12_sql(),
}
