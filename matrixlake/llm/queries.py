"""The queries of the text operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import importlib

#: query name -> module; each has query(spark, sf_dir) and may have ORACLE_SQL
MODULES = {
    "op1_packing": "packing",
    "op2_decontamination": "decontamination",
    "op3_minhash_near_dedup": "near_dedup",
    "op4_ppm_score": "ppm",
    "op5_lossless_webp": "webp_columns",
    "op6_language_mixture": "language_id",
    "op7_chat_snapshots": "chat_format",
    "op8_toxicity_gbt": "toxicity",
    "op9_substring_dedup": "substring_dedup",
    "op10_pii_disclosure": "pii",
}


def _module(name: str):
    return importlib.import_module(f"matrixlake.llm.{name}")


def queries() -> dict:
    return {name: _module(m).query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, m in MODULES.items() if (sql := getattr(_module(m), "ORACLE_SQL", None))}
