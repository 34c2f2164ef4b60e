"""The subpackage's queries and their SQL."""

from __future__ import annotations

import corpus_pipeline
from textloom.llm import op1_pii, op2_language, op3_warc, op4_minhash, op5_suffix, op6_secrets, op7_decontaminate, op8_toxicity, op9_mixing, op10_quality, op11_tokens, op12_manifest, op13_spelling

OPERATORS = (op1_pii, op2_language, op3_warc, op4_minhash, op5_suffix, op6_secrets, op7_decontaminate, op8_toxicity, op9_mixing, op10_quality, op11_tokens, op12_manifest, op13_spelling)
MODULES = {m.__name__.rpartition(".")[2]: m for m in OPERATORS}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in MODULES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in MODULES.items() if hasattr(module, "ORACLE_SQL")}
