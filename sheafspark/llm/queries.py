"""The registered queries of the training-data operators, and the SQL that states their results where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query and the module of this subpackage that has it.
MODULES = {
    "op1_warc": "warc",
    "op7_order_minhash": "order_minhash",
    "op8_chat": "chat",
    "op2_substrings": "substrings",
    "op5_quality_model": "quality_model",
    "op6_simhash": "simhash",
    "op10_bpe": "bpe",
    "op3_mixing": "mixing",
    "op4_secrets": "secrets",
    "op9_quality_rules": "quality_rules",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: importlib.import_module(f"sheafspark.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"sheafspark.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {k: v for k, v in found.items() if v}
