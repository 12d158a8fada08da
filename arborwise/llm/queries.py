"""Queries of the training-data operators: one op<N>_<name> each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, cotraining, cover_tree, lsh_forest, maxent, merkle, mixing, packing, substring_dedup, url_filter

MODULES = {
    "op1_cover_tree": cover_tree,
    "op2_substring_dedup": substring_dedup,
    "op3_chat_format": chat_format,
    "op4_url_filter": url_filter,
    "op5_cotraining": cotraining,
    "op6_mixing": mixing,
    "op7_packing": packing,
    "op8_maxent": maxent,
    "op9_lsh_forest": lsh_forest,
    "op10_merkle": merkle,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.digest for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, module in MODULES.items() if (sql := getattr(module, "SQL", None))}
