"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this folder with ``QUERIES`` (name to function of a session and a folder) and, where SQL serves, ``ORACLES``.
MODULES = ("q_warc", "q_rarefeatures", "q_packing", "q_cotraining", "q_mixing", "q_langid", "q_simhash", "q_secretscan", "q_covertree", "q_tokencount")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"trawl.llm.{name}").QUERIES
    import corpus_pipeline

    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"trawl.llm.{name}"), "ORACLES", {})
    return found
