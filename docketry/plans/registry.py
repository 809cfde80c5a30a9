"""All query modules of the core."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

import docketry.plans as plans


def modules() -> list:
    """The modules ``docketry.plans.q_*``; each has QUERIES and ORACLE."""
    names = sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("q_"))
    return [importlib.import_module(f"docketry.plans.{n}") for n in names]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: keyword rank and vector rank fused by reciprocal ranks."""
    for m in modules():
        if hasattr(m, "flagship"):
            return m.flagship(spark, sf_dir)
    raise LookupError("no flagship query")
