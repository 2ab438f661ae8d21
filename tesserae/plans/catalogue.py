"""All queries of the core, gathered from the modules of this folder; each has its Spark plan and, where SQL can say it, its SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import tesserae.plans

Query = Callable[[SparkSession, str], DataFrame]


def _gathered(what: str) -> dict:
    found: dict = {}
    for module in pkgutil.iter_modules(tesserae.plans.__path__):
        if module.name.startswith("q_"):
            found |= getattr(importlib.import_module(f"tesserae.plans.{module.name}"), what, {})
    return found


def queries() -> dict[str, Query]:
    return _gathered("QUERIES")


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in _gathered("SQL").items() if k in queries()}
