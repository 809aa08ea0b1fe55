"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("pages", "programs", "bank", "sequences", "streams", "store")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable] = {}
    for fam in FAMILIES:
        out.update(importlib.import_module(f"{__package__}.{fam}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for fam in FAMILIES:
        out.update(importlib.import_module(f"{__package__}.{fam}_sql").sql())
    return out
