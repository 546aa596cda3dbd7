"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeline.plans import code, evaluation, search
from treeline.plans.reference_sql import SQL

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: query
    for module in (code, search, evaluation)
    for name, query in sorted(vars(module).items())
    if name[0] == "q" and name[1:3].isdigit()
}
