"""All queries of the review engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opinara.plans import mapped, parsed, relational, roundtrips, textual, workflow

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return relational.QUERIES | textual.QUERIES | parsed.QUERIES | workflow.QUERIES | mapped.QUERIES | roundtrips.QUERIES


def oracle_sql() -> dict[str, str]:
    return relational.ORACLES | textual.ORACLES | parsed.ORACLES | workflow.ORACLES | mapped.ORACLES | roundtrips.ORACLES
