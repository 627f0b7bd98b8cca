"""All queries over the driver's tables, and the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamella.plans import files, measures, skeletons, structures, voxelwise  # noqa: F401 (each puts its queries into the registry)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return dict(measures.REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(measures.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.element_fraction(spark, sf_dir)
