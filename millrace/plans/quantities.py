"""Queries of problem 6: quantities in common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import units
from millrace.runtime import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.stated_quantities(table(spark, sf_dir, "problems"), table(spark, sf_dir, "unit_defs"))


def p6_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows with a number, with units assigned where none is stated, and what is uncertain flagged."""
    rows = units.common_quantities(units.problem_records(table(spark, sf_dir, "problems")), table(spark, sf_dir, "unit_defs"))
    return rows.select(F.col("id").alias("problem_id"), "dimension", "unit", "stated_in", "status", "common_unit", units.scientific(F.col("common_value")).alias("common_value"), F.round("posterior", 6).alias("posterior"))


QUERIES = {"p6_found": p6_found, "p6_quantities": p6_quantities}
ORACLE: dict[str, str] = {}
