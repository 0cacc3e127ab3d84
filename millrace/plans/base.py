"""Shared inputs of the queries and the rounding that both engines agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.runtime import table

SAMPLE_COLUMNS = ("sample_index", "group_index", "rollout_id", "source", "response_length", "status", "reward")


def r6(c: Column | str) -> Column:
    """Six digits; -0.0 becomes 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def r6_scaled(c: Column | str) -> Column:
    """Six digits as DuckDB rounds: of the product with 1e6, not of the shortest decimal form; they differ by ties alone."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6) / 1e6 + F.lit(0.0)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples once each (rows delivered again are equal rows)."""
    return table(spark, sf_dir, "samples").select(*SAMPLE_COLUMNS).distinct()


#: The same in SQL, as the body of a common table expression named s.
S = "s AS (SELECT DISTINCT sample_index, group_index, rollout_id, source, response_length, status, reward FROM samples)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with output as aligned arrays: old (rollout), new (train) and ref log-probabilities, mask, advantage, reward.

    Only one policy's log-probabilities are in the tables; the others are fixed functions of them.
    """
    t = table(spark, sf_dir, "turns").select("session_id", "turn", "output_log_probs").distinct()
    t = t.where("session_id is not null and turn is not null and size(output_log_probs) > 0")
    old = F.col("output_log_probs")
    mask = F.transform(old, lambda x, i: F.when((i + 1) % 4 == 3, 0.0).otherwise(1.0))
    adv = (F.col("turn") % 3 - 1).cast("double") * 0.5137733 + 0.2531177
    return t.select(
        "session_id", "turn", old.alias("old"),
        F.transform(old, lambda x, i: x * 0.9137129 - 0.01137731 * ((i + 1) % 5)).alias("new"),
        F.transform(old, lambda x: x * 0.80713577).alias("ref"),
        mask.alias("mask"), F.transform(old, lambda _: adv).alias("adv"), ((F.col("turn") + 1) / 4.0713579).cast("double").alias("reward"),
    )


#: The same in SQL, a row per token.
TOK = """t AS (SELECT DISTINCT session_id, turn, output_log_probs FROM turns WHERE session_id IS NOT NULL AND turn IS NOT NULL AND len(output_log_probs) > 0),
u AS (SELECT session_id, turn, len(output_log_probs) AS n, unnest(output_log_probs) AS old, generate_subscripts(output_log_probs, 1) AS pos FROM t),
tok AS (SELECT session_id, turn, n, pos, old, old * 0.9137129 - 0.01137731 * (pos % 5) AS new, old * 0.80713577 AS ref, CASE WHEN pos % 4 = 3 THEN 0.0 ELSE 1.0 END AS mask,
 CAST(turn % 3 - 1 AS DOUBLE) * 0.5137733 + 0.2531177 AS adv, CAST((turn + 1) / 4.0713579 AS DOUBLE) AS reward FROM u)"""


def log10_sql(x: str) -> str:
    """log10 of a positive decimal number in a text ``x``, in SQL; null for anything else."""
    number = f"TRY_CAST(replace(trim({x}), ',', '') AS DOUBLE)"
    form = r"\s*\+?((\d{1,3}(,\d{3})+|\d+)(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*"
    return f"CASE WHEN regexp_full_match({x}, '{form}') AND {number} > 0 THEN log10({number}) END"
