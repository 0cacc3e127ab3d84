"""Forecast data set: questions joined to their resolutions, deduplicated, split by time and by family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import splits
from millrace.operators.transforms import expand_dates

QUESTIONS = "forecast_due_date string, questions array<struct<id string, source string, question string, background string, source_intro string, resolution_dates string, freeze_datetime string, freeze_datetime_value string>>"
RESOLUTIONS = "question_set string, resolutions array<struct<id string, source string, direction string, resolution_date string, resolved_to double, resolved boolean>>"


def simple_id(c: Column) -> Column:
    """Composite ids (arrays) come as JSON text and are not simple."""
    return c.isNotNull() & ~F.trim(c).startswith("[")


def freeze_value(c: Column) -> Column:
    return F.when(~c.isin("", "N/A"), c)


def candidates(questions: DataFrame, resolutions: DataFrame, cutoff: str) -> DataFrame:
    """Resolved binary instances after the cutoff: an equi-join on (round, source, id).

    Cheap predicates come before the join. A key that is twice among a round's questions, or a resolution
    date that a multi-horizon question doesn't name, fails the job.
    """
    q = questions.where(F.assert_true(F.col("forecast_due_date") == F.col("round"), F.lit("a file's date differs from its content")).isNull())
    q = q.select("round", F.explode("questions").alias("q")).select("round", "q.*").where(simple_id(F.col("id")))
    q = q.groupBy("round", "source", "id").agg(F.count("*").alias("_n"), F.first(F.struct("question", "background", "source_intro", "resolution_dates", "freeze_datetime", "freeze_datetime_value")).alias("q"))
    q = q.where(F.assert_true(F.col("_n") == 1, F.lit("a question key is twice in a round")).isNull()).select("round", "source", "id", "q.*")
    r = resolutions.select("round", F.explode("resolutions").alias("r")).select("round", "r.*")
    r = r.where(simple_id(F.col("id")) & F.col("resolved") & F.col("resolved_to").isin(0.0, 1.0) & F.col("direction").isNull() & (F.to_date("resolution_date") > F.lit(cutoff).cast("date")))
    joined = r.join(q, ["round", "source", "id"])
    multi = F.trim("resolution_dates").startswith("[")
    joined = joined.where(F.assert_true(~multi | F.contains("resolution_dates", "resolution_date"), F.lit("a resolution date is not declared")).isNull())
    text = lambda c: expand_dates(F.coalesce(F.col(c), F.lit("")), F.col("round"), F.col("resolution_date"))
    key = F.when(multi, F.concat_ws("|", F.lit("multi_horizon"), "source", "id", "round", "resolution_date")).otherwise(F.concat_ws("|", F.lit("single_event"), "source", "id"))
    return joined.select("id", "source", text("question").alias("question"), text("background").alias("background"), freeze_value(F.col("freeze_datetime_value")).alias("freeze_value"), text("source_intro").alias("source_intro"), F.col("resolved_to").cast("tinyint").alias("resolved_value"), F.to_date("resolution_date").alias("resolved_date"), F.col("round"), F.to_timestamp("freeze_datetime").alias("freeze_at"), key.alias("instance_key"))


def earliest(rows: DataFrame) -> DataFrame:
    """One row per instance: the earliest; instances with different values fail the job."""
    agreed = rows.groupBy("instance_key").agg(F.count_distinct("resolved_value").alias("_v"))
    checked = rows.join(agreed, "instance_key").where(F.assert_true(F.col("_v") == 1, F.lit("an instance has two values")).isNull()).drop("_v")
    return splits.first_wins(checked, ["instance_key"], ["round", "freeze_at", "resolved_date", "source", "id", "question"])


def split(rows: DataFrame, later: int, family_rows: int, seed: int) -> DataFrame:
    """``part`` of each row: eval_time after the time cut, eval_event for held-out families (source, id), else train."""
    cut = splits.time_cut(rows, "resolved_date", later)
    dated = rows.join(F.broadcast(cut)).withColumn("family", F.concat_ws("|", "source", "id")).withColumn("_late", F.coalesce(F.col("resolved_date") > F.col("cut"), F.lit(False)))
    families = splits.family_split(dated.where("not _late"), "family", family_rows, seed).select("family", F.col("part").alias("_part"))
    part = F.when(F.col("_late"), "eval_time").when(F.col("_part") == "eval", "eval_event").otherwise("train")
    # late rows of held-out families stay in the time split, train families' rows never reach eval_event
    return dated.join(families, "family", "left").withColumn("part", part).drop("_late", "_part", "cut")
