"""Group and row filters. Each drops rows by a predicate of the row or of its group; null keys form one group."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.transforms import word_count
from millrace.runtime import bounded_broadcast


def nonzero_std(df: DataFrame, group: str = "group_index", reward: str = "reward", least: float = 1e-6) -> DataFrame:
    """Rows of groups whose sample deviation exceeds ``least``; singletons (no deviation) are dropped."""
    return df.withColumn("_sd", F.stddev_samp(reward).over(Window.partitionBy(group))).where(F.col("_sd") > least).drop("_sd")


def group_filter(df: DataFrame, group: str, keep: Column) -> DataFrame:
    """Rows of groups for which an aggregate predicate holds."""
    good = df.groupBy(group).agg(keep.alias("_keep")).where("_keep").select(group)
    return df.join(good, group, "left_semi")


def group_sizes(df: DataFrame, group: str, least: int) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def short_enough(df: DataFrame, text: str, most: int, strict: bool = False) -> DataFrame:
    """Rows of at most ``most`` words; ``strict`` raises on a longer one when it is met."""
    n = word_count(F.col(text))
    if strict:
        return df.where(F.assert_true(n <= most, F.lit(f"a text has more than {most} words")).isNull())
    return df.where(n <= most)


def first_n(df: DataFrame, n: int, order: Iterable[str]) -> DataFrame:
    """The first n rows in an order (a top-k, never a full sort in one task)."""
    return df.orderBy(*order).limit(n)


def newest_groups(df: DataFrame, group: str, at: str, n: int) -> DataFrame:
    """Rows of the n groups with the latest time; a group without a time counts as oldest."""
    newest = df.groupBy(group).agg(F.max(at).alias("_at")).orderBy(F.col("_at").desc_nulls_last(), group).limit(n).select(group)
    return df.join(bounded_broadcast(newest), group, "left_semi")


def popped(df: DataFrame, n: int, order: Iterable[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(first n rows of a buffer, the rest)."""
    head = first_n(df, n, order)
    return head, df.join(head.select(key), key, "left_anti")


def graded_where_missing(reward: Column, grade: Column) -> Column:
    return F.when(reward.isNull(), grade).otherwise(reward)


def required(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fails when a row misses a required value."""
    out = df
    for c in columns:
        out = out.where(F.assert_true(F.col(c).isNotNull(), F.lit(f"{c} is missing")).isNull())
    return out


def unique(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Violations of uniqueness: keys with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def off_policy_masked(mask: Column, prior: Column) -> Column:
    """The first ``prior`` tokens, made by an older policy, are masked."""
    return F.transform(mask, lambda m, i: F.when(i < prior, F.lit(0).cast("double")).otherwise(m.cast("double")))


def web_links(url: Column, unwanted: Iterable[str] = ("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "zip", "jpg", "png", "gif", "mp4")) -> Column:
    """Whether a link points to a page rather than a file of an unwanted kind."""
    return ~F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1)).isin(*unwanted)
