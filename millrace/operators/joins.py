"""Joins with contracts: one row a key on the build side, and the latest row before a time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import bounded_broadcast, cut


def keyed(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """Equi-join on any number of keys; a key that comes twice on the right is an error. Null keys match nothing."""
    keys = list(keys)
    twice = right.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys).head(1)
    if twice:
        raise ValueError(f"a key comes more than once: {twice[0].asDict()}")
    return left.join(right, keys, how)


def members(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is among ``keys``, rows whose key is not); a null key is not."""
    own = keys.select(key).where(F.col(key).isNotNull()).distinct()
    return df.join(own, key, "left_semi"), df.join(own, key, "left_anti")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, order: str, values: Iterable[str]) -> DataFrame:
    """Each left row with ``values`` of the latest right row of its key at or before its time; nulls where there is none.

    ``order`` (a column of both sides) breaks ties of time within a side; at equal times right rows come first. Both sides
    are range-partitioned by key and time in one pass; what holds at the end of a partition is carried on as one row a
    key and partition, so no task gets a whole key. Left rows without key or time get nulls.
    """
    values = list(values)
    held = F.struct(*[F.col(v).alias(v) for v in values])
    kept = left.columns
    marked = left.select(F.struct(*[F.col(c) for c in kept]).alias("_row"), F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.col(order).alias("_o"))
    empty = F.lit(None).cast(marked.schema["_row"].dataType)
    facts = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(empty.alias("_row"), F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(0).alias("_side"), F.col(order).alias("_o"), held.alias("_held"))
    both = facts.unionByName(marked, allowMissingColumns=True)
    ranged = cut(both.repartitionByRange("_k", "_t").withColumn("_part", F.spark_partition_id()))
    ends = ranged.where("_side = 0").groupBy("_k", "_part").agg(F.max_by("_held", F.struct("_t", "_o")).alias("_end"))
    parts = ranged.groupBy("_k", "_part").agg(F.lit(1).alias("_one")).join(ends, ["_k", "_part"], "left")
    before = F.last("_end", True).over(Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.select(F.col("_k").alias("_k0"), F.col("_part").alias("_p0"), before.alias("_before"))
    own = Window.partitionBy("_k", "_part").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(bounded_broadcast(carried), (F.col("_k") == F.col("_k0")) & (F.col("_part") == F.col("_p0")), "left")
    found = joined.withColumn("_found", F.coalesce(F.last("_held", True).over(own), "_before")).where("_side = 1")
    known = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    return found.select("_row.*", *[F.when(known, F.col("_found")[v]).alias(f"{v}_as_of") for v in values])
