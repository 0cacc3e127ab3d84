"""Deterministic splits, deduplication and orders. Random picks are seeded hashes: the same at any partitioning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.transforms import positioned
from millrace.runtime import bounded_broadcast


def shuffled_key(key: Column, seed: int | Column) -> Column:
    """Sort key of a deterministic shuffle: the MD5 of seed and key as text, which any engine can repeat. A null key counts as empty."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed, F.lit("|"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """``position`` of each row in the order of one epoch."""
    return positioned(df.withColumn("_h", shuffled_key(F.col(key), seed + epoch)), ["_h", key], "position").drop("_h")


def batch(df: DataFrame, key: str, seed: int, offset: int, n: int, rows: int) -> DataFrame:
    """n rows from a cursor over endless epochs: the tail of one epoch, then the head of the next."""
    out = None
    for epoch in range(offset // rows, (offset + n - 1) // rows + 1):
        lo, hi = max(offset, epoch * rows) - epoch * rows, min(offset + n, (epoch + 1) * rows) - epoch * rows
        part = epoch_order(df, key, seed, epoch).where((F.col("position") >= lo) & (F.col("position") < hi)).withColumn("epoch", F.lit(epoch))
        out = part if out is None else out.unionByName(part)
    return out


def first_wins(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """One row per key: the first in an order (aggregated, so that a hot key costs one row per task)."""
    order = list(order)
    columns = df.columns
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_r")).select("_r.*")


def without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the other table; null keys stay."""
    return df.join(other.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def time_cut(df: DataFrame, date: str, later: int) -> DataFrame:
    """The latest date with more than ``later`` rows strictly after it (one row; null if there is none).

    Works on one row per date.
    """
    per = df.where(F.col(date).isNotNull()).groupBy(F.col(date).alias("d")).agg(F.count("*").alias("n"))
    after = F.sum("n").over(Window.orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, -1))
    return per.withColumn("after", F.coalesce(after, F.lit(0))).where(F.col("after") > later).agg(F.max("d").alias("cut"))


def family_split(df: DataFrame, family: str, target: int, seed: int) -> DataFrame:
    """(family, rows, part): families in hash order, the prefix whose rows come nearest to ``target`` is eval; one at least stays train."""
    per = df.groupBy(family).agg(F.count("*").alias("rows")).withColumn("_h", shuffled_key(F.col(family), seed))
    placed = positioned(per, ["_h", family], "place")
    # running sums by place: one row a family, in ranges of places
    block = 100_000
    placed = placed.withColumn("_block", F.floor(F.col("place") / block))
    sums = placed.groupBy("_block").agg(F.sum("rows").alias("_t"))
    before = sums.select("_block", (F.sum("_t").over(Window.orderBy("_block")) - F.col("_t")).alias("_before"))
    running = F.col("_before") + F.sum("rows").over(Window.partitionBy("_block").orderBy("place"))
    run = placed.join(bounded_broadcast(before), "_block").withColumn("running", running)
    last = run.agg(F.max("place").alias("_last"))
    best = run.join(F.broadcast(last)).where("place < _last").agg(F.min_by("place", F.struct(F.abs(F.col("running") - target), F.col("place"))).alias("_best"))
    return run.join(F.broadcast(best)).select(family, "rows", F.when(F.col("place") <= F.col("_best"), "eval").otherwise("train").alias("part"))


def apportioned(df: DataFrame, stratum: str, key: str, shares: list[tuple[str, float]], seed: int) -> DataFrame:
    """``part`` of each row: per stratum, largest-remainder numbers of rows in hash order."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    floors = [F.floor(F.col("_n") * s) for _, s in shares]
    rest = F.col("_n")
    for f in floors:
        rest = rest - f
    # remainders, largest first, ties by position
    order = F.transform(F.array_sort(F.array(*[F.struct((-(F.col("_n") * s - f)).alias("r"), F.lit(i).alias("i")) for i, ((_, s), f) in enumerate(zip(shares, floors))])), lambda x: x["i"])
    counts = [f + F.when(F.array_position(order, i) <= rest, 1).otherwise(0) for i, f in enumerate(floors)]
    ends, total = [], F.lit(0)
    for c in counts:
        total = total + c
        ends.append(total)
    bounds = sizes.select(stratum, *[e.cast("long").alias(f"_e{i}") for i, e in enumerate(ends)])
    hashed = df.withColumn("_h", shuffled_key(F.col(key), F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(stratum).cast("string"), F.lit("")))))
    placed = positioned(hashed, ["_h", key], "_k", 1, [stratum]).drop("_h").join(bounded_broadcast(bounds), stratum)
    part = F.lit(shares[-1][0])
    for i in range(len(shares) - 2, -1, -1):
        part = F.when(F.col("_k") <= F.col(f"_e{i}"), shares[i][0]).otherwise(part)
    return placed.withColumn("part", part).drop("_k", *[f"_e{i}" for i in range(len(shares))])
