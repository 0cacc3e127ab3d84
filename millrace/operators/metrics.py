"""Metrics over samples, tokens and requests, as DataFrames of named columns or long (metric, value) rows.

Statistics skip nulls; empty inputs give null values (or no row per group). All are one or two
aggregations with map-side combining.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import bounded_broadcast, cut


def statistics(df: DataFrame, column: str, keys: Iterable[str] = ()) -> DataFrame:
    """mean, median (exact, averaged middle), max and min."""
    keys = list(keys)
    plain = df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.max(column).alias("max"), F.min(column).alias("min"), F.count(column).alias("n"))
    return with_quantiles(plain, exact_quantiles(df, column, {"median": 0.5}, keys), keys).select(*keys, "mean", "median", "max", "min", "n")


def with_quantiles(plain: DataFrame, quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """Other aggregates with the quantiles of the same keys."""
    if not keys:
        return plain.join(F.broadcast(quantiles), F.lit(True), "left")
    other = [c for c in quantiles.columns if c not in keys]
    named = quantiles.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *other)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return plain.join(named, same, "left").select(*plain.columns, *other)


def exact_quantiles(df: DataFrame, column: str, at: dict[str, float], keys: Iterable[str] = ()) -> DataFrame:
    """(keys, one column a quantile): exact, linearly interpolated, at any number of rows per key.

    The built-in aggregate keeps all distinct values of a key in one task. Here equal values are counted
    first, the counts are range-partitioned by (keys, value), and each partition finds the wanted ranks that
    fall into it by its running sums and the totals of the partitions before (one row a key and partition).
    """
    keys = list(keys)
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    ranged = cut(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_t"))
    every = Window.partitionBy(*keys)
    offsets = parts.select(*keys, "_part", (F.sum("_t").over(every.orderBy("_part")) - F.col("_t")).alias("_before"), F.sum("_t").over(every).alias("_total"))
    # other names on this side, as both come from one table
    named = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_before", "_total")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = ranged.join(bounded_broadcast(named), same).select(*keys, "_v", "_n", "_part", "_before", "_total")
    end = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    placed = joined.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_n"))
    aggregates, wanted = [], F.lit(False)
    for name, p in at.items():
        place = (F.col("_total") - 1) * p
        low, high = F.floor(place + 1e-9), F.ceil(place - 1e-9)
        holds = lambda r: (F.col("_start") <= r) & (r < F.col("_end"))
        wanted = wanted | holds(low) | holds(high)
        a, b = F.max(F.when(holds(low), F.col("_v"))), F.max(F.when(holds(high), F.col("_v")))
        share = F.max(place - low)
        aggregates.append(F.when(F.max(F.when(low == high, 1)) == 1, a.cast("double")).otherwise(a + (b - a) * share).alias(name))
    return placed.where(wanted).groupBy(*keys).agg(*aggregates)


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n - c, k) / C(n, k), as a product; 0 for no success, 1 where too few failures are left."""
    product = F.aggregate(F.sequence(F.greatest(n - c + 1, F.lit(1)), F.greatest(n, F.lit(1))), F.lit(1.0), lambda acc, i: acc * (1 - F.lit(float(k)) / i))
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1 - product)


def strict_pass_at_k(n: int, c: int, k: int) -> float:
    """``pass_at_k`` of one group, for arguments that make sense; others are errors."""
    if not 0 <= c <= n or not 1 <= k <= n:
        raise ValueError(f"{c} of {n} right, k = {k}")
    return 1.0 - math.prod((n - c - i) / (n - i) for i in range(k)) if n - c >= k else 1.0


def maze_report(df: DataFrame, ks: Iterable[int], group: str = "group_index", size: int | None = None) -> DataFrame:
    """(metric, value) of validated paths (group, success, optimal, reason).

    pass@k and optimal_pass@k are means over the groups, rates and reason shares are over all paths. Groups of different
    sizes, or of another than ``size``, are an error. No rows give no metrics.
    """
    ks = list(ks)
    groups = df.groupBy(group).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in ("success", "optimal")])
    sizes = groups.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    if sizes["lo"] is None:
        return df.sparkSession.createDataFrame([], "metric string, value double")
    if sizes["lo"] != sizes["hi"] or (size is not None and sizes["lo"] != size) or any(not 1 <= k <= sizes["lo"] for k in ks):
        raise ValueError(f"groups of {sizes['lo']} to {sizes['hi']} paths")
    named = [(f"{prefix}pass@{k}", F.avg(pass_at_k(F.col("n"), F.col(c), k))) for k in ks for prefix, c in (("", "success"), ("optimal_", "optimal"))]
    named += [(f"{c}_rate", F.sum(c) / F.sum("n")) for c in ("success", "optimal")]
    one = groups.agg(*[v.alias(f"m{i}") for i, (_, v) in enumerate(named)])
    rates = one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"m{i}").alias("value")) for i, (name, _) in enumerate(named)])).alias("r")).select("r.*")
    return rates.unionByName(shares(df, "reason").select(F.concat(F.lit("reason/"), "reason").alias("metric"), F.col("share").alias("value")))


def maze_train_metrics(df: DataFrame) -> DataFrame:
    """(metric, value): success and optimal rate and the share of each reason, over all paths."""
    return maze_report(df.withColumn("_all", F.lit(0)), (), "_all")


def group_counts(df: DataFrame, group: str = "group_index", reward: str = "reward") -> DataFrame:
    return df.where(F.col(reward).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum((F.col(reward) == 1).cast("long")).alias("c"))


def pass_rates(df: DataFrame, ks: Iterable[int] = (1, 2, 4, 8), group: str = "group_index", reward: str = "reward") -> DataFrame:
    """(k, pass_rate, groups): mean over the groups of at least k members; groups may differ in size."""
    counts = group_counts(df, group, reward)
    per = F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col("n") >= k, pass_at_k(F.col("n"), F.col("c"), k)).alias("p")) for k in ks])
    rows = counts.select(F.explode(per).alias("x")).select("x.k", "x.p").where("p is not null")
    return rows.groupBy("k").agg(F.avg("p").alias("pass_rate"), F.count("*").alias("groups"))


def drop_reasons(df: DataFrame, group: str = "group_index", reward: str = "reward") -> DataFrame:
    """(reason, groups) of the groups that the zero-deviation filter drops."""
    stats = df.groupBy(group).agg(F.stddev_samp(reward).alias("std"), F.avg(reward).alias("mean"))
    return stats.where("std is null or not std > 1e-6").groupBy(F.concat(F.lit("zero_std_"), F.format_string("%.1f", F.round("mean", 1))).alias("reason")).agg(F.count("*").alias("groups"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def longest_mean(df: DataFrame, length: str, value: str) -> DataFrame:
    """Mean of a value over the rows whose length is the largest (ties share)."""
    top = df.agg(F.max(length).alias("_top"))
    return df.join(F.broadcast(top), F.col(length) == F.col("_top")).agg(F.avg(value).alias("value"), F.max("_top").alias("length"), F.count("*").alias("rows"))


def length_shares(df: DataFrame, length: Column, limit: int, bins: int = 4) -> DataFrame:
    """(bin, share): equal value bins of the largest allowed length; longer ones take no part."""
    part = F.greatest(F.ceil(length / (limit / bins)), F.lit(1))
    counted = df.where(length <= limit).groupBy(part.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("_all"))
    return counted.join(F.broadcast(total)).select(F.format_string("p%d", (F.col("bin") * 100 / bins).cast("int")).alias("bin"), (F.col("n") / (F.col("_all") + 1e-9)).alias("share"))


def shares(df: DataFrame, key: str, count: str = "n") -> DataFrame:
    """(key, n, share)."""
    counted = df.groupBy(key).agg(F.count("*").alias(count))
    total = counted.agg(F.sum(count).alias("_all"))
    return counted.join(F.broadcast(total)).select(key, count, (F.col(count) / F.col("_all")).alias("share"))


def conflicts(df: DataFrame, keys: Iterable[str], value: str) -> DataFrame:
    """Groups with more than one distinct value."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("distinct_values"), F.count("*").alias("rows")).where("distinct_values > 1")


def order_of_magnitude(x: Column) -> Column:
    """Signed decade of a finite number as a struct; (0, 0) for 0, null otherwise."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    zero = F.struct(F.lit(0).alias("sign"), F.lit(0).cast("long").alias("decade"))
    return F.when(~finite, None).when(x == 0, zero).otherwise(F.struct(F.signum(x).cast("int").alias("sign"), F.floor(F.log10(F.abs(x))).alias("decade")))


def average_ranks(df: DataFrame, column: str, out: str, keys: Iterable[str] = ()) -> DataFrame:
    """``out``: rank within ``keys`` with ties sharing their mean rank, at any number of rows per key.

    Equal values are counted, the counts are range-partitioned, and the totals of earlier partitions (one
    row a key and partition) shift each partition's running sums.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("_n"))
    ranged = cut(counts.repartitionByRange(*keys, column).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_t"))
    before = (F.sum("_t").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_t")).alias("_before")
    named = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), before)
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy(column))
    placed = ranged.join(bounded_broadcast(named), same).withColumn(out, F.col("_before") + inside - (F.col("_n") - 1) / 2)
    ranks = placed.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], F.col(column).alias("_rv"), out)
    match = F.col(column) == F.col("_rv")
    for i, k in enumerate(keys):
        match &= F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return df.join(ranks, match).select(*df.columns, out)


def spearman(df: DataFrame, a: str, b: str, keys: Iterable[str] = ()) -> DataFrame:
    """Rank correlation with ties; null below two rows or for a constant side."""
    keys = list(keys)
    finite = df.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in (a, b)))
    ranked = average_ranks(average_ranks(finite, a, "_ra", keys), b, "_rb", keys)
    varied = (F.min("_ra") < F.max("_ra")) & (F.min("_rb") < F.max("_rb"))
    return ranked.groupBy(*keys).agg(F.when(varied, F.corr("_ra", "_rb")).alias("spearman"), F.count("*").alias("rows"))


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, low, high, n): equal bins of [low, high]; values outside fall into open bins 0 and bins + 1."""
    bucket = F.when(F.col(column) == high, bins).otherwise(F.expr(f"width_bucket({column}, {low!r}D, {high!r}D, {bins})"))
    width = (high - low) / bins
    rows = df.where(F.col(column).isNotNull()).groupBy(bucket.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return rows.select("bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("low"), (F.lit(low) + F.col("bin") * width).alias("high"), "n")


def adaptive_histogram(df: DataFrame, column: str, bins: int, tail: float = 0.005) -> DataFrame:
    """(bin, low, high, n): at most ``bins`` equal bins between the ``tail`` quantiles, open bins (null ends) below and above.

    There are no more bins than distinct values between; a single value gets a bin of length 1 around it. The last
    inner bin is closed. Nulls and NaN are no values; without any there are no bins.
    """
    own = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(F.col(column).cast("double").alias("_x"))
    q = exact_quantiles(own, "_x", {"_low": tail, "_high": 1 - tail}).first()
    if q is None or q["_low"] is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    inner = own.where(F.col("_x").between(q["_low"], q["_high"]))
    ends = inner.agg(F.min("_x").alias("a"), F.max("_x").alias("b"), F.count_distinct("_x").alias("d")).first()
    count = min(bins, ends["d"])
    a, b = (ends["a"] - 0.5, ends["b"] + 0.5) if ends["d"] == 1 else (ends["a"], ends["b"])
    width = (b - a) / count
    at = F.least(F.floor((F.col("_x") - a) / width).cast("int") + 1, F.lit(count))
    bucket = F.when(F.col("_x") < q["_low"], 0).when(F.col("_x") > q["_high"], count + 1).otherwise(at)
    rows = own.groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(count + 2).select(F.col("id").cast("int").alias("bin"))  # empty bins too
    low = F.when(F.col("bin") == count + 1, q["_high"]).when(F.col("bin") > 0, a + (F.col("bin") - 1) * width)
    high = F.when(F.col("bin") == 0, q["_low"]).when(F.col("bin") <= count, a + F.col("bin") * width)
    return every.join(F.broadcast(rows), "bin", "left").select("bin", low.alias("low"), high.alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bernoulli_log_likelihood(p: Column, label: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.when(label == 1, F.log(q)).otherwise(F.log(1 - q))


def brier(p: Column, label: Column) -> Column:
    """Squared error; a missing prediction is the worst case."""
    return F.when(p.isNull(), 1.0).otherwise((p - label) * (p - label))


def forecast_report(df: DataFrame, p: str, label: str, keys: Iterable[str] = ()) -> DataFrame:
    """coverage, mean log-likelihood, cross entropy, Brier score and index, and Brier over valid rows."""
    worst = F.when(F.col(p).isNull(), 1 - F.col(label)).otherwise(F.col(p))
    ll = bernoulli_log_likelihood(worst, F.col(label))
    out = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(F.col(p).isNotNull().cast("double")).alias("coverage"), F.avg(ll).alias("mean_log_likelihood"), F.avg(-ll).alias("cross_entropy"), F.avg(brier(F.col(p), F.col(label))).alias("brier"), F.avg(F.when(F.col(p).isNotNull(), brier(F.col(p), F.col(label)))).alias("valid_brier"))
    return out.withColumn("brier_index", 100 * (1 - F.sqrt("brier")))


def coverage(expected: DataFrame, predicted: DataFrame, key: str, value: str) -> DataFrame:
    """(missing, unexpected, duplicate, non_finite) counts of predictions against the expected ids (full outer join)."""
    per = predicted.groupBy(key).agg(F.count("*").alias("times"), F.max((F.col(value).isNull() | F.isnan(value) | (F.abs(F.col(value)) == float("inf"))).cast("int")).alias("bad"))
    both = expected.select(F.col(key).alias("_want")).distinct().join(per, F.col("_want") == F.col(key), "full_outer")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return both.agg(count(F.col(key).isNull()).alias("missing"), count(F.col("_want").isNull()).alias("unexpected"), count(F.col("times") > 1).alias("duplicate"), count(F.col("bad") == 1).alias("non_finite"))
