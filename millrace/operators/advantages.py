"""Group-wise advantages: windows over explicit group ids, so groups of any size stay exact.

Rows need a group column and a reward; null rewards take no part in statistics and get null. Every
window partitions by the group, never by a constant; whitening uses one global aggregate row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.operators.grouped import map_groups

EPS = 1e-6


def _rows_of(df: DataFrame, group: str, reward: str) -> WindowSpec:
    """All rows of a group, in the order of their index if they have one, else of their rewards.

    Sums of doubles depend on the order; a fixed one gives the same last digits for any partitioning.
    """
    order = [reward] if "sample_index" not in df.columns else ["sample_index", reward]
    return Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def group_normalized(df: DataFrame, group: str = "group_index", reward: str = "reward", scale: bool = True, out: str = "advantage") -> DataFrame:
    """Reward minus group mean, over the sample deviation plus 1e-6 if ``scale``; a singleton's deviation counts as 0."""
    w = _rows_of(df, group, reward)
    centred = F.col(reward) - F.avg(reward).over(w)
    return df.withColumn(out, centred / (F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0)) + EPS) if scale else centred)


def leave_one_out(df: DataFrame, group: str = "group_index", reward: str = "reward", out: str = "advantage") -> DataFrame:
    """Reward minus the mean of the others of the group; null for a singleton."""
    w = _rows_of(df, group, reward)
    others = (F.sum(reward).over(w) - F.col(reward)) / F.nullif(F.count(reward).over(w) - 1, F.lit(0))
    return df.withColumn(out, F.col(reward) - others)


def in_range_normalized(df: DataFrame, group: str = "group_index", reward: str = "reward", out: str = "advantage") -> DataFrame:
    """Buffer variant: statistics over rewards in [0, 1] with the population deviation; others and all-zero groups stay."""
    w = _rows_of(df, group, reward)
    valid = F.col(reward).between(0, 1)
    mean, std = F.avg(F.when(valid, F.col(reward))).over(w), F.stddev_pop(F.when(valid, F.col(reward))).over(w)
    zero = F.max(F.when(valid, F.abs(F.col(reward)))).over(w) == 0
    scaled = F.when(std < 1e-8, 0.0).otherwise((F.col(reward) - mean) / (std + 1e-8))
    return df.withColumn(out, F.when(~valid | zero, F.col(reward)).otherwise(scaled))


def whitened(df: DataFrame, values: str, mask: str, out: str = "whitened", shift_mean: bool = True) -> DataFrame:
    """Masked whitening of token arrays over the whole table, with Bessel's correction.

    Two passes: one aggregate row (count, sum, sum of squares), then a projection.
    """
    pairs = F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m"))
    acc = F.aggregate(
        pairs,
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, x: F.struct((a["n"] + x["m"]).alias("n"), (a["s"] + x["v"] * x["m"]).alias("s"), (a["q"] + x["v"] * x["v"] * x["m"]).alias("q")),
    )
    one = df.select(acc.alias("a")).agg(F.sum("a.n").alias("_n"), F.sum("a.s").alias("_s"), F.sum("a.q").alias("_q"))
    mean = F.col("_s") / F.col("_n")
    var = (F.col("_q") / F.col("_n") - mean * mean) * F.col("_n") / F.greatest(F.col("_n") - 1, F.lit(1.0))
    scale = 1 / F.sqrt(var + 1e-8)
    joined = df.join(F.broadcast(one))  # one row
    white = F.transform(values, lambda v: (v - mean) * scale + (F.lit(0.0) if shift_mean else mean))
    return joined.withColumn(out, white).drop("_n", "_s", "_q")


def maxrl_weights(log_likelihoods: np.ndarray, degree: int, baseline: bool = True) -> np.ndarray:
    """Degree-D leave-one-out weights of one group, in float64.

    With a_i = 1 - exp(ll_i), the weight of j is its (centred) likelihood times the sum over orders d < D of
    the d-th elementary symmetric mean of the other a_i, kept as means (not sums) so that nothing overflows.
    """
    ll = np.asarray(log_likelihoods, np.float64)
    n = len(ll)
    if degree < 1 or degree > n:
        raise ValueError(f"degree must be between 1 and the group size; got {degree} for {n}")
    if np.isnan(ll).any() or np.isposinf(ll).any() or (ll > 1e-6).any():
        raise ValueError("log likelihoods must be at most 0 and no NaN")
    if baseline and n < 2:
        raise ValueError("a baseline needs at least two members")
    ll = np.minimum(ll, 0)
    sigma = np.exp(ll)
    effective = n / (n - 1) * (sigma - sigma.mean()) if baseline else sigma
    if n == 1:
        return effective
    a = np.maximum(-np.expm1(ll), 0)
    # means[j, d]: d-th symmetric mean of the members met so far without j; a new one mixes neighbours with weights d / k
    means = np.zeros((n, degree))
    means[:, 0] = 1.0
    for i, x in enumerate(a):
        for rows, k in ((slice(i + 1, n), i + 1), (slice(0, i), i)):
            d = np.arange(1, min(degree, k + 1))
            means[rows, 1 : len(d) + 1] = means[rows, 1 : len(d) + 1] * (k - d) / k + x * means[rows, : len(d)] * d / k
    omega = means.sum(1)
    return effective * omega


def maxrl(df: DataFrame, group: str, order: str, log_likelihood: str, degree: int | None = None, baseline: bool = True, out: str = "weight") -> DataFrame:
    """MaxRL weights per group; a group is one prompt's samples (about 1000 at most), so a task holds one group."""
    keep = [c for c in (group, order, log_likelihood)]
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + f", `{out}` double"

    def run(key: tuple, rows: list[dict]) -> list[tuple]:
        n = len(rows)
        weights = maxrl_weights(np.array([r[log_likelihood] for r in rows], np.float64), min(degree or n, n), baseline and n > 1)
        return [(*(r[c] for c in keep), float(w)) for r, w in zip(rows, weights)]

    return map_groups(df.select(*keep), [group], [order], run, schema)


def maxrl_by_power_sums(df: DataFrame, group: str, order: str, likelihood: str, out: str = "weight") -> DataFrame:
    """MaxRL weights of degree 4 (or the group's size if less) of likelihoods in [0, 1], by power sums of the others.

    The symmetric means are written out, so a decimal likelihood takes no detour by its logarithm, and rows are added up in ``order``:
    a weight that ends in a 5 after the last kept digit is rounded alike in every run. A group of one keeps its likelihood.
    """
    w = Window.partitionBy(group).orderBy(order, likelihood).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    g, a = F.col(likelihood), 1 - F.col(likelihood)
    sums = {"_n": F.count("*").over(w), "_m": F.avg(g).over(w), "_p1": F.sum(a).over(w) - a, "_p2": F.sum(a * a).over(w) - a * a, "_p3": F.sum(a * a * a).over(w) - a * a * a}
    n, m, p1, p2, p3 = map(F.col, sums)
    at_least_1 = lambda x: F.greatest(x, F.lit(1))  # noqa: E731  not reached where it matters
    second = F.when(n > 2, (p1 * p1 - p2) / at_least_1((n - 1) * (n - 2))).otherwise(0.0)
    third = F.when(n > 3, (p1 * p1 * p1 - 3 * p1 * p2 + 2 * p3) / at_least_1((n - 1) * (n - 2) * (n - 3))).otherwise(0.0)
    weight = n / at_least_1(n - 1) * (g - m) * (1 + p1 / at_least_1(n - 1) + second + third)
    return df.withColumns(sums).withColumn(out, F.when(n == 1, g).otherwise(weight)).drop(*sums)


def shaped_by_selector(df: DataFrame, rollout: str = "rollout_id", reward: str = "reward", selector: str = "is_selector", correct: float = 1.2, incorrect: float = 0.8, out: str = "shaped") -> DataFrame:
    """Multi-agent shaping: all rewards of a rollout are weighted by whether its selector was right."""
    right = F.max(F.when(F.col(selector), F.col(reward))).over(Window.partitionBy(rollout))
    return df.withColumn(out, F.col(reward) * F.when(right > 0, correct).otherwise(incorrect))


def tool_shaped(score: Column, turns: Column) -> Column:
    """Negative scores are eased by half a tenth per turn beyond two, up to -0.6."""
    return F.when(score < 0, F.least(F.lit(-0.6), score + (turns - 2) / 2 * 0.1)).otherwise(score)


def strict_retry(loose: Column, strict: Column) -> Column:
    """The strict grader decides where the loose one found no valid answer (null)."""
    return F.coalesce(loose, strict)


#: Names to estimators over a table with group_index and reward; others register here.
ESTIMATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "grpo": group_normalized,
    "gspo": group_normalized,
    "cispo": group_normalized,
    "rloo": leave_one_out,
    "reinforce_plus_plus_baseline": lambda df: group_normalized(df, scale=False),
    "buffer": in_range_normalized,
}


def advantages(df: DataFrame, estimator: str | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Dispatch by name, or apply a custom DataFrame -> DataFrame."""
    if callable(estimator):
        return estimator(df)
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown advantage estimator: {estimator}")
    return ESTIMATORS[estimator](df)


def likelihood_of_reward(reward: Column) -> Column:
    """log of a reward in (0, 1], -inf for 0 and below."""
    return F.when(reward > 0, F.least(F.log(reward), F.lit(0.0))).otherwise(F.lit(-math.inf))
