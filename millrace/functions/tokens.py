"""Token-level expressions over array columns: divergences, losses and reducers JVM-side, reverse scans on Arrow batches.

All arrays of a row are aligned to the response. A null array gives null; an empty one gives an empty
array or, for reductions, 0 over a denominator of at least 1. Nothing here shuffles; each is linear in the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

SAFETY = 20.0


def lit_d(x: float) -> Column:
    return F.lit(float(x))


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    low = low if isinstance(low, Column) else lit_d(low)
    high = high if isinstance(high, Column) else lit_d(high)
    return F.least(F.greatest(x, low), high)


def zipped(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def total(x: Column) -> Column:
    return F.aggregate(x, lit_d(0), lambda s, v: s + v)


def masked_sum(x: Column, mask: Column) -> Column:
    return total(F.zip_with(x, mask, lambda v, m: v * m))


def masked_mean(x: Column, mask: Column) -> Column:
    """Sum over trainable tokens by their number, at least 1."""
    return masked_sum(x, mask) / F.greatest(total(mask), lit_d(1))


def broadcast_to(value: Column, like: Column) -> Column:
    """A sequence-level value at every token (evaluated once)."""
    return F.array_repeat(value, F.size(like))


def bound(value: Column, f) -> Column:
    """f(value) with the value evaluated once, however often f's lambdas use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def approx_kl(log_probs: Column, base: Column, kind: str, ratio: Column | None = None) -> Column:
    """Per-token estimate of the divergence from ``base``: k1, k2, k3 or low_var_kl (k3 within +-10)."""
    forms = {
        "k1": lambda d: d,
        "k2": lambda d: d * d / 2,
        "k3": lambda d: F.exp(-d) - 1 + d,
        "low_var_kl": lambda d: F.exp(-d) - 1 + d,
    }
    if kind not in forms:
        raise ValueError(f"unknown kind of KL: {kind}")
    kl = F.zip_with(log_probs, base, lambda a, b: forms[kind](a - b))
    if ratio is not None:
        kl = F.zip_with(ratio, kl, lambda r, k: r * k)
    return F.transform(kl, lambda k: clamp(k, -10, 10)) if kind == "low_var_kl" else kl


def sequence_kl(log_probs: Column, old: Column, mask: Column) -> Column:
    """Masked mean of old minus new log-probabilities of a sequence."""
    return masked_mean(F.zip_with(old, log_probs, lambda o, n: o - n), mask)


def opsm_mask(log_probs: Column, old: Column, advantages: Column, mask: Column, delta: float) -> Column:
    """1 per kept token; tokens with a negative advantage go where the sequence's KL exceeds ``delta``."""
    return bound(sequence_kl(log_probs, old, mask), lambda kl: F.transform(advantages, lambda a: F.when((a < 0) & (kl > delta), 0.0).otherwise(1.0)))


def ppo_loss(kl: Column, advantages: Column, low: float, high: float, dual: float | None = None) -> Column:
    """Clipped policy loss per token; ``kl`` is old minus new log-probability, ``dual`` bounds the loss of bad actions."""
    if dual is not None and dual <= 1:
        raise ValueError("dual clip must be greater than 1")

    def one(k: Column, a: Column) -> Column:
        ratio = F.exp(-k)
        loss = F.greatest(-ratio * a, -clamp(ratio, 1 - low, 1 + high) * a)
        return loss if dual is None else F.when(a < 0, F.least(lit_d(-dual) * a, loss)).otherwise(loss)

    return F.zip_with(kl, advantages, one)


def ppo_clipped(kl: Column, advantages: Column, low: float, high: float) -> Column:
    """1 where clipping raises the loss."""

    def one(k: Column, a: Column) -> Column:
        ratio = F.exp(-k)
        return (-clamp(ratio, 1 - low, 1 + high) * a > -ratio * a).cast("double")

    return F.zip_with(kl, advantages, one)


def cispo_loss(kl: Column, log_probs: Column, advantages: Column, low: float, high: float) -> Column:
    """Clipped importance weight times advantage times log-probability."""
    weighted = F.zip_with(kl, advantages, lambda k, a: -clamp(F.exp(-k), 1 - low, 1 + high) * a)
    return F.zip_with(weighted, log_probs, lambda w, p: w * p)


def cispo_clipped(kl: Column, low: float, high: float) -> Column:
    return F.transform(kl, lambda k: (clamp(F.exp(-k), 1 - low, 1 + high) != F.exp(-k)).cast("double"))


def importance(train: Column, rollout: Column) -> Column:
    return F.zip_with(train, rollout, lambda t, r: F.exp(t - r))


def tis_weights(train: Column, rollout: Column, low: float, high: float) -> Column:
    """Truncated importance weights."""
    return F.transform(importance(train, rollout), lambda w: clamp(w, low, high))


def icepop_weights(train: Column, rollout: Column, low: float, high: float) -> Column:
    """Importance weights, 0 outside the band."""
    return F.transform(importance(train, rollout), lambda w: F.when((w >= low) & (w <= high), w).otherwise(0.0))


def leveled_ratio(train: Column, rollout: Column, mask: Column, level: str) -> Column:
    """Log importance ratio per token at token, sequence (sum) or geometric (mean) level."""
    diff = F.zip_with(train, rollout, lambda t, r: t - r)
    if level == "token":
        return diff
    if level == "sequence":
        return broadcast_to(masked_sum(diff, mask), diff)
    if level == "geometric":
        return broadcast_to(masked_mean(diff, mask), diff)
    raise ValueError(f"unknown level: {level}")


def mis_weights(train: Column, rollout: Column, mask: Column, level: str, mode: str, low: float, high: float) -> Column:
    """Bounded importance weights of the mismatch correction; ``mode`` is truncate, clip or mask."""
    raw = F.transform(leveled_ratio(train, rollout, mask, level), lambda x: F.exp(clamp(x, -SAFETY, SAFETY)))
    bounds = {"truncate": lambda w: clamp(w, 0, high), "clip": lambda w: clamp(w, low, high), "mask": lambda w: w}
    if mode not in bounds:
        raise ValueError(f"unknown mode: {mode}")
    return F.zip_with(F.transform(raw, bounds[mode]), mask, lambda w, m: w * m)


def mis_mask(train: Column, rollout: Column, mask: Column, level: str, low: float, high: float, veto: float | None = None) -> Column:
    """Rejection mask: tokens outside the band go, and whole sequences with a token below the veto threshold."""
    raw = F.transform(leveled_ratio(train, rollout, mask, level), lambda x: F.exp(clamp(x, -SAFETY, SAFETY)))
    kept = F.zip_with(raw, mask, lambda w, m: m * ((w >= low) & (w <= high)).cast("double"))
    if veto is None:
        return kept
    diff = F.zip_with(train, rollout, lambda t, r: t - r)
    bad = F.exists(F.arrays_zip(diff.alias("d"), mask.alias("m")), lambda x: (x["d"] < F.log(lit_d(veto))) & (x["m"] > 0))
    return F.when(bad, broadcast_to(lit_d(0), kept)).otherwise(kept)


def mismatch_metrics(train: Column, rollout: Column, mask: Column) -> dict[str, Column]:
    """Sequence-level metrics of train against rollout log-probabilities."""
    t, r = masked_mean(train, mask), masked_mean(rollout, mask)
    diff = F.zip_with(train, rollout, lambda a, b: a - b)
    safe = F.transform(diff, lambda d: F.exp(clamp(d, -SAFETY, SAFETY)))
    return {
        "training_log_ppl": -t,
        "training_ppl": F.exp(-t),
        "rollout_log_ppl": -r,
        "rollout_ppl": F.exp(-r),
        "kl": -masked_mean(diff, mask),
        "k3_kl": masked_mean(F.transform(diff, lambda d: F.exp(d) - d - 1), mask),
        "log_ppl_diff": r - t,
        "log_ppl_abs_diff": F.abs(r - t),
        "ppl_ratio": F.exp(r - t),
        "chi2_token": masked_mean(F.transform(safe, lambda w: w * w), mask) - 1,
        "chi2_seq": F.exp(2 * clamp(masked_sum(diff, mask), -SAFETY, SAFETY)) - 1,
    }


def value_loss(values: Column, old: Column, returns: Column, clip: float) -> Column:
    """Larger of the squared errors of the value and of the value clipped around the old one."""
    near = F.zip_with(values, old, lambda v, o: o + clamp(v - o, -clip, clip))
    plain = F.zip_with(values, returns, lambda v, r: (v - r) * (v - r))
    clipped = F.zip_with(near, returns, lambda v, r: (v - r) * (v - r))
    return F.zip_with(plain, clipped, lambda a, b: F.greatest(a, b))


def nll(log_probs: Column) -> Column:
    return F.transform(log_probs, lambda p: -p)


#: Elements of padded rows that ``discounted`` holds at once.
PADDED = 2_000_000


def _discount(rows: list[np.ndarray], gamma: float) -> list[np.ndarray]:
    """Reverse scans of ragged rows: runs of similar length are padded and scanned one position at a time."""
    out: list[np.ndarray] = [np.empty(0)] * len(rows)
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    at = 0
    while at < len(order):
        width = len(rows[order[at]])
        chunk = order[at : at + max(1, PADDED // max(width, 1))]
        at += len(chunk)
        grid = np.zeros((width, len(chunk)))
        for j, i in enumerate(chunk):
            grid[: len(rows[i]), j] = rows[i]
        for t in range(width - 2, -1, -1):
            grid[t] += gamma * grid[t + 1]
        for j, i in enumerate(chunk):
            out[i] = grid[: len(rows[i]), j]
    return out


def discounted(df: DataFrame, rewards: str, gamma: float, out: str) -> DataFrame:
    """``out``: G_t = r_t + gamma G_{t+1} of each row's array; null stays null.

    Linear in the tokens, on Arrow batches; a fold that appends would copy its array at each step.
    """
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index(rewards))
            known = [i for i, ok in enumerate(column.is_valid().to_pylist()) if ok]
            done: list = [None] * b.num_rows
            for i, g in zip(known, _discount([column[i].values.to_numpy(zero_copy_only=False).astype(np.float64) for i in known], gamma)):
                done[i] = g
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.list_(pa.float64()))], [*b.schema.names, out])

    return df.mapInArrow(run, schema)


def last_trainable(mask: Column) -> Column:
    """0-based position of the last token with mask 1, -1 if there is none."""
    n = F.size(mask)
    at = F.array_position(F.reverse(F.transform(mask, lambda m: m.cast("double"))), 1.0)
    return F.when(at > 0, n - at).otherwise(-1)


def token_rewards(reward: Column, kl: Column, mask: Column, kl_coef: float, at_last_trainable: bool = True) -> Column:
    """-coef * kl per trainable token, plus the reward at the last trainable (else the last) token."""
    last = last_trainable(mask) if at_last_trainable else F.size(kl) - 1
    base = F.zip_with(kl, mask, lambda k, m: lit_d(-kl_coef) * k * m) if at_last_trainable else F.transform(kl, lambda k: lit_d(-kl_coef) * k)
    return bound(F.struct(last.alias("last"), reward.alias("reward")), lambda x: F.transform(base, lambda r, i: r + F.when(i == x["last"], x["reward"]).otherwise(0.0)))


def reinforce_pp_returns(df: DataFrame, reward: Column, kl: Column, mask: Column, kl_coef: float, gamma: float, out: str) -> DataFrame:
    """``out``: discounted returns of token rewards with the reward at the last trainable token."""
    return discounted(df.withColumn("_r", token_rewards(reward, kl, mask, kl_coef)), "_r", gamma, out).drop("_r")


def reinforce_pp_baseline(reward: Column, kl: Column, kl_coef: float) -> Column:
    """Group-centred reward minus coef * kl at every token."""
    return F.transform(kl, lambda k: reward - lit_d(kl_coef) * k)


def grpo_returns(advantage: Column, like: Column) -> Column:
    return broadcast_to(advantage, like)


def td_errors(rewards: Column, values: Column, gamma: float) -> Column:
    """r_t + gamma V_{t+1} - V_t; the value after the last token is 0."""
    nxt = F.concat(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.array(lit_d(0)))
    return F.zip_with(F.zip_with(rewards, nxt, lambda r, v: r + lit_d(gamma) * v), values, lambda x, v: x - v)


def gae(df: DataFrame, rewards: Column, values: Column, gamma: float, lam: float, out: str) -> DataFrame:
    """``out``: generalized advantage estimates."""
    return discounted(df.withColumn("_d", td_errors(rewards, values, gamma)), "_d", gamma * lam, out).drop("_d")


def opd_advantage(advantage: Column, student: Column, teacher: Column, coef: float) -> Column:
    """Advantage lowered by the student's excess log-probability over the teacher's."""
    gap = F.zip_with(student, teacher, lambda s, t: s - t)
    return F.zip_with(advantage, gap, lambda a, g: a - lit_d(coef) * g)


def csr_merge(ids_a: Column, off_a: Column, ids_b: Column, off_b: Column) -> tuple[Column, Column]:
    """Concatenate two ragged rows kept as flat ids with offsets."""
    last = F.element_at(off_a, -1)
    tail = F.transform(F.slice(off_b, 2, F.greatest(F.size(off_b) - 1, F.lit(0))), lambda x: x + last)
    return F.concat(ids_a, ids_b), F.concat(off_a, tail)


def csr_pad(offsets: Column, length: Column) -> Column:
    """Offsets padded with empty rows up to ``length`` rows."""
    return F.concat(offsets, F.array_repeat(F.element_at(offsets, -1), F.greatest(length + 1 - F.size(offsets), F.lit(0))))


def kept_vocabulary(offsets: Column, mask: Column) -> tuple[Column, Column]:
    """(sum, count) of ids kept per trainable token of a ragged row."""
    n = F.zip_with(F.slice(offsets, 2, F.greatest(F.size(offsets) - 1, F.lit(0))), mask, lambda x, m: F.struct(x.alias("end"), m.alias("m")))
    each = F.transform(n, lambda x, i: F.when(x["m"] > 0, x["end"] - F.get(offsets, i)).otherwise(0))
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, v: s + v), F.aggregate(mask, F.lit(0).cast("long"), lambda s, v: s + v)


def last_n(x: Column, n: Column) -> Column:
    """Last n elements; all of them if there are fewer, none for 0."""
    k = F.least(n, F.size(x))
    return F.when(k > 0, F.slice(x, F.size(x) - k + 1, F.greatest(k, F.lit(1)))).otherwise(F.slice(x, 1, 0))


def log_softmax(logits: Column) -> Column:
    """Log-probabilities of a small vocabulary."""
    norm = bound(F.array_max(logits), lambda top: top + F.log(F.aggregate(logits, lit_d(0), lambda s, v: s + F.exp(v - top))))
    return bound(norm, lambda z: F.transform(logits, lambda v: v - z))


def entropy(logits: Column) -> Column:
    return -total(F.transform(log_softmax(logits), lambda p: F.exp(p) * p))
