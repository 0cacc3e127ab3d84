"""Samples as training columns, and the contracts they must keep before training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.transforms import default_ids, resolved_source


def reward_value(reward: Column, key: str | None = None) -> Column:
    """The reward itself, or one entry of a reward that is a mapping; null where there is none."""
    return reward if key is None else F.try_element_at(reward, F.lit(key))


def train_columns(samples: DataFrame, reward_key: str | None = None, target: Column | None = None) -> DataFrame:
    """One row per sample with the columns that training reads.

    ``samples`` has (sample_index, response_length, reward, status, rollout_id, metadata as JSON) and perhaps
    loss_mask, remove_sample and any of ``OPTIONAL``. Always given: response_length, reward, raw_reward, truncated,
    rollout_id (nulls get the smallest unused number), loss_mask (ones where there is none, zeros for removed
    samples), rollout_mask_sum. By what the table holds: raw_reward is the metadata's where any row has one;
    round_number if the first sample's metadata has it; source_name if the first sample has metadata; of ``OPTIONAL``
    those that the first sample has. ``target`` is a regression target, with which rewards are 0. A mask of another
    length than the response fails the job; a null length counts as 0.
    """
    have = set(samples.columns)
    given = [c for c in OPTIONAL if c in have]
    of_metadata = lambda key: F.get_json_object("metadata", f"$.{key}")
    firsts = {"metadata": F.col("metadata").isNotNull(), "round_number": of_metadata("round_number").isNotNull(), **{c: F.col(c).isNotNull() for c in given}}
    # one row of facts about the table decides which columns there are
    facts = samples.agg(F.coalesce(F.max(of_metadata("raw_reward").isNotNull()), F.lit(False)).alias("raw"), *[F.coalesce(F.min_by(v, "sample_index"), F.lit(False)).alias(f"first_{k}") for k, v in firsts.items()]).first()
    length = F.coalesce("response_length", F.lit(0))
    reward = F.lit(0.0) if target is not None else reward_value(F.col("reward"), reward_key)
    mask = F.coalesce("loss_mask", F.array_repeat(F.lit(1), length)) if "loss_mask" in have else F.array_repeat(F.lit(1), length)
    checked = F.when(F.size(mask) == length, mask).otherwise(F.raise_error(F.lit("a loss mask differs in length from its response")).cast("array<int>"))
    if "remove_sample" in have:
        checked = F.when(F.coalesce("remove_sample", F.lit(False)), F.array_repeat(F.lit(0), length)).otherwise(checked)
    raw = F.coalesce(of_metadata("raw_reward").cast("double"), reward) if facts["raw"] else reward
    rows = default_ids(samples, "rollout_id", "sample_index")
    columns = [F.col("sample_index"), length.alias("response_length"), reward.alias("reward"), raw.alias("raw_reward"), F.coalesce(F.col("status") == "truncated", F.lit(False)).cast("int").alias("truncated"), F.col("rollout_id"), checked.alias("loss_mask")]
    columns += [F.col(c) for c in given if facts[f"first_{c}"]]
    if facts["first_round_number"]:
        columns.append(of_metadata("round_number").cast("int").alias("round_number"))
    if facts["first_metadata"]:
        columns.append(resolved_source(F.col("source") if "source" in have else F.lit(None).cast("string"), F.col("metadata")).alias("source_name"))
    if target is not None:
        columns.append(target.alias("regression_target"))
    out = rows.select(*columns)
    sums = out.groupBy("rollout_id").agg(F.sum(F.aggregate("loss_mask", F.lit(0), lambda s, m: s + m)).alias("rollout_mask_sum"))
    return out.join(sums, "rollout_id").select(*out.columns, "rollout_mask_sum")


#: Columns that are handed on if the first sample has them.
OPTIONAL = ("tokens", "rollout_log_probs", "rollout_routed_experts", "train_metadata", "multimodal_train_inputs", "teacher_log_probs")


def maxrl_violations(samples: DataFrame, group_size: int) -> DataFrame:
    """(rule, violations) of the sequence-level objective's contract.

    Every response has a rollout id of its own, at least one token and no removal; every sample has a group, and
    every group ``group_size`` samples. Counted per rollout id, sample and group; all rules are listed.
    """
    count = lambda cond: F.coalesce(F.sum(F.when(cond, 1)), F.lit(0)).cast("long")
    rollouts = samples.groupBy("rollout_id").agg(F.count("*").alias("n")).agg(count(F.col("n") > 1).alias("shared_rollout_id"))
    removed = F.col("remove_sample") if "remove_sample" in samples.columns else F.lit(False)
    rows = samples.agg(count(~(F.coalesce("response_length", F.lit(0)) > 0)).alias("empty_response"), count(removed).alias("removed_sample"), count(F.col("group_index").isNull()).alias("no_group"))
    groups = samples.where("group_index is not null").groupBy("group_index").agg(F.count("*").alias("n")).agg(count(F.col("n") != group_size).alias("incomplete_group"))
    one = rollouts.join(rows).join(groups)  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in one.columns])).alias("r")).select("r.*")


def assert_maxrl(samples: DataFrame, group_size: int) -> DataFrame:
    """The samples, if the contract holds; else an error that names the broken rules."""
    broken = {r["rule"]: r["violations"] for r in maxrl_violations(samples, group_size).where("violations > 0").collect()}  # five rules
    if broken:
        raise ValueError(f"the contract is broken: {broken}")
    return samples


def compact_nodes(samples: DataFrame, node: str, rollout: str = "rollout_id") -> DataFrame:
    """(node, siblings, missing, rollouts, ok): siblings from one execution must share one rollout id that is set."""
    per = samples.where(F.col(node).isNotNull()).groupBy(node).agg(F.count("*").alias("siblings"), F.sum(F.col(rollout).isNull().cast("long")).alias("missing"), F.count_distinct(rollout).alias("rollouts"))
    return per.withColumn("ok", (F.col("siblings") == 1) | ((F.col("missing") == 0) & (F.col("rollouts") == 1)))


def string_guards(df: DataFrame, required: list[str], optional: list[str]) -> tuple[Column, Column]:
    """(names of required columns that are null or blank, names of optional ones that are blank but not null), joined by commas."""
    blank = lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")) == ""
    named = lambda c, bad: F.when(bad, F.lit(c))
    missing = F.array_join(F.array_compact(F.array(*[named(c, F.col(c).isNull() | blank(c)) for c in required])), ",")
    return missing, F.array_join(F.array_compact(F.array(*[named(c, blank(c)) for c in optional])), ",")


def missing_keys(payload: Column, keys: list[str]) -> Column:
    """Required keys that a JSON object lacks, joined by commas; null where the text is no object."""
    held = F.json_object_keys(payload)
    return F.when(held.isNotNull(), F.array_join(F.array_except(F.array(*map(F.lit, keys)), held), ","))


def regression_sample(tokens: Column) -> Column:
    """Struct of a regression sample: all tokens are the prompt's, one position is trained."""
    return F.struct(tokens.alias("tokens"), F.lit(1).alias("response_length"), F.array(F.lit(1)).alias("loss_mask"), F.lit("completed").alias("status"))


def completion_sample(prompt: Column, completion: Column, most: int) -> Column:
    """Struct of a supervised sample of which only the completion is trained, cut to ``most`` tokens."""
    tokens = F.slice(F.concat(prompt, completion), 1, most)
    mask = F.slice(F.concat(F.transform(prompt, lambda _: F.lit(0)), F.transform(completion, lambda _: F.lit(1))), 1, most)
    return F.struct(tokens.alias("tokens"), mask.alias("loss_mask"))


def zigzag(total: Column, response: Column, ranks: int) -> Column:
    """Per rank a struct of its two chunks and the log-probabilities and tokens it holds of them, as [begin, end) from the prompt's start.

    A sequence is cut into twice as many chunks as ranks; rank r holds chunks r and 2 * ranks - 1 - r. Position p of
    the log-probabilities tells token p + 1; empty ranges are (0, 0).
    """
    size = F.ceil(total / F.lit(2.0 * ranks)).cast("long")

    def of_chunk(r: int, i: int, name: str) -> list[Column]:
        begin, end = size * i, size * (i + 1)
        low, high = F.greatest(begin, total - response - 1), F.least(end, total - 1)
        some = low < high
        pair = lambda a, b: F.array(a.cast("long"), b.cast("long"))
        zero = pair(F.lit(0), F.lit(0))
        return [pair(begin, end).alias(f"chunk_{name}"), F.when(some, pair(low, high)).otherwise(zero).alias(f"logits_{name}"), F.when(some, pair(low + 1, high + 1)).otherwise(zero).alias(f"tokens_{name}")]

    return F.array(*[F.struct(F.lit(r).alias("rank"), size.alias("chunk_size"), *of_chunk(r, r, "0"), *of_chunk(r, 2 * ranks - 1 - r, "1")) for r in range(ranks)])
