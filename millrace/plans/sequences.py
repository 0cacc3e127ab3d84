"""Queries on schedules, sessions and conversations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import masks
from millrace.functions.udfs import batched
from millrace.operators import packing, trajectory
from millrace.plans import rl
from millrace.runtime import table

QUERIES, ORACLE = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def steps(spark: SparkSession, d: str) -> DataFrame:
    """(step, sample_index, length): samples of full steps of 64 rollouts."""
    t = table(spark, d, "train_data").where("sample_indices is not null and rollout_ids is not null and tokens is not null")
    t = t.groupBy(F.col("sample_indices").alias("sample_index")).agg(F.max("rollout_ids").alias("rollout_id"), F.max(F.size("tokens")).alias("length"))
    return t.join(rl.j5_step_split(spark, d), "rollout_id").select("step", "sample_index", "length")


# the samples of each step in their order, and a walk over them that carries a list
_STEPS = f"""j AS ({rl.ORACLE["j5_step_split"]}), t AS (SELECT sample_indices AS sample_index, max(rollout_ids) AS rollout_id, CAST(max(len(tokens)) AS BIGINT) AS length FROM train_data WHERE sample_indices IS NOT NULL AND rollout_ids IS NOT NULL AND tokens IS NOT NULL GROUP BY 1),
s AS (SELECT step, sample_index, length, row_number() OVER (PARTITION BY step ORDER BY sample_index) AS pos FROM t JOIN j USING (rollout_id))"""
ORACLE["j1_first_fit"] = f"""WITH RECURSIVE {_STEPS}, r AS (SELECT DISTINCT step, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS fills, CAST(NULL AS BIGINT) AS bin, CAST(NULL AS BIGINT) AS sample_index FROM s UNION ALL
SELECT step, pos, CASE WHEN k IS NULL THEN list_append(fills, length) ELSE list_transform(fills, lambda x, i: CASE WHEN i = k THEN x + length ELSE x END) END, coalesce(k - 1, len(fills)), sample_index FROM (SELECT r.step, s.pos, r.fills, s.length, s.sample_index, nullif(list_position(list_transform(r.fills, lambda x: x + s.length <= 4096), true), 0) AS k FROM r JOIN s ON s.step = r.step AND s.pos = r.pos + 1))
SELECT step, CAST(bin AS INT) AS bin, sample_index FROM r WHERE pos > 0"""
ORACLE["j3_greedy_parts"] = f"""WITH RECURSIVE {_STEPS}, r AS (SELECT DISTINCT step, CAST(0 AS BIGINT) AS pos, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) AS sums, CAST(NULL AS BIGINT) AS part, CAST(0 AS BIGINT) AS length FROM s UNION ALL
SELECT step, pos, list_transform(sums, lambda x, i: CASE WHEN i = k THEN x + length ELSE x END), k - 1, length FROM (SELECT r.step, s.pos, r.sums, s.length, list_position(r.sums, list_min(r.sums)) AS k FROM r JOIN s ON s.step = r.step AND s.pos = r.pos + 1)),
p AS (SELECT step, part, sum(length) AS tokens, count(*) AS samples FROM r WHERE pos > 0 GROUP BY 1, 2), e AS (SELECT DISTINCT step, part FROM s, (SELECT unnest(range(8)) AS part)) SELECT e.step, CAST(e.part AS INT) AS part, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, coalesce(samples, 0) AS samples FROM e LEFT JOIN p ON e.step = p.step AND e.part = p.part"""


@query
def j3_greedy_parts(spark: SparkSession, d: str) -> DataFrame:
    """Samples in their order, each to the part with the fewest tokens."""

    def run(key, part):
        lengths = part.sort_values("sample_index")["length"].tolist()
        return pd.DataFrame([(key[0], p, sum(lengths[i] for i in items), len(items)) for p, items in enumerate(packing.greedy(lengths, 8))], columns=["step", "part", "tokens", "samples"])

    return steps(spark, d).groupBy("step").applyInPandas(run, "step long, part int, tokens long, samples long")


@query
def j1_first_fit(spark: SparkSession, d: str) -> DataFrame:
    def run(key, part):
        part = part.sort_values("sample_index").reset_index(drop=True)
        bins = packing.first_fit(part["length"].tolist(), 4096)
        return pd.DataFrame([(key[0], b, part["sample_index"][i]) for b, items in enumerate(bins) for i in items], columns=["step", "bin", "sample_index"])

    return steps(spark, d).groupBy("step").applyInPandas(run, "step long, bin int, sample_index long")


@query
def j2_j3_balanced_parts(spark: SparkSession, d: str) -> DataFrame:
    """Largest-difference and greedy parts of each step, by tokens."""

    def run(key, part):
        part = part.sort_values("sample_index").reset_index(drop=True)
        lengths = part["length"].tolist()
        rows = [(key[0], name, p, sum(lengths[i] for i in items), len(items)) for name, parts in (("largest_difference", packing.largest_difference(lengths, 8)), ("greedy", packing.greedy(lengths, 8))) for p, items in enumerate(parts)]
        return pd.DataFrame(rows, columns=["step", "method", "part", "tokens", "samples"])

    return steps(spark, d).groupBy("step").applyInPandas(run, "step long, method string, part int, tokens long, samples int")


@query
def j4_j6_schedule(spark: SparkSession, d: str) -> DataFrame:
    return packing.schedule(steps(spark, d), dp=4, capacity=8192, align=2, balance=True)


@query
def l6_l7_session_samples(spark: SparkSession, d: str) -> DataFrame:
    out = trajectory.session_samples(table(spark, d, "turns"))
    return out.select("session_id", "sample", F.size("tokens").alias("tokens"), "response_length", F.aggregate("loss_mask", F.lit(0), lambda s, m: s + m).alias("trained"), "truncated", "ill_formed", "turns")


# runs of visible characters; the line end that ends a conversation is a token of its own
ORACLE["k34_k35_loss_masks"] = r"""WITH s AS (SELECT DISTINCT sample_index, prompt, response FROM samples), t AS (SELECT sample_index, coalesce(response, '') || '<|im_end|>' AS reply, '<|im_start|>user' || chr(10) || coalesce(prompt, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS before FROM s)
SELECT sample_index, CAST(len(regexp_extract_all(before || reply, '{v}')) + 1 AS INT) AS tokens, CAST(len(regexp_extract_all(reply, '{v}')) AS INT) AS trained FROM t""".replace("{v}", r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


@query
def k34_k35_loss_masks(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and trained tokens of each sample as a two-message conversation."""

    def counted(prompt, response):
        tokens, mask = masks.loss_mask([{"role": "user", "content": prompt or ""}, {"role": "assistant", "content": response or ""}])
        return f"{len(tokens)}/{sum(mask)}"

    s = table(spark, d, "samples").select("sample_index", "prompt", "response").distinct()
    both = s.select("sample_index", F.split(batched(counted, "string")("prompt", "response"), "/").alias("x"))
    return both.select("sample_index", F.get("x", F.lit(0)).cast("int").alias("tokens"), F.get("x", F.lit(1)).cast("int").alias("trained"))
