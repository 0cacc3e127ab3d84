"""Queries over samples: group expansion, filters, advantages, pass rates, reward and length metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import advantages, filters, metrics, transforms
from millrace.plans.base import S, r6, samples
from millrace.runtime import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- flagship: filter, normalise, report --------------------------------------------------


@query(f"""WITH {S}, g AS (SELECT *, stddev_samp(reward) OVER w AS sd, avg(reward) OVER w AS mean FROM s WHERE reward IS NOT NULL WINDOW w AS (PARTITION BY group_index))
SELECT group_index, sample_index, reward, round((reward - mean) / (sd + 1e-6), 6) + 0.0 AS advantage FROM g WHERE sd > 1e-6""")
def flagship_rl_step(spark: SparkSession, d: str) -> DataFrame:
    """Rewarded samples, groups without spread dropped, advantages normalised within the group."""
    kept = filters.nonzero_std(samples(spark, d).where("reward is not null"))
    return advantages.group_normalized(kept).select("group_index", "sample_index", "reward", r6("advantage").alias("advantage"))


@query(f"""WITH {S}, g AS (SELECT group_index, stddev_samp(reward) AS sd, avg(reward) AS mean FROM s GROUP BY 1)
SELECT 'zero_std_' || printf('%.1f', round(mean, 1)) AS reason, count(*) AS groups FROM g WHERE sd IS NULL OR NOT sd > 1e-6 GROUP BY 1""")
def d4_drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    return metrics.drop_reasons(samples(spark, d))


@query(f"""WITH {S}, g AS (SELECT group_index, count(*) AS n, sum(CASE WHEN reward = 1 THEN 1 ELSE 0 END) AS c FROM s WHERE reward IS NOT NULL GROUP BY 1),
k AS (SELECT unnest([1, 2, 4, 8]) AS k), p AS (SELECT k, CASE WHEN c = 0 THEN 0.0 WHEN n - c < k THEN 1.0 ELSE 1 - (SELECT exp(sum(ln(1 - CAST(k AS DOUBLE) / i))) FROM (SELECT unnest(range(CAST(n - c + 1 AS BIGINT), CAST(n + 1 AS BIGINT))) AS i)) END AS p FROM g, k WHERE n >= k)
SELECT k, round(avg(p), 6) + 0.0 AS pass_rate, count(*) AS groups FROM p GROUP BY k""")
def e2_pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pass_rates(samples(spark, d)).select("k", r6("pass_rate").alias("pass_rate"), "groups")


@query("""WITH s AS (SELECT DISTINCT sample_indices, rollout_ids AS group_index, raw_reward AS reward FROM train_data), g AS (SELECT group_index, count(*) AS n, sum(CASE WHEN reward = 1 THEN 1 ELSE 0 END) AS c FROM s WHERE reward IS NOT NULL GROUP BY 1),
k AS (SELECT unnest([1, 2, 4, 8]) AS k), p AS (SELECT k, CASE WHEN c = 0 THEN 0.0 WHEN n - c < k THEN 1.0 ELSE 1 - (SELECT exp(sum(ln(1 - CAST(k AS DOUBLE) / i))) FROM (SELECT unnest(range(CAST(n - c + 1 AS BIGINT), CAST(n + 1 AS BIGINT))) AS i)) END AS p FROM g, k WHERE n >= k)
SELECT k, round(avg(p), 6) + 0.0 AS pass_rate, count(*) AS groups FROM p GROUP BY k""")
def e17_raw_pass_rates(spark: SparkSession, d: str) -> DataFrame:
    """The same from the raw rewards of the training rows, by rollout."""
    t = table(spark, d, "train_data").select("sample_indices", F.col("rollout_ids").alias("group_index"), F.col("raw_reward").alias("reward")).distinct()
    return metrics.pass_rates(t).select("k", r6("pass_rate").alias("pass_rate"), "groups")


@query(f"""WITH {S} SELECT source, round(avg(response_length), 6) + 0.0 AS mean, median(response_length) AS median, max(response_length) AS max, min(response_length) AS min FROM s GROUP BY source""")
def e1_length_statistics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.statistics(samples(spark, d), "response_length", ["source"]).withColumn("mean", r6("mean")).drop("n")


@query(f"""WITH {S} SELECT source, round(avg(reward), 6) + 0.0 AS mean_reward, round(avg(CASE WHEN status = 'truncated' THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS truncated_ratio, count(*) AS n FROM s GROUP BY source""")
def e5_eval_log(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    return s.groupBy("source").agg(r6(F.avg("reward")).alias("mean_reward"), r6(F.avg((F.col("status") == "truncated").cast("double"))).alias("truncated_ratio"), F.count("*").alias("n"))


@query(f"""WITH {S}, m AS (SELECT max(response_length) AS top FROM s)
SELECT round(avg(coalesce(reward, 0)), 6) + 0.0 AS value, max(top) AS length, count(*) AS rows FROM s, m WHERE response_length = top""")
def e7_longest_sample(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("v", F.coalesce("reward", F.lit(0.0)))
    return metrics.longest_mean(s, "response_length", "v").withColumn("value", r6("value"))


@query(f"""WITH {S}, c AS (SELECT source, count(*) AS n FROM s GROUP BY 1) SELECT source, n, round(n / (SELECT sum(n) FROM c), 6) + 0.0 AS share FROM c""")
def e12_category_shares(spark: SparkSession, d: str) -> DataFrame:
    return metrics.shares(samples(spark, d), "source").withColumn("share", r6("share"))


@query(f"""WITH {S}, x AS (SELECT CAST(greatest(ceil(response_length / (4096 / 4.0)), 1) AS INT) AS b FROM s WHERE reward = 1 AND response_length <= 4096), c AS (SELECT b, count(*) AS n FROM x GROUP BY 1)
SELECT 'p' || (b * 25) AS bin, round(n / ((SELECT sum(n) FROM c) + 1e-9), 6) + 0.0 AS share FROM c""")
def e14_correct_length_bins(spark: SparkSession, d: str) -> DataFrame:
    return metrics.length_shares(samples(spark, d).where("reward = 1"), F.col("response_length"), 4096).withColumn("share", r6("share"))


@query(f"""WITH {S} SELECT source, round(avg(response_length), 6) + 0.0 AS mean_length, max(response_length) AS max_length, min(response_length) AS min_length, round(avg(CASE WHEN response_length >= 2048 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS clip_ratio FROM s GROUP BY source""")
def e16_length_clip(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    return s.groupBy("source").agg(r6(F.avg("response_length")).alias("mean_length"), F.max("response_length").alias("max_length"), F.min("response_length").alias("min_length"), r6(F.avg((F.col("response_length") >= 2048).cast("double"))).alias("clip_ratio"))


@query("""WITH t AS (SELECT DISTINCT session_id, turn FROM turns WHERE session_id IS NOT NULL AND turn IS NOT NULL), c AS (SELECT session_id, count(*) AS n FROM t GROUP BY 1)
SELECT round(avg(n), 6) + 0.0 AS mean_rounds, max(n) AS max_rounds, min(n) AS min_rounds, count(*) AS sessions FROM c""")
def e16_rounds(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turns").where("session_id is not null and turn is not null").select("session_id", "turn").distinct()
    c = t.groupBy("session_id").agg(F.count("*").alias("n"))
    return c.agg(r6(F.avg("n")).alias("mean_rounds"), F.max("n").alias("max_rounds"), F.min("n").alias("min_rounds"), F.count("*").alias("sessions"))


# -- advantages ---------------------------------------------------------------------------


@query(f"""WITH {S}, g AS (SELECT *, count(*) OVER w AS n, sum(reward) OVER w AS total FROM s WHERE reward IS NOT NULL WINDOW w AS (PARTITION BY group_index))
SELECT sample_index, CASE WHEN n > 1 THEN round(reward - (total - reward) / (n - 1), 6) + 0.0 END AS advantage FROM g""")
def f3_rloo(spark: SparkSession, d: str) -> DataFrame:
    return advantages.leave_one_out(samples(spark, d).where("reward is not null")).select("sample_index", r6("advantage").alias("advantage"))


@query(f"""WITH {S}, r AS (SELECT *, CASE WHEN reward BETWEEN 0 AND 1 THEN reward END AS v FROM s WHERE reward IS NOT NULL),
g AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd, max(abs(v)) OVER w AS top FROM r WINDOW w AS (PARTITION BY group_index))
SELECT sample_index, round(CASE WHEN v IS NULL OR top = 0 THEN reward WHEN sd < 1e-8 THEN 0.0 ELSE (reward - m) / (sd + 1e-8) END, 6) + 0.0 AS advantage FROM g""")
def f5_buffer_normalized(spark: SparkSession, d: str) -> DataFrame:
    return advantages.in_range_normalized(samples(spark, d).where("reward is not null")).select("sample_index", r6("advantage").alias("advantage"))


@query(f"""WITH {S} SELECT sample_index, sum(response_length) OVER (PARTITION BY rollout_id) AS rollout_length FROM s""")
def f6_rollout_sums(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("sample_index", F.sum("response_length").over(Window.partitionBy("rollout_id")).alias("rollout_length"))


@query(f"""WITH {S}, g AS (SELECT *, avg(reward) OVER (PARTITION BY group_index) AS mean FROM s WHERE reward IS NOT NULL)
SELECT sample_index, round(reward - mean, 9) + 0.0 AS advantage FROM g""")
def f17_group_centred(spark: SparkSession, d: str) -> DataFrame:
    return advantages.group_normalized(samples(spark, d).where("reward is not null"), scale=False).select("sample_index", (F.round("advantage", 9) + F.lit(0.0)).alias("advantage"))


# the elementary symmetric sums of the others by their power sums; degree 4, a group of one keeps its likelihood
@query(f"""WITH {S}, x AS (SELECT group_index, sample_index, CASE WHEN reward > 0 THEN least(reward, 1.0) ELSE 0.0 END AS g FROM s WHERE reward IS NOT NULL AND group_index IS NOT NULL), y AS (SELECT *, 1 - g AS a FROM x),
p AS (SELECT *, count(*) OVER w AS n, avg(g) OVER w AS m, sum(a) OVER w - a AS p1, sum(a * a) OVER w - a * a AS p2, sum(a * a * a) OVER w - a * a * a AS p3 FROM y WINDOW w AS (PARTITION BY group_index))
SELECT group_index, sample_index, round(CASE WHEN n = 1 THEN g ELSE n * 1.0 / (n - 1) * (g - m) * (1 + p1 / (n - 1) + CASE WHEN n > 2 THEN (p1 * p1 - p2) / ((n - 1) * (n - 2)) ELSE 0 END + CASE WHEN n > 3 THEN (p1 * p1 * p1 - 3 * p1 * p2 + 2 * p3) / ((n - 1) * (n - 2) * (n - 3)) ELSE 0 END) END, 6) + 0.0 AS weight FROM p""")
def f4_maxrl_weights(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).where("reward is not null and group_index is not null").withColumn("g", F.when(F.col("reward") > 0, F.least("reward", F.lit(1.0))).otherwise(0.0))
    return advantages.maxrl_by_power_sums(s, "group_index", "sample_index", "g").select("group_index", "sample_index", r6("weight").alias("weight"))


@query(f"""WITH {S}, x AS (SELECT *, max(CASE WHEN sample_index % 2 = 0 THEN reward END) OVER (PARTITION BY rollout_id) AS sel FROM s WHERE reward IS NOT NULL)
SELECT sample_index, round(reward * CASE WHEN sel > 0 THEN 1.2 ELSE 0.8 END, 6) + 0.0 AS shaped FROM x""")
def f15_selector_shaping(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).where("reward is not null").withColumn("is_selector", F.col("sample_index") % 2 == 0)
    return advantages.shaped_by_selector(s).select("sample_index", r6("shaped").alias("shaped"))


@query(f"""WITH {S}, t AS (SELECT sample_index, reward * 2 - 1 AS score, sample_index % 6 AS turns FROM s WHERE reward IS NOT NULL)
SELECT sample_index, round(CASE WHEN score < 0 THEN least(-0.6, score + (turns - 2) / 2.0 * 0.1) ELSE score END, 6) + 0.0 AS score FROM t""")
def f16_tool_shaping(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).where("reward is not null")
    return s.select("sample_index", r6(advantages.tool_shaped(F.col("reward") * 2 - 1, F.col("sample_index") % 6)).alias("score"))


# -- transforms and filters ---------------------------------------------------------------


@query(f"""WITH {S}, p AS (SELECT group_index, row_number() OVER (ORDER BY group_index) - 1 AS g FROM (SELECT DISTINCT group_index FROM s WHERE group_index IS NOT NULL))
SELECT group_index, g * 4 + j AS idx, j FROM p, (SELECT unnest(range(0, 4)) AS j)""")
def c10_group_expansion(spark: SparkSession, d: str) -> DataFrame:
    prompts = samples(spark, d).where("group_index is not null").select("group_index").distinct()
    return transforms.expand_groups(transforms.positioned(prompts, ["group_index"], "g"), 4, "g").select("group_index", "idx", "j")


@query("""WITH s0 AS (SELECT sample_index, max(rollout_id) AS rollout_id FROM samples GROUP BY 1), s AS (SELECT sample_index, CASE WHEN sample_index % 7 = 0 THEN NULL ELSE rollout_id END AS rollout_id FROM s0),
miss AS (SELECT sample_index, row_number() OVER (ORDER BY sample_index) AS k FROM s WHERE rollout_id IS NULL),
free AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM (SELECT unnest(range(0, (SELECT count(*) FROM s) + 1)) AS i) WHERE i NOT IN (SELECT rollout_id FROM s WHERE rollout_id IS NOT NULL))
SELECT s.sample_index, coalesce(s.rollout_id, free.i) AS rollout_id FROM s LEFT JOIN miss USING (sample_index) LEFT JOIN free USING (k)""")
def c11_rollout_ids(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").groupBy("sample_index").agg(F.max("rollout_id").alias("rollout_id"))
    s = s.withColumn("rollout_id", F.when(F.col("sample_index") % 7 == 0, None).otherwise(F.col("rollout_id")))
    return transforms.default_ids(s, "rollout_id", "sample_index").select("sample_index", "rollout_id")


@query("""SELECT sample_index, coalesce(nullif(source, ''), json_extract_string(metadata, '$.source_name'), 'unknown') AS source FROM (SELECT DISTINCT sample_index, CASE WHEN sample_index % 5 = 0 THEN NULL ELSE source END AS source, metadata FROM samples)""")
def c15_source_resolution(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").select("sample_index", F.when(F.col("sample_index") % 5 == 0, None).otherwise(F.col("source")).alias("source"), "metadata").distinct()
    return s.select("sample_index", transforms.resolved_source(F.col("source"), F.col("metadata")).alias("source"))


@query("""SELECT DISTINCT session_id, turn, CASE finish_reason WHEN 'length' THEN 'truncated' WHEN 'abort' THEN 'aborted' WHEN 'stop' THEN 'completed' ELSE 'pending' END AS status FROM turns""")
def c17_finish_status(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turns")
    return t.select("session_id", "turn", transforms.status_of(F.col("finish_reason"), F.lit("pending")).alias("status")).distinct()


@query("""SELECT sample_index, json_extract_string(metadata, '$.identifier') AS identifier FROM (SELECT DISTINCT sample_index, metadata FROM samples)""")
def c1_metadata_projection(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").select("sample_index", "metadata").distinct()
    return s.select("sample_index", F.get_json_object("metadata", "$.identifier").alias("identifier"))


@query("""WITH s AS (SELECT DISTINCT sample_index, prompt FROM samples)
SELECT sample_index, '<|user|>' || chr(10) || prompt || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) AS rendered FROM s WHERE prompt IS NOT NULL""")
def c4_chat_template(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").where("prompt is not null").select("sample_index", "prompt").distinct()
    return s.select("sample_index", transforms.render_chat(transforms.as_messages(F.col("prompt"))).alias("rendered"))


@query("""SELECT DISTINCT sample_index, len(string_split_regex(trim(regexp_replace(prompt, '\\s+', ' ', 'g')), ' ')) AS words FROM samples WHERE prompt IS NOT NULL AND len(string_split_regex(trim(regexp_replace(prompt, '\\s+', ' ', 'g')), ' ')) <= 30""")
def d1_long_prompt_filter(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").where("prompt is not null").select("sample_index", "prompt").distinct()
    return filters.short_enough(s, "prompt", 30).select("sample_index", transforms.word_count(F.col("prompt")).cast("long").alias("words")).distinct()


@query(f"""WITH {S}, g AS (SELECT group_index, max(sample_index) AS done FROM s WHERE reward IS NOT NULL GROUP BY 1 HAVING stddev_samp(reward) > 1e-6)
SELECT group_index FROM g ORDER BY done, group_index LIMIT 64""")
def d5_oversample_until_target(spark: SparkSession, d: str) -> DataFrame:
    """A stated feature: the first 64 groups, in order of completion, that pass the filter."""
    g = samples(spark, d).where("reward is not null").groupBy("group_index").agg(F.max("sample_index").alias("done"), F.stddev_samp("reward").alias("sd")).where("sd > 1e-6")
    return filters.first_n(g, 64, ["done", "group_index"]).select("group_index")


@query(f"""WITH {S} SELECT group_index, count(*) AS n FROM s WHERE group_index IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""")
def d9_valid_groups(spark: SparkSession, d: str) -> DataFrame:
    return filters.group_sizes(samples(spark, d).where("group_index is not null"), "group_index", 2)


@query("""WITH g AS (SELECT group_index, coalesce(max(created_at), TIMESTAMP '1970-01-01') AS ts FROM samples WHERE group_index IS NOT NULL GROUP BY 1), k AS (SELECT group_index FROM g ORDER BY ts DESC, group_index LIMIT 50)
SELECT DISTINCT sample_index, group_index FROM samples WHERE group_index IN (SELECT group_index FROM k)""")
def d10_newest_groups(spark: SparkSession, d: str) -> DataFrame:
    """A stated feature: rows of the 50 newest groups."""
    s = table(spark, d, "samples").where("group_index is not null")
    return filters.newest_groups(s, "group_index", "created_at", 50).select("sample_index", "group_index").distinct()


@query(f"""WITH {S}, e AS (SELECT sample_index AS id FROM s), p AS (SELECT sample_index + 3 AS id, reward FROM s), c AS (SELECT id, count(*) AS times, max(CASE WHEN reward IS NULL OR isnan(reward) OR isinf(reward) THEN 1 ELSE 0 END) AS bad FROM p GROUP BY 1)
SELECT coalesce(sum(CASE WHEN c.id IS NULL THEN 1 ELSE 0 END), 0)::BIGINT AS missing, coalesce(sum(CASE WHEN e.id IS NULL THEN 1 ELSE 0 END), 0)::BIGINT AS unexpected, coalesce(sum(CASE WHEN times > 1 THEN 1 ELSE 0 END), 0)::BIGINT AS duplicate, coalesce(sum(CASE WHEN bad = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS non_finite FROM e FULL JOIN c ON e.id = c.id""")
def d17_prediction_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    return metrics.coverage(s.select(F.col("sample_index").alias("id")), s.select((F.col("sample_index") + 3).alias("id"), "reward"), "id", "reward")


@query(f"""WITH {S}, c AS (SELECT *, CASE WHEN reward IS NULL THEN length(status) / 10.0 ELSE reward END AS final FROM s) SELECT sample_index, round(final, 6) + 0.0 AS reward FROM c""")
def d21_reward_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Only rows without a reward are graded (here by a stand-in grader on the status)."""
    s = samples(spark, d)
    return s.select("sample_index", r6(filters.graded_where_missing(F.col("reward"), F.length("status") / 10.0)).alias("reward"))


@query(f"""WITH {S}, x AS (SELECT reward AS p, CASE WHEN sample_index % 3 = 0 THEN 1.0 ELSE 0.0 END AS y, source FROM s WHERE reward IS NULL OR reward BETWEEN 0 AND 1), v AS (SELECT *, CASE WHEN p IS NULL THEN 1 - y ELSE p END AS w FROM x),
l AS (SELECT *, CASE WHEN y = 1 THEN ln(least(greatest(w, 1e-6), 1 - 1e-6)) ELSE ln(1 - least(greatest(w, 1e-6), 1 - 1e-6)) END AS ll FROM v), a AS (SELECT source, count(*) AS rows, avg(CASE WHEN p IS NULL THEN 0.0 ELSE 1.0 END) AS coverage, avg(ll) AS mll, avg(CASE WHEN p IS NULL THEN 1.0 ELSE (p - y) * (p - y) END) AS brier, avg(CASE WHEN p IS NOT NULL THEN (p - y) * (p - y) END) AS vb FROM l GROUP BY source)
SELECT source, rows, round(coverage, 6) + 0.0 AS coverage, round(mll, 6) + 0.0 AS mean_log_likelihood, round(-mll, 6) + 0.0 AS cross_entropy, round(brier, 6) + 0.0 AS brier, round(vb, 6) + 0.0 AS valid_brier, round(100 * (1 - sqrt(brier)), 6) + 0.0 AS brier_index FROM a""")
def e22_forecast_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).where("reward is null or reward between 0 and 1").withColumn("y", F.when(F.col("sample_index") % 3 == 0, 1.0).otherwise(0.0))
    out = metrics.forecast_report(s, "reward", "y", ["source"])
    return out.select("source", "rows", *[r6(c).alias(c) for c in ("coverage", "mean_log_likelihood", "cross_entropy", "brier", "valid_brier", "brier_index")])


@query(f"""WITH {S}, x AS (SELECT group_index, CASE WHEN group_index % 2 = 0 THEN 1.0 ELSE 0.0 END AS y, reward AS p FROM s WHERE group_index IS NOT NULL AND (reward IS NULL OR reward BETWEEN 0 AND 1)), g AS (SELECT group_index, y, avg(p) AS p FROM x GROUP BY 1, 2)
SELECT count(*) AS groups, round(avg(CASE WHEN p IS NULL THEN 0.0 ELSE 1.0 END), 6) + 0.0 AS coverage, round(avg((coalesce(p, 1 - y) - y) * (coalesce(p, 1 - y) - y)), 6) + 0.0 AS brier FROM g""")
def e23_group_ensemble(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).where("group_index is not null and (reward is null or reward between 0 and 1)").withColumn("y", F.when(F.col("group_index") % 2 == 0, 1.0).otherwise(0.0))
    g = s.groupBy("group_index", "y").agg(F.avg("reward").alias("p"))
    return g.agg(F.count("*").alias("groups"), r6(F.avg(F.col("p").isNotNull().cast("double"))).alias("coverage"), r6(F.avg(metrics.brier(F.col("p"), F.col("y")))).alias("brier"))


@query(f"""WITH {S} SELECT CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE coalesce(source, 'unknown') END AS source, count(*) AS n, round(avg(reward), 6) + 0.0 AS mean_score, round(avg(CASE WHEN reward >= 0.5 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS within FROM s WHERE reward IS NOT NULL GROUP BY GROUPING SETS ((source), ())""")
def e24_source_and_all(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).where("reward is not null")
    out = s.groupingSets([["source"], []], "source").agg(F.grouping("source").alias("g"), F.count("*").alias("n"), r6(F.avg("reward")).alias("mean_score"), r6(F.avg((F.col("reward") >= 0.5).cast("double"))).alias("within"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.coalesce("source", F.lit("unknown"))).alias("source"), "n", "mean_score", "within")


@query(f"""WITH {S}, x AS (SELECT response_length * 1.0 AS target, reward * 1000 AS pred, reward FROM s), b AS (SELECT *, CASE WHEN pred IS NULL THEN NULL WHEN pred = 0 THEN 0 ELSE sign(pred) * 1000 + floor(log10(abs(pred))) END AS pb, CASE WHEN target = 0 THEN 0 ELSE sign(target) * 1000 + floor(log10(abs(target))) END AS tb FROM x)
SELECT round(avg(CASE WHEN pred IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS extraction_rate, round(avg(CASE WHEN pb = tb THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS oom_accuracy, round(avg(CASE WHEN pred IS NOT NULL THEN CASE WHEN pred > target THEN 1.0 ELSE 0.0 END END), 6) + 0.0 AS too_big, round(avg(CASE WHEN pred IS NOT NULL THEN CASE WHEN pred < target THEN 1.0 ELSE 0.0 END END), 6) + 0.0 AS too_small, round(avg(reward), 6) + 0.0 AS score_mean, round(stddev_pop(reward), 6) + 0.0 AS score_std FROM b""")
def e25_regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = samples(spark, d).select(F.col("response_length").cast("double").alias("target"), (F.col("reward") * 1000).alias("pred"), "reward")
    same = F.coalesce(metrics.order_of_magnitude(F.col("pred")) == metrics.order_of_magnitude(F.col("target")), F.lit(False)).cast("double")
    valid = lambda c: F.avg(F.when(F.col("pred").isNotNull(), c.cast("double")))
    return x.agg(r6(F.avg(F.col("pred").isNotNull().cast("double"))).alias("extraction_rate"), r6(F.avg(same)).alias("oom_accuracy"), r6(valid(F.col("pred") > F.col("target"))).alias("too_big"), r6(valid(F.col("pred") < F.col("target"))).alias("too_small"), r6(F.avg("reward")).alias("score_mean"), r6(F.stddev_pop("reward")).alias("score_std"))


@query(f"""WITH {S}, x AS (SELECT source, response_length, reward FROM s WHERE reward IS NOT NULL AND response_length IS NOT NULL), r AS (SELECT source, rank() OVER (PARTITION BY source ORDER BY response_length) + (count(*) OVER (PARTITION BY source, response_length) - 1) / 2.0 AS a, rank() OVER (PARTITION BY source ORDER BY reward) + (count(*) OVER (PARTITION BY source, reward) - 1) / 2.0 AS b FROM x)
SELECT source, CASE WHEN count(DISTINCT a) > 1 AND count(DISTINCT b) > 1 THEN round(corr(a, b), 6) + 0.0 END AS spearman, count(*) AS rows FROM r GROUP BY source""")
def e27_spearman_by_source(spark: SparkSession, d: str) -> DataFrame:
    return metrics.spearman(samples(spark, d), "response_length", "reward", ["source"]).withColumn("spearman", r6("spearman"))


@query(f"""WITH {S}, x AS (SELECT response_length, reward FROM s WHERE reward IS NOT NULL AND response_length IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY response_length) + (count(*) OVER (PARTITION BY response_length) - 1) / 2.0 AS a, rank() OVER (ORDER BY reward) + (count(*) OVER (PARTITION BY reward) - 1) / 2.0 AS b FROM x)
SELECT round(corr(a, b), 6) + 0.0 AS spearman, count(*) AS rows FROM r""")
def e27_spearman_overall(spark: SparkSession, d: str) -> DataFrame:
    return metrics.spearman(samples(spark, d), "response_length", "reward").withColumn("spearman", r6("spearman"))


@query(f"""WITH {S}, x AS (SELECT group_index, sample_index, reward FROM s WHERE group_index IS NOT NULL), g AS (SELECT group_index, median(reward) AS m FROM x GROUP BY 1), y AS (SELECT x.group_index, m, sample_index, abs(reward - m) AS dist FROM x JOIN g USING (group_index) WHERE reward IS NOT NULL)
SELECT group_index, round(first(m), 6) + 0.0 AS median_prediction, arg_min(sample_index, ROW(dist, sample_index)) AS representative FROM y GROUP BY group_index""")
def e28_group_median(spark: SparkSession, d: str) -> DataFrame:
    """Median prediction of each group with the sample nearest to it (least index among ties)."""
    s = samples(spark, d).where("group_index is not null and reward is not null")
    m = s.groupBy("group_index").agg(F.median("reward").alias("m"))
    near = F.min_by("sample_index", F.struct(F.abs(F.col("reward") - F.col("m")), "sample_index"))
    return s.join(m, "group_index").groupBy("group_index").agg(r6(F.first("m")).alias("median_prediction"), near.alias("representative"))


# -- order, cursor, joins -----------------------------------------------------------------


@query(f"""WITH {S}, g AS (SELECT group_index, min(sample_index) AS first_index FROM s WHERE group_index IS NOT NULL GROUP BY 1) SELECT group_index, row_number() OVER (ORDER BY first_index) AS place FROM g""")
def i1_restored_order(spark: SparkSession, d: str) -> DataFrame:
    g = samples(spark, d).where("group_index is not null").groupBy("group_index").agg(F.min("sample_index").alias("first_index"))
    return transforms.positioned(g, ["first_index"], "place", start=1).select("group_index", "place")


@query("""SELECT sample_indices AS sample_index, CAST(floor((row_number() OVER (ORDER BY sample_indices) - 1) / 32) AS BIGINT) AS micro_batch FROM (SELECT DISTINCT sample_indices FROM train_data WHERE sample_indices IS NOT NULL)""")
def j7_static_micro_batches(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train_data").where("sample_indices is not null").select(F.col("sample_indices").alias("sample_index")).distinct()
    return transforms.positioned(t, ["sample_index"], "p").select("sample_index", F.floor(F.col("p") / 32).alias("micro_batch"))


@query("""WITH t AS (SELECT sample_indices AS sample_index, max(len(tokens)) AS n FROM train_data WHERE sample_indices IS NOT NULL AND tokens IS NOT NULL GROUP BY 1), p AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY sample_index) - 1) / 32) AS BIGINT) AS micro_batch FROM t)
SELECT sample_index, micro_batch, CAST(sum(n) OVER (PARTITION BY micro_batch ORDER BY sample_index) AS BIGINT) AS cu_seqlen, CAST(ceil(sum(n) OVER (PARTITION BY micro_batch) / 128.0) * 128 AS BIGINT) AS padded FROM p""")
def j8_cumulative_lengths(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train_data").where("sample_indices is not null and tokens is not null").groupBy(F.col("sample_indices").alias("sample_index")).agg(F.max(F.size("tokens")).alias("n"))
    p = transforms.positioned(t, ["sample_index"], "p").withColumn("micro_batch", F.floor(F.col("p") / 32))
    w = Window.partitionBy("micro_batch")
    return p.select("sample_index", "micro_batch", F.sum("n").over(w.orderBy("sample_index")).alias("cu_seqlen"), (F.ceil(F.sum("n").over(w) / 128.0) * 128).cast("long").alias("padded"))


@query("""WITH r AS (SELECT rollout_ids AS rollout_id, min(sample_indices) AS first_pos FROM train_data WHERE rollout_ids IS NOT NULL GROUP BY 1), k AS (SELECT rollout_id, row_number() OVER (ORDER BY first_pos, rollout_id) AS k, count(*) OVER () AS n FROM r)
SELECT rollout_id, CAST(floor((k - 1) / 64) AS BIGINT) AS step FROM k WHERE floor((k - 1) / 64) < floor(n / 64)""")
def j5_step_split(spark: SparkSession, d: str) -> DataFrame:
    """Rollouts in order of first occurrence, 64 a step; rollouts that don't fill a last step are dropped (the reference rule)."""
    r = table(spark, d, "train_data").where("rollout_ids is not null").groupBy(F.col("rollout_ids").alias("rollout_id")).agg(F.min("sample_indices").alias("first_pos"))
    p = transforms.positioned(r, ["first_pos", "rollout_id"], "p")
    n = r.agg(F.count("*").alias("n"))
    return p.join(F.broadcast(n)).where("floor(p / 64) < floor(n / 64)").select("rollout_id", F.floor(F.col("p") / 64).alias("step"))


@query("""WITH x AS (SELECT DISTINCT sample_indices, rewards, raw_reward FROM train_data WHERE sample_indices IS NOT NULL) SELECT sample_indices AS sample_index, round(CASE WHEN (SELECT count(raw_reward) FROM x) > 0 THEN coalesce(raw_reward, rewards) ELSE rewards END, 6) + 0.0 AS raw_reward FROM x""")
def c14_raw_reward(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "train_data").where("sample_indices is not null").select("sample_indices", "rewards", "raw_reward").distinct()
    has = x.agg((F.count("raw_reward") > 0).alias("has"))
    value = F.when(F.col("has"), F.coalesce("raw_reward", "rewards")).otherwise(F.col("rewards"))
    return x.join(F.broadcast(has)).select(F.col("sample_indices").alias("sample_index"), r6(value).alias("raw_reward"))
