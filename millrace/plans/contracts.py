"""Queries on training columns, contracts, joins with contracts, reports of paths, and round trips of scans and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import grading as G
from millrace.functions.udfs import batched
from millrace.operators import advantages, eval_config, intervals, joins, metrics, rollouts, training
from millrace.plans.base import S, r6, r6_scaled, samples
from millrace.plans.relational import E, SPAN, events
from millrace.runtime import shared_dir, table
from millrace.sources import cache, readers, sinks

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- training columns ---------------------------------------------------------------------


@query("""WITH s AS (SELECT DISTINCT sample_index, source, response_length, reward, status, rollout_id, metadata FROM samples),
x AS (SELECT *, coalesce(response_length, 0) AS len, CASE WHEN coalesce(status = 'aborted', false) THEN 0 ELSE coalesce(response_length, 0) END AS trained FROM s)
SELECT sample_index, len AS response_length, round(reward, 6) + 0.0 AS reward, round(reward, 6) + 0.0 AS raw_reward, CAST(coalesce(status = 'truncated', false) AS INT) AS truncated, rollout_id, CAST(trained AS BIGINT) AS trained, CAST(sum(trained) OVER (PARTITION BY rollout_id) AS BIGINT) AS rollout_mask_sum, coalesce(nullif(source, ''), json_extract_string(metadata, '$.source_name'), 'unknown') AS source_name FROM x""")
def c12_train_columns(spark: SparkSession, d: str) -> DataFrame:
    """Samples as training columns; aborted ones are removed, the mask is shown by its sum."""
    s = table(spark, d, "samples").select("sample_index", "source", "response_length", "reward", "status", "rollout_id", "metadata").distinct()
    out = training.train_columns(s.withColumn("remove_sample", F.coalesce(F.col("status") == "aborted", F.lit(False))))
    trained = F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, m: a + m)
    return out.select("sample_index", "response_length", r6("reward").alias("reward"), r6("raw_reward").alias("raw_reward"), "truncated", "rollout_id", trained.alias("trained"), F.col("rollout_mask_sum").cast("long").alias("rollout_mask_sum"), "source_name")


@query("""SELECT raw_id, TRY_CAST(json_extract_string(payload, '$.number') AS DOUBLE) AS reward FROM raw_records WHERE json_valid(payload)""")
def f1_selected_rewards(spark: SparkSession, d: str) -> DataFrame:
    """One entry of a mapping of values as the reward."""
    r = table(spark, d, "raw_records").select("raw_id", F.try_parse_json("payload").alias("o")).where("o is not null")
    values = F.create_map(*[x for k in ("number", "line") for x in (F.lit(k), F.try_variant_get("o", f"$.{k}", "double"))])
    return r.select("raw_id", training.reward_value(values, "number").alias("reward"))


@query("""SELECT sample_indices AS sample_index, 1 AS response_length, 1 AS trained, 'completed' AS status, CAST(max(len(tokens)) AS BIGINT) AS tokens FROM train_data WHERE sample_indices IS NOT NULL AND tokens IS NOT NULL GROUP BY 1""")
def c26_regression_samples(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train_data").where("sample_indices is not null and tokens is not null")
    t = t.groupBy(F.col("sample_indices").alias("sample_index")).agg(F.max_by("tokens", F.size("tokens")).alias("tokens"))
    s = t.select("sample_index", training.regression_sample(F.col("tokens")).alias("s"))
    return s.select("sample_index", "s.response_length", F.aggregate("s.loss_mask", F.lit(0), lambda a, m: a + m).alias("trained"), "s.status", F.size("s.tokens").cast("long").alias("tokens"))


@query("""WITH t AS (SELECT sample_indices AS sample_index, max(len(tokens)) AS n, max(response_lengths) AS r FROM train_data WHERE sample_indices IS NOT NULL AND tokens IS NOT NULL AND response_lengths BETWEEN 0 AND len(tokens) GROUP BY 1)
SELECT sample_index, CAST(least(n, 512) AS BIGINT) AS tokens, CAST(greatest(least(n, 512) - (n - r), 0) AS BIGINT) AS trained FROM t""")
def c27_completion_samples(spark: SparkSession, d: str) -> DataFrame:
    """Only the completion is trained, and a sequence is cut to 512 tokens."""
    t = table(spark, d, "train_data").where("sample_indices is not null and tokens is not null and response_lengths between 0 and size(tokens)")
    t = t.groupBy(F.col("sample_indices").alias("sample_index")).agg(F.max_by("tokens", F.size("tokens")).alias("t"), F.max("response_lengths").alias("r"))
    prompt = F.size("t") - F.col("r")
    s = t.select("sample_index", training.completion_sample(F.slice("t", F.lit(1), prompt), F.slice("t", prompt + 1, F.col("r")), 512).alias("s"))
    return s.select("sample_index", F.size("s.tokens").cast("long").alias("tokens"), F.aggregate("s.loss_mask", F.lit(0).cast("long"), lambda a, m: a + m).alias("trained"))


@query("""WITH t AS (SELECT sample_indices AS i, CAST(max(len(tokens)) AS BIGINT) AS n, CAST(max(response_lengths) AS BIGINT) AS r FROM train_data WHERE sample_indices IS NOT NULL AND tokens IS NOT NULL AND response_lengths BETWEEN 0 AND len(tokens) GROUP BY 1),
c AS (SELECT i, n, r, rank, CAST(ceil(n / 8.0) AS BIGINT) AS size FROM t, (SELECT unnest(range(4)) AS rank)),
b AS (SELECT *, rank * size AS a0, (rank + 1) * size AS e0, (7 - rank) * size AS a1, (8 - rank) * size AS e1 FROM c),
l AS (SELECT *, greatest(a0, n - r - 1) AS x0, least(e0, n - 1) AS y0, greatest(a1, n - r - 1) AS x1, least(e1, n - 1) AS y1 FROM b)
SELECT i AS sample_index, CAST(rank AS INT) AS rank, size AS chunk_size, a0 || '-' || e0 AS chunk_0, a1 || '-' || e1 AS chunk_1, CASE WHEN x0 < y0 THEN x0 || '-' || y0 ELSE '0-0' END AS logits_0, CASE WHEN x1 < y1 THEN x1 || '-' || y1 ELSE '0-0' END AS logits_1,
CASE WHEN x0 < y0 THEN (x0 + 1) || '-' || (y0 + 1) ELSE '0-0' END AS tokens_0, CASE WHEN x1 < y1 THEN (x1 + 1) || '-' || (y1 + 1) ELSE '0-0' END AS tokens_1 FROM l""")
def j11_zigzag_offsets(spark: SparkSession, d: str) -> DataFrame:
    """What each of four ranks holds of each sample, as begin-end."""
    t = table(spark, d, "train_data").where("sample_indices is not null and tokens is not null and response_lengths between 0 and size(tokens)")
    t = t.groupBy(F.col("sample_indices").alias("sample_index")).agg(F.max(F.size("tokens")).cast("long").alias("n"), F.max("response_lengths").cast("long").alias("r"))
    o = t.select("sample_index", F.explode(training.zigzag(F.col("n"), F.col("r"), 4)).alias("o"))
    ranges = [F.concat_ws("-", F.col(f"o.{c}_{k}")[0].cast("string"), F.col(f"o.{c}_{k}")[1].cast("string")).alias(f"{c}_{k}") for c in ("chunk", "logits", "tokens") for k in (0, 1)]
    return o.select("sample_index", "o.rank", "o.chunk_size", *ranges)


# -- contracts ----------------------------------------------------------------------------


@query(f"""WITH {S} SELECT 'shared_rollout_id' AS rule, (SELECT count(*) FROM (SELECT rollout_id FROM s GROUP BY 1 HAVING count(*) > 1)) AS violations UNION ALL SELECT 'empty_response', (SELECT count(*) FROM s WHERE NOT coalesce(response_length, 0) > 0) UNION ALL SELECT 'removed_sample', (SELECT count(*) FROM s WHERE status = 'aborted')
UNION ALL SELECT 'no_group', (SELECT count(*) FROM s WHERE group_index IS NULL) UNION ALL SELECT 'incomplete_group', (SELECT count(*) FROM (SELECT group_index FROM s WHERE group_index IS NOT NULL GROUP BY 1 HAVING count(*) <> 8))""")
def d15_maxrl_contract(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("remove_sample", F.coalesce(F.col("status") == "aborted", F.lit(False)))
    return training.maxrl_violations(s, 8)


@query(f"""WITH {S}, g AS (SELECT group_index, count(*) AS siblings, CAST(sum(CASE WHEN rollout_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, count(DISTINCT rollout_id) AS rollouts FROM s WHERE group_index IS NOT NULL GROUP BY 1) SELECT *, siblings = 1 OR (missing = 0 AND rollouts = 1) AS ok FROM g""")
def d16_compact_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Groups taken as executions: which of them keep the contract."""
    return training.compact_nodes(samples(spark, d), "group_index")


@query("""SELECT problem_id, array_to_string(list_filter([CASE WHEN question IS NULL OR trim(regexp_replace(question, '\\s+', ' ', 'g')) = '' THEN 'question' END, CASE WHEN answer_unit IS NULL OR trim(regexp_replace(answer_unit, '\\s+', ' ', 'g')) = '' THEN 'answer_unit' END], lambda x: x IS NOT NULL), ',') AS missing,
array_to_string(list_filter([CASE WHEN trim(regexp_replace(program, '\\s+', ' ', 'g')) = '' THEN 'program' END, CASE WHEN trim(regexp_replace(context, '\\s+', ' ', 'g')) = '' THEN 'context' END, CASE WHEN trim(regexp_replace(olympiad_source, '\\s+', ' ', 'g')) = '' THEN 'olympiad_source' END], lambda x: x IS NOT NULL), ',') AS blank FROM problems""")
def d19_string_guards(spark: SparkSession, d: str) -> DataFrame:
    missing, blank = training.string_guards(table(spark, d, "problems"), ["question", "answer_unit"], ["program", "context", "olympiad_source"])
    return table(spark, d, "problems").select("problem_id", missing.alias("missing"), blank.alias("blank"))


@query("""SELECT raw_id, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN array_to_string(list_filter(['question', 'answer_value', 'answer_unit', 'source', 'number', 'program'], lambda k: NOT list_contains(json_keys(payload), k)), ',') END AS missing FROM raw_records""")
def d11_required_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = ["question", "answer_value", "answer_unit", "source", "number", "program"]
    return table(spark, d, "raw_records").select("raw_id", F.when(F.try_parse_json("payload").isNotNull(), training.missing_keys(F.col("payload"), keys)).alias("missing"))


@query("""SELECT * FROM (VALUES ('aime', '/d/a.jsonl', 4, 0.7, 'math'), ('gpqa', '/d/g.jsonl', 8, 1.0, 'gpqa')) AS t(name, path, n_samples, temperature, rm_type)""")
def d22_c23_eval_datasets(spark: SparkSession, d: str) -> DataFrame:
    """A configuration resolved: the data set's own value, the defaults', the arguments'."""
    given = {"aime": {"path": "/d/a.jsonl", "n": 4}, "gpqa": {"path": "/d/g.jsonl", "rm_type": "gpqa", "temperature": 1.0}}
    fields = {"n_samples": (("n_samples", "n"), ("n_samples",), ("eval_n", "n")), "temperature": (("temperature",), ("temperature",), ("temperature",)), "rm_type": (("rm_type",), ("rm_type",), ("rm_type",))}
    rows = [eval_config.resolved(x, {"temperature": 0.7}, {"eval_n": None, "n": 8, "rm_type": "math"}, fields) for x in eval_config.datasets(given)]
    return spark.createDataFrame([(r["name"], r["path"], r["n_samples"], r["temperature"], r["rm_type"]) for r in rows], "name string, path string, n_samples int, temperature double, rm_type string")


# -- metrics ------------------------------------------------------------------------------

_PATHS = "m AS (SELECT group_index, coalesce(reward > 0.5, false) AS success, coalesce(reward > 0.5 AND response_length <= 200, false) AS optimal, coalesce(status, 'none') AS reason FROM s WHERE group_index IN (SELECT group_index FROM s GROUP BY 1 HAVING count(*) = 8))"


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Whole groups of eight as validated paths: success by reward, optimal if also short, reason by status."""
    s = samples(spark, d)
    whole = s.groupBy("group_index").agg(F.count("*").alias("n")).where("n = 8").select("group_index")
    success = F.coalesce(F.col("reward") > 0.5, F.lit(False))
    return s.join(whole, "group_index").select("group_index", success.alias("success"), F.coalesce(success & (F.col("response_length") <= 200), F.lit(False)).alias("optimal"), F.coalesce("status", F.lit("none")).alias("reason"))


_PASS = "CASE WHEN 8 - {c} < {k} THEN 1.0 ELSE 1.0 - list_product([(8.0 - {c} - i) / (8.0 - i) FOR i IN range({k})]) END"
_AVG = "SELECT '{p}pass@{k}' AS metric, avg({e}) AS value FROM g"


@query(f"""WITH {S}, {_PATHS}, g AS (SELECT group_index, sum(CAST(success AS INT)) AS a, sum(CAST(optimal AS INT)) AS b FROM m GROUP BY 1), r AS ({" UNION ALL ".join(_AVG.format(p=p, k=k, e=_PASS.format(c=c, k=k)) for k in (1, 2, 4, 8) for p, c in (("", "a"), ("optimal_", "b")))}
UNION ALL SELECT 'success_rate', avg(CAST(success AS INT)) FROM m UNION ALL SELECT 'optimal_rate', avg(CAST(optimal AS INT)) FROM m UNION ALL SELECT 'reason/' || reason, count(*) * 1.0 / (SELECT count(*) FROM m) FROM m GROUP BY reason) SELECT metric, round(value, 6) + 0.0 AS value FROM r""")
def e4_path_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return metrics.maze_report(paths(spark, d), (1, 2, 4, 8), size=8).select("metric", r6("value").alias("value"))


@query(f"""WITH {S}, {_PATHS} SELECT 'success_rate' AS metric, round(avg(CAST(success AS INT)), 6) + 0.0 AS value FROM m UNION ALL SELECT 'optimal_rate', round(avg(CAST(optimal AS INT)), 6) + 0.0 FROM m UNION ALL SELECT 'reason/' || reason, round(count(*) * 1.0 / (SELECT count(*) FROM m), 6) + 0.0 FROM m GROUP BY reason""")
def e21_path_training(spark: SparkSession, d: str) -> DataFrame:
    return metrics.maze_train_metrics(paths(spark, d)).select("metric", r6("value").alias("value"))


@query(f"""WITH {S}, g AS (SELECT group_index, count(*) AS n, sum(CASE WHEN reward > 0.5 THEN 1 ELSE 0 END) AS c FROM s WHERE group_index IS NOT NULL GROUP BY 1), k AS (SELECT *, unnest([1, 2, 4, 8]) AS k FROM g)
SELECT group_index, k, round(CASE WHEN n - c < k THEN 1.0 ELSE 1.0 - list_product([(n - c - i) * 1.0 / (n - i) FOR i IN range(k)]) END, 6) + 0.0 AS pass_rate FROM k WHERE k <= n""")
def e3_strict_pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    """The product form per group, for every k that a group allows."""
    g = samples(spark, d).where("group_index is not null").groupBy("group_index").agg(F.count("*").alias("n"), F.sum(F.when(F.col("reward") > 0.5, 1).otherwise(0)).alias("c"))
    k = g.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 4, 8))))).where("k <= n")
    return k.select("group_index", "k", r6(batched(metrics.strict_pass_at_k, "double")("n", "c", "k")).alias("pass_rate"))


@query("""WITH x AS (SELECT CAST(n_chars AS DOUBLE) AS v FROM documents WHERE n_chars IS NOT NULL), q AS (SELECT quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM x), c AS (SELECT v FROM x, q WHERE v BETWEEN lo AND hi), e AS (SELECT min(v) AS a, max(v) AS b, least(40, count(DISTINCT v)) AS n FROM c),
f AS (SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS a, CASE WHEN a = b THEN b + 0.5 ELSE b END AS b, CAST(n AS INT) AS n FROM e), k AS (SELECT CAST(CASE WHEN v < lo THEN 0 WHEN v > hi THEN n + 1 ELSE least(floor((v - a) / ((b - a) / n)) + 1, n) END AS INT) AS bin FROM x, q, f), t AS (SELECT bin, count(*) AS n FROM k GROUP BY 1)
SELECT CAST(i AS INT) AS bin, round(CASE WHEN i = f.n + 1 THEN hi WHEN i > 0 THEN a + (i - 1) * (b - a) / f.n END, 6) AS low, round(CASE WHEN i = 0 THEN lo WHEN i <= f.n THEN a + i * (b - a) / f.n END, 6) AS high, coalesce(t.n, 0) AS n FROM f, q, (SELECT unnest(range(42)) AS i) LEFT JOIN t ON t.bin = i WHERE i <= f.n + 1""")
def e32_adaptive_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.adaptive_histogram(table(spark, d, "documents"), "n_chars", 40).select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query(f"""WITH {S}, g AS (SELECT *, avg(reward) OVER w AS m, coalesce(stddev_samp(reward) OVER w, 0) AS sd, count(*) OVER w AS n, sum(reward) OVER w AS total FROM s WHERE reward IS NOT NULL WINDOW w AS (PARTITION BY group_index))
SELECT 'grpo' AS estimator, sample_index, round((reward - m) / (sd + 1e-6), 6) + 0.0 AS advantage FROM g UNION ALL SELECT 'rloo', sample_index, CASE WHEN n > 1 THEN round(reward - (total - reward) / (n - 1), 6) + 0.0 END FROM g UNION ALL SELECT 'reinforce_plus_plus_baseline', sample_index, round(reward - m, 6) + 0.0 FROM g""")
def f11_every_estimator(spark: SparkSession, d: str) -> DataFrame:
    """The dispatcher by name, for three kinds of estimator."""
    s = samples(spark, d).where("reward is not null")
    parts = [advantages.advantages(s, name).select(F.lit(name).alias("estimator"), "sample_index", r6_scaled("advantage").alias("advantage")) for name in ("grpo", "rloo", "reinforce_plus_plus_baseline")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def f18_strict_retry(spark: SparkSession, d: str) -> DataFrame:
    """Tool-use rewards: the loose grader first, the strict one where the loose one found no answer, then the shaping by turns."""
    s = table(spark, d, "samples").where(r"label rlike '^-?[0-9]+$'").select("sample_index", "session_id", "response", "label").distinct()
    loose = batched(lambda r, t: G.integer_answer_reward(r, t) if r is not None and "answer" in r.lower() else None, "double")("response", "label")
    score = advantages.strict_retry(loose, batched(G.strict_box_reward, "double")("response", "label"))
    turns = table(spark, d, "turns").where("session_id is not null").groupBy("session_id").agg(F.count_distinct("turn").alias("turns"))
    scored = s.select("sample_index", "session_id", score.alias("score")).join(turns, "session_id", "left")
    return scored.select("sample_index", "score", r6(advantages.tool_shaped(F.col("score"), F.coalesce("turns", F.lit(2)))).alias("shaped"))


@query()
def e6_sample_metrics(spark: SparkSession, d: str) -> DataFrame:
    """(source, responses, effective length statistics, truncated ratio, share of repetitive responses, share of groups without spread)."""
    s = table(spark, d, "samples").select("sample_index", "source", "group_index", "response", "response_length", "status", "reward").distinct()
    lengths = metrics.statistics(s, "response_length", ["source"]).drop("n")
    per = s.groupBy("source").agg(F.count("*").alias("responses"), r6(F.avg((F.col("status") == "truncated").cast("double"))).alias("truncated_ratio"), r6(F.avg(batched(G.repetitive, "boolean")("response").cast("double"))).alias("repetitive"))
    spread = s.groupBy("source", "group_index").agg(F.stddev_samp("reward").alias("std"))
    flat = spread.groupBy("source").agg(r6(F.avg((~F.coalesce(F.col("std") > 1e-6, F.lit(False))).cast("double"))).alias("zero_std_groups"))
    named = lambda df, k: df.withColumnRenamed("source", k)
    out = per.join(named(lengths, "s1"), F.col("source").eqNullSafe(F.col("s1")), "left").join(named(flat, "s2"), F.col("source").eqNullSafe(F.col("s2")), "left")
    return out.drop("s1", "s2")


@query()
def k4_k7_search_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Search transcripts made of each response: every third without information, every fifth with another answer."""

    def score(i, response, label):
        i, found = int(i), "" if int(i) % 3 == 0 else f"<information>It is {label}.</information>"
        text = f"<think>{response}</think><search>what</search>{found}<think>so</think><answer>{label if i % 5 else 'nothing'}</answer>"
        return G.search_reward(f"<answer>x</answer>{text}", [str(label)])

    s = table(spark, d, "samples").where("label is not null").select("sample_index", F.coalesce("response", F.lit("")).alias("response"), "label").distinct()
    return s.select("sample_index", r6(batched(score, "double")("sample_index", "response", "label")).alias("reward"))


@query()
def k9_normalized_math(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "samples").select("sample_index", "response").distinct()
    return p.select("sample_index", batched(lambda r: G.normalize_math(G.last_boxed(r)), "string")("response").alias("normalized"))


# -- between generation and training ------------------------------------------------------


@query("""SELECT sample_index, k AS sibling, sample_index AS rollout_id FROM (SELECT DISTINCT sample_index FROM samples WHERE sample_index IS NOT NULL), (SELECT unnest(range(3)) AS k) WHERE k <= sample_index % 3""")
def o_fan_out(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").where("sample_index is not null").select("sample_index").distinct()
    return rollouts.fan_out(s, "sample_index", 3).select("sample_index", "sibling", "rollout_id")


@query("""SELECT sample_index, CAST(least(sample_index % 5, 2) AS INT) + 1 AS attempts, sample_index % 5 > 2 AS given_up FROM (SELECT DISTINCT sample_index FROM samples WHERE sample_index IS NOT NULL)""")
def l2_requeued_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples that fail index % 5 times, with at most three attempts."""
    s = table(spark, d, "samples").where("sample_index is not null").select("sample_index").distinct()
    out = rollouts.requeued(s, lambda rows, attempt: rows.withColumn("status", F.when(F.col("sample_index") % 5 >= attempt, "aborted").otherwise("completed")), "status = 'aborted'", 3)
    return out.select("sample_index", "attempts", "given_up")


@query("""WITH r AS (SELECT group_index, k FROM (SELECT DISTINCT group_index FROM samples WHERE group_index IS NOT NULL), (SELECT unnest(range(8)) AS k)), f AS (SELECT group_index, count(DISTINCT sample_index) AS n FROM samples WHERE status = 'completed' AND group_index IS NOT NULL GROUP BY 1) SELECT r.group_index, CAST(k // 4 AS INT) AS round, CAST(k % 4 AS INT) AS copy FROM r LEFT JOIN f USING (group_index) WHERE k >= coalesce(n, 0)""")
def l15_open_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Eight places of each group (two rounds of four), less one for each sample that is done."""
    g = table(spark, d, "samples").where("group_index is not null").select("group_index").distinct()
    done = table(spark, d, "samples").where("status = 'completed'").select("group_index", "sample_index").distinct()
    return rollouts.without_finished(rollouts.repeated(g, 2, 4), done, "group_index", ["round", "copy"])


@query("""WITH e AS (SELECT problem_id, row_number() OVER (ORDER BY md5('5|' || problem_id), problem_id) - 1 AS position FROM problems) SELECT 0 AS epoch, position, problem_id FROM e WHERE position >= 60 AND position < 90""")
def l5_resumed_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of thirty are taken and the cursor is saved; the third comes from the restored one."""
    p = table(spark, d, "problems").select("problem_id")
    n = p.count()
    cursor = rollouts.Cursor("problem_id", 5, n)
    for _ in range(2):
        cursor.take(p, 30)
    return rollouts.Cursor.restored(cursor.saved(), n).take(p, 30).select("epoch", "position", "problem_id")


_SNIPPETS = " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{p}'" for p in rollouts.UNSAFE)


@query(f"SELECT doc_id, CASE {_SNIPPETS} END AS reason FROM documents WHERE text IS NOT NULL")
def o_unsafe_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The first unsafe pattern that a text holds, imports apart."""
    t = table(spark, d, "documents").where("text is not null")
    reason = rollouts.unsafe_reason(F.col("text"), ())
    return t.select("doc_id", F.when(~reason.startswith("import of "), reason).alias("reason"))


# -- joins --------------------------------------------------------------------------------


@query("""WITH b AS (SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1, 2, 3) SELECT l_orderkey, l_linenumber, b.n, round(b.price, 4) + 0.0 AS price FROM lineitem JOIN b USING (l_partkey, l_suppkey, l_returnflag) WHERE l_quantity >= 45""")
def h1_three_keys(spark: SparkSession, d: str) -> DataFrame:
    """Equi-join on three keys; the build side must hold a key once."""
    line = table(spark, d, "lineitem")
    keys = ["l_partkey", "l_suppkey", "l_returnflag"]
    build = line.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("price"))
    out = joins.keyed(line.where("l_quantity >= 45").select(*keys, "l_orderkey", "l_linenumber"), build, keys)
    return out.select("l_orderkey", "l_linenumber", "n", (F.round("price", 4) + F.lit(0.0)).alias("price"))


@query("""SELECT o_orderpriority, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.05 AND l_orderkey IS NOT NULL) THEN 'eval' ELSE 'train' END AS part, count(*) AS n FROM orders GROUP BY 1, 2""")
def h4_membership_split(spark: SparkSession, d: str) -> DataFrame:
    """Both halves of a split by membership."""
    keys = table(spark, d, "lineitem").where("l_discount >= 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    inside, outside = joins.members(table(spark, d, "orders"), keys, "o_orderkey")
    both = inside.withColumn("part", F.lit("eval")).unionByName(outside.withColumn("part", F.lit("train")))
    return both.groupBy("o_orderpriority", "part").agg(F.count("*").alias("n"))


@query(f"""WITH {S}, p AS (SELECT sample_index, row_number() OVER (ORDER BY sample_index) - 1 AS pos FROM s), c AS (SELECT *, pos // 4 AS mb FROM p) SELECT s.sample_index, CAST(mb % 8 AS INT) AS rank, mb // 8 AS micro_batch, CAST(pos % 4 AS INT) AS position, response_length FROM s JOIN c ON s.sample_index = c.sample_index""")
def h11_schedule_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Where each sample is in a schedule of micro-batches of four, dealt to eight ranks in turn."""
    from millrace.operators.transforms import positioned

    s = samples(spark, d)
    placed = positioned(s.select("sample_index"), ["sample_index"], "pos")
    batch = F.floor(F.col("pos") / 4)
    schedule = placed.select("sample_index", (batch % 8).cast("int").alias("rank"), F.floor(batch / 8).alias("micro_batch"), (F.col("pos") % 4).cast("int").alias("position"))
    return joins.keyed(s.select("sample_index", "response_length"), schedule, ["sample_index"]).select("sample_index", "rank", "micro_batch", "position", "response_length")


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, event_id AS click, value FROM events WHERE event_type = 'click')
SELECT l.event_id, r.click AS click_as_of, round(r.value, 2) AS value_as_of FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def h12_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The last click of a user before each purchase."""
    e = table(spark, d, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", "event_id", F.col("event_id").alias("click"), "value")
    out = joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "event_id", ["click", "value"])
    return out.select("event_id", "click_as_of", F.round("value_as_of", 2).alias("value_as_of"))


# -- scans and sinks, as round trips over whole tables ------------------------------------


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query("SELECT * FROM customer")
def a2_parquet_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.read(spark, f"{d}/customer.parquet")


@query("SELECT * FROM customer ORDER BY c_custkey LIMIT 150 OFFSET 100")
def a3_row_slice(spark: SparkSession, d: str) -> DataFrame:
    """A stated feature: rows 100 to 249 in the order of the key."""
    return readers.read(spark, f"{d}/customer.parquet@[100:250]", ["c_custkey"])


@query("SELECT raw_id, file_name, line_number, payload FROM raw_records")
def a1_b3_jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """JSONL written and scanned again, with a file of blank and broken lines beside it."""
    path = f"{_folder(spark, 'records')}.jsonl"
    rows = table(spark, d, "raw_records").select("raw_id", "file_name", "line_number", "payload")
    sinks.jsonl(rows, path)
    spark.createDataFrame([("",), ("   ",), ("{broken",)], "value string").coalesce(1).write.mode("append").text(path)
    return readers.jsonl(spark, path, rows.schema).where("raw_id is not null")


@query("""SELECT problem_id, question, answer_value, split FROM problems WHERE problem_id NOT IN (SELECT problem_id FROM problems WHERE split <> 'train')""")
def a5_a6_without_eval(spark: SparkSession, d: str) -> DataFrame:
    """Pruned columns without the ids of the eval set, which is checked first."""
    ids = table(spark, d, "problems").where("split <> 'train'").select("problem_id")
    return readers.without_eval(spark, f"{d}/problems.parquet", ["problem_id", "question", "answer_value", "split"], ids, "problem_id")


@query("""SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT problem_id FROM problems)""")
def a13_fetched_documents(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "problems").select(F.col("problem_id").alias("doc_id")).distinct()
    return readers.fetched(table(spark, d, "documents").select("doc_id", "text"), wanted)


@query("""SELECT problem_id, coalesce(question, '') AS question, coalesce(answer_value, '') AS answer_value, coalesce(split, '') AS split FROM problems""")
def b1_b2_fixed_schema(spark: SparkSession, d: str) -> DataFrame:
    """A stage's artifact under a fixed schema with lineage, reloaded only if both are the ones expected."""
    path, lineage = _folder(spark, "artifact"), {"stage": "audit", "version": 1}
    schema = T.StructType([T.StructField("problem_id", T.LongType(), False), *[T.StructField(c, T.StringType(), False) for c in ("question", "answer_value", "split")]])
    rows = table(spark, d, "problems").select("problem_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("question", "answer_value", "split")])
    sinks.parquet(rows, path, schema, lineage)
    return sinks.reloaded(spark, path, lineage, rows.select("problem_id"))


@query("""SELECT DISTINCT sample_index, rollout_id // 64 AS rollout_id, source, response_length, status, reward FROM samples WHERE rollout_id IS NOT NULL""")
def b4_rollout_dump(spark: SparkSession, d: str) -> DataFrame:
    """Samples dumped by step, of 64 rollouts each, and read again."""
    path = _folder(spark, "dump")
    rows = table(spark, d, "samples").where("rollout_id is not null").select("sample_index", F.floor(F.col("rollout_id") / 64).alias("rollout_id"), "source", "response_length", "status", "reward").distinct()
    sinks.rollout_dump(rows.repartition("rollout_id"), path)
    return spark.read.schema(rows.schema.add("evaluation", "boolean")).parquet(path).where("not evaluation").select("sample_index", "rollout_id", "source", "response_length", "status", "reward")


@query(f"""WITH {E}, s AS (SELECT span_id, min(name) AS name, min(parent_span_id) AS parent FROM e WHERE type = 'span_start' GROUP BY 1), n AS (SELECT span_id, min(name) AS name, min(parent_span_id) AS parent FROM e WHERE type = 'span_end' GROUP BY 1)
SELECT coalesce(s.span_id, n.span_id) AS span_id, coalesce(s.name, n.name) AS name, CASE WHEN n.span_id IS NULL THEN 'open' WHEN s.span_id IS NULL THEN 'orphan' ELSE 'closed' END AS state FROM s FULL JOIN n ON s.span_id = n.span_id""")
def b9_timeline_cache(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a trace kept beside it; the second request reads what the first one wrote."""
    root = _folder(spark, "timelines")
    build = lambda: intervals.paired_spans(events(spark, d, *SPAN)).select("span_id", "name", "state")
    for _ in range(2):
        out = cache.cached(spark, f"{d}/trace_events.parquet", root, "1", build)
    return out


@query("""SELECT problem_id, substr(coalesce(question, ''), 1, 0) AS nothing, 'prompt ' || coalesce(question, '') AS prompt FROM problems WHERE question IS NOT NULL""")
def c5_row_processors(spark: SparkSession, d: str) -> DataFrame:
    """Stages named by dotted path, applied in order."""
    from millrace.operators import registry

    rows = table(spark, d, "problems").select("problem_id", "question")
    return registry.apply_stages(rows, ["millrace.plans.contracts.asked", "millrace.plans.contracts.prompted"])


def asked(df: DataFrame) -> DataFrame:
    return df.where("question is not null")


def prompted(df: DataFrame) -> DataFrame:
    return df.select("problem_id", F.lit("").alias("nothing"), F.concat(F.lit("prompt "), "question").alias("prompt"))
