"""Queries on traces, splits, joins, retrieval and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.udfs import batched
from millrace.operators import filters, intervals, metrics, retrieval, splits, transforms
from millrace.plans.base import r6
from millrace.runtime import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


EVENT = ("event_id", "ts", "type", "name", "span_id", "parent_span_id", "sample_index", "engine_id", "prompt_tokens", "completion_tokens", "cached_tokens", "queue_time", "e2e_latency", "decode_throughput")
SPAN = ("ts", "type", "name", "span_id", "parent_span_id", "sample_index")
E = "e AS (SELECT DISTINCT event_id, ts, type, name, span_id, parent_span_id, sample_index, engine_id, prompt_tokens, completion_tokens, cached_tokens, queue_time, e2e_latency, decode_throughput FROM trace_events)"


def events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Events once each, with the columns asked for only (rows delivered again are equal rows)."""
    return table(spark, d, "trace_events").select("event_id", *(columns or EVENT[1:])).distinct()


# intervals in milliseconds, so that both engines compare whole numbers
BUSY = f"{E}, b AS (SELECT engine_id, span_id, name, CAST(round((ts - e2e_latency) * 1000) AS BIGINT) AS \"start\", CAST(round(ts * 1000) AS BIGINT) AS \"end\" FROM e WHERE e2e_latency IS NOT NULL AND NOT isnan(e2e_latency) AND e2e_latency >= 0)"


def busy(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "ts", "name", "span_id", "engine_id", "e2e_latency").where("e2e_latency is not null and not isnan(e2e_latency) and e2e_latency >= 0")
    ms = lambda c: F.round(c * 1000).cast("long")
    return e.select("engine_id", "span_id", "name", ms(F.col("ts") - F.col("e2e_latency")).alias("start"), ms(F.col("ts")).alias("end"))


# -- request metrics ----------------------------------------------------------------------


@query(f"""WITH {E}, u AS (SELECT 'queue_time' AS key, queue_time AS v FROM e WHERE name = 'sglang_generate' AND type = 'span_end' UNION ALL SELECT 'e2e_latency', e2e_latency FROM e WHERE name = 'sglang_generate' AND type = 'span_end' UNION ALL SELECT 'decode_throughput', decode_throughput FROM e WHERE name = 'sglang_generate' AND type = 'span_end')
SELECT key, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(median(v), 6) + 0.0 AS median, round(max(v), 6) + 0.0 AS max, round(min(v), 6) + 0.0 AS min FROM u WHERE v IS NOT NULL AND isfinite(v) GROUP BY key""")
def e8_request_performance(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the finite measures of generation spans."""
    e = events(spark, d, "name", "type", "queue_time", "e2e_latency", "decode_throughput").where("name = 'sglang_generate' and type = 'span_end'")
    u = e.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("v")) for k in ("queue_time", "e2e_latency", "decode_throughput")])).alias("x")).select("x.key", "x.v")
    u = u.where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    return metrics.statistics(u, "v", ["key"]).select("key", "n", *[r6(c).alias(c) for c in ("mean", "median", "max", "min")])


@query(f"""WITH {E} SELECT engine_id, round(avg(CASE WHEN prompt_tokens > 0 THEN completion_tokens * 1.0 / prompt_tokens ELSE 0 END), 6) + 0.0 AS mean_ratio, round(CASE WHEN sum(prompt_tokens) > 0 THEN sum(cached_tokens) * 1.0 / sum(prompt_tokens) ELSE 0 END, 6) + 0.0 AS cache_ratio, round(avg(cached_tokens), 6) + 0.0 AS mean_cached FROM e WHERE prompt_tokens IS NOT NULL GROUP BY engine_id""")
def e10_e11_token_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Mean of per-request ratios, and ratio of sums for the prefix cache."""
    e = events(spark, d, "engine_id", "prompt_tokens", "completion_tokens", "cached_tokens").where("prompt_tokens is not null")
    return e.groupBy("engine_id").agg(r6(F.avg(metrics.ratio(F.col("completion_tokens"), F.col("prompt_tokens")))).alias("mean_ratio"), r6(metrics.ratio(F.sum("cached_tokens"), F.sum("prompt_tokens"))).alias("cache_ratio"), r6(F.avg("cached_tokens")).alias("mean_cached"))


@query("""WITH t AS (SELECT DISTINCT sample_indices, len(tokens) AS n, response_lengths AS r FROM train_data WHERE tokens IS NOT NULL) SELECT count(*) AS samples, CAST(sum(n) AS BIGINT) AS tokens, round(sum(n) / 100.0 / 8, 6) + 0.0 AS tokens_per_gpu_second, round(sum(r) * 1.0 / sum(n), 6) + 0.0 AS trained_share FROM t""")
def e19_throughput(spark: SparkSession, d: str) -> DataFrame:
    """Tokens a GPU-second of a step of 100 s on 8 GPUs, and the share of trained tokens."""
    t = table(spark, d, "train_data").where("tokens is not null").select("sample_indices", F.size("tokens").alias("n"), F.col("response_lengths").alias("r")).distinct()
    return t.agg(F.count("*").alias("samples"), F.sum("n").alias("tokens"), r6(F.sum("n") / 100.0 / 8).alias("tokens_per_gpu_second"), r6(F.sum("r") * 1.0 / F.sum("n")).alias("trained_share"))


@query("""WITH t AS (SELECT DISTINCT sample_indices, rollout_ids, len(tokens) AS n, response_lengths AS r, rewards FROM train_data WHERE tokens IS NOT NULL AND rollout_ids IS NOT NULL), q AS (SELECT rollout_ids AS rollout_id, sum(rewards * r) AS s, sum(CASE WHEN rewards IS NOT NULL THEN r END) AS m FROM t GROUP BY 1) SELECT round(avg(s / greatest(m, 1)), 6) + 0.0 AS per_rollout, round(sum(s) / greatest(sum(m), 1), 6) + 0.0 AS per_token, count(*) AS rollouts FROM q""")
def e13_e18_rollout_means(spark: SparkSession, d: str) -> DataFrame:
    """Token-weighted mean per rollout, then over rollouts, against the plain token mean."""
    t = table(spark, d, "train_data").where("tokens is not null and rollout_ids is not null").select("sample_indices", F.col("rollout_ids").alias("rollout_id"), F.col("response_lengths").alias("r"), F.size("tokens").alias("n"), "rewards").distinct()
    q = t.groupBy("rollout_id").agg(F.sum(F.col("rewards") * F.col("r")).alias("s"), F.sum(F.when(F.col("rewards").isNotNull(), F.col("r"))).alias("m"))
    return q.agg(r6(F.avg(F.col("s") / F.greatest("m", F.lit(1)))).alias("per_rollout"), r6(F.sum("s") / F.greatest(F.sum("m"), F.lit(1))).alias("per_token"), F.count("*").alias("rollouts"))


@query("""WITH g AS (SELECT group_index, count(*) AS n, avg(reward) AS r FROM (SELECT DISTINCT sample_index, group_index, reward FROM samples) WHERE group_index IS NOT NULL GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total_samples, count(*) AS num_groups, round(avg(n), 6) + 0.0 AS avg_group_size, round(sum(r * n) / sum(CASE WHEN r IS NOT NULL THEN n END), 6) + 0.0 AS avg_reward FROM g""")
def e20_buffer_meta(spark: SparkSession, d: str) -> DataFrame:
    """Group metas merged by their sizes."""
    g = table(spark, d, "samples").select("sample_index", "group_index", "reward").distinct().where("group_index is not null").groupBy("group_index").agg(F.count("*").alias("n"), F.avg("reward").alias("r"))
    return g.agg(F.sum("n").alias("total_samples"), F.count("*").alias("num_groups"), r6(F.avg("n")).alias("avg_group_size"), r6(F.sum(F.col("r") * F.col("n")) / F.sum(F.when(F.col("r").isNotNull(), F.col("n")))).alias("avg_reward"))


@query("""SELECT CASE WHEN grouping(split) = 1 THEN 'ALL' ELSE split END AS split, CASE WHEN grouping(collection) = 1 THEN 'TOTAL' ELSE collection END AS collection, count(*) AS n FROM (SELECT split, trim(string_split(problem_source, '|')[1]) AS collection FROM problems) GROUP BY ROLLUP (split, collection)""")
def e31_split_source_counts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems").select("split", F.trim(F.get(F.split("problem_source", r"\|"), F.lit(0))).alias("collection"))
    r = p.rollup("split", "collection").agg(F.grouping("split").alias("gs"), F.grouping("collection").alias("gc"), F.count("*").alias("n"))
    return r.select(F.when(F.col("gs") == 1, "ALL").otherwise(F.col("split")).alias("split"), F.when(F.col("gc") == 1, "TOTAL").otherwise(F.col("collection")).alias("collection"), "n")


@query("""SELECT unit_classification, classification_confidence, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM problems), 6) + 0.0 AS share, CAST(sum(CASE WHEN needs_manual_review THEN 1 ELSE 0 END) AS BIGINT) AS review FROM problems GROUP BY 1, 2""")
def e31_unit_audit_counts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems")
    c = p.groupBy("unit_classification", "classification_confidence").agg(F.count("*").alias("n"), F.sum(F.col("needs_manual_review").cast("long")).alias("review"))
    total = c.agg(F.sum("n").alias("_all"))
    return c.join(F.broadcast(total)).select("unit_classification", "classification_confidence", "n", r6(F.col("n") / F.col("_all")).alias("share"), F.coalesce("review", F.lit(0)).alias("review"))


@query("""SELECT trim(answer_unit) AS unit, count(*) AS n FROM problems WHERE trim(answer_unit) <> '' GROUP BY 1 ORDER BY n DESC, unit LIMIT 20""")
def e31_top_units(spark: SparkSession, d: str) -> DataFrame:
    """A stated feature: the 20 most frequent units."""
    p = table(spark, d, "problems").select(F.trim("answer_unit").alias("unit")).where("unit <> ''")
    return p.groupBy("unit").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "unit").limit(20)


@query("""SELECT split, round(avg(w), 6) + 0.0 AS mean, round(quantile_cont(w, 0.5), 6) + 0.0 AS median, round(quantile_cont(w, 0.95), 6) + 0.0 AS p95, max(w) AS max, round(stddev_pop(w), 6) + 0.0 AS std FROM (SELECT split, CAST(len(string_split(trim(regexp_replace(question, '\\s+', ' ', 'g')), ' ')) AS BIGINT) AS w FROM problems WHERE question IS NOT NULL) GROUP BY split""")
def e31_token_statistics(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems").where("question is not null").select("split", F.greatest(transforms.word_count(F.col("question")), F.lit(1)).cast("long").alias("w"))
    plain = p.groupBy("split").agg(r6(F.avg("w")).alias("mean"), F.max("w").alias("max"), r6(F.stddev_pop("w")).alias("std"))
    out = metrics.with_quantiles(plain, metrics.exact_quantiles(p, "w", {"median": 0.5, "p95": 0.95}, ["split"]), ["split"])
    return out.withColumn("median", r6("median")).withColumn("p95", r6("p95"))


@query("""WITH x AS (SELECT n_chars AS v FROM documents WHERE n_chars IS NOT NULL), b AS (SELECT CASE WHEN v < 0 THEN 0 WHEN v > 3000 THEN 31 WHEN v = 3000 THEN 30 ELSE CAST(floor(v / 100.0) AS INT) + 1 END AS bin FROM x) SELECT bin, round((bin - 1) * 100.0, 6) AS low, round(bin * 100.0, 6) AS high, count(*) AS n FROM b GROUP BY bin""")
def e32_length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(table(spark, d, "documents"), "n_chars", 30, 0.0, 3000.0)


@query("""SELECT CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE coalesce(source, 'unknown') END AS source, count(*) AS rows, count(DISTINCT run_id) AS families, round(avg(n_chars), 6) + 0.0 AS mean_chars, CAST(min(created_at) AS DATE)::VARCHAR AS first_day, CAST(max(created_at) AS DATE)::VARCHAR AS last_day FROM documents GROUP BY GROUPING SETS ((source), ())""")
def e33_source_report(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    r = doc.groupingSets([["source"], []], "source").agg(F.grouping("source").alias("g"), F.count("*").alias("rows"), F.count_distinct("run_id").alias("families"), r6(F.avg("n_chars")).alias("mean_chars"), F.min("created_at").cast("date").cast("string").alias("first_day"), F.max("created_at").cast("date").cast("string").alias("last_day"))
    return r.select(F.when(F.col("g") == 1, "ALL").otherwise(F.coalesce("source", F.lit("unknown"))).alias("source"), "rows", "families", "mean_chars", "first_day", "last_day")


@query(f"""WITH {BUSY} SELECT name, engine_id, count(*) AS calls, CAST(sum("end" - "start") AS BIGINT) AS total_ms FROM b GROUP BY 1, 2 ORDER BY total_ms DESC, name, engine_id LIMIT 30""")
def e34_top_kernels(spark: SparkSession, d: str) -> DataFrame:
    """A stated feature: the 30 largest by total duration."""
    b = busy(spark, d).groupBy("name", "engine_id").agg(F.count("*").alias("calls"), F.sum(F.col("end") - F.col("start")).alias("total_ms"))
    return b.orderBy(F.col("total_ms").desc(), "name", "engine_id").limit(30)


@query()
def e35_conflicting_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions are compared in compatibility form, case folded, white space collapsed, for which there is no SQL."""
    p = table(spark, d, "problems").where("question is not null").select("answer_value", batched(text.normalize_question, "string")("question").alias("q"))
    return metrics.conflicts(p, ["q"], "answer_value")


# -- joins --------------------------------------------------------------------------------


@query("""SELECT p.problem_id FROM problems p WHERE p.split = 'train' AND NOT EXISTS (SELECT 1 FROM problems q WHERE q.split <> 'train' AND q.question = p.question)""")
def h2_decontaminated(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems")
    return splits.without(p.where("split = 'train'"), p.where("split <> 'train'"), "question").select("problem_id")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)""")
def h3_excluded_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of one table excluded from another, columns pruned at the scan."""
    bad = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return splits.without(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), bad, "o_orderkey")


@query("""SELECT s.sample_index, s.source, t.reward, t.n FROM (SELECT DISTINCT sample_index, source FROM samples) s JOIN (SELECT sample_indices, max(rewards) AS reward, CAST(max(len(tokens)) AS BIGINT) AS n FROM train_data WHERE sample_indices IS NOT NULL GROUP BY 1) t ON s.sample_index = t.sample_indices""")
def h1_h11_sample_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Build side made unique by its key before the join."""
    t = table(spark, d, "train_data").where("sample_indices is not null").groupBy(F.col("sample_indices").alias("sample_index")).agg(F.max("rewards").alias("reward"), F.max(F.when(F.col("tokens").isNotNull(), F.size("tokens"))).cast("long").alias("n"))
    return table(spark, d, "samples").select("sample_index", "source").distinct().join(t, "sample_index")


@query(f"""WITH {BUSY}, o AS (SELECT *, max("end") OVER (PARTITION BY engine_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY engine_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS isl FROM o), m AS (SELECT engine_id, isl, min("start") AS s, max("end") AS e FROM i GROUP BY 1, 2)
SELECT engine_id, CAST(sum(e - s) AS BIGINT) AS busy, CAST(max(e) - min(s) AS BIGINT) AS span, round(CASE WHEN max(e) > min(s) THEN sum(e - s) * 1.0 / (max(e) - min(s)) ELSE 0 END, 6) + 0.0 AS utilisation FROM m GROUP BY 1""")
def l10_utilisation(spark: SparkSession, d: str) -> DataFrame:
    """Union of the busy intervals of each engine; hot engines are cut into days first."""
    islands = intervals.merged_ranged(busy(spark, d), ["engine_id"])
    return intervals.utilisation(islands, ["engine_id"]).withColumn("utilisation", r6("utilisation"))


@query(f"""WITH {BUSY}, o AS (SELECT *, max("end") OVER (PARTITION BY engine_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b), g AS (SELECT engine_id, reach AS gap_start, "start" AS gap_end FROM o WHERE "start" > reach)
SELECT engine_id, gap_start, gap_end, gap_end - gap_start AS length FROM g ORDER BY length DESC, engine_id, gap_start LIMIT 15""")
def l10_longest_gaps(spark: SparkSession, d: str) -> DataFrame:
    """A stated feature: the 15 longest idle gaps."""
    islands = intervals.merged_ranged(busy(spark, d), ["engine_id"])
    return intervals.gaps(islands, ["engine_id"]).orderBy(F.col("length").desc(), "engine_id", "gap_start").limit(15)


@query(f"""WITH {BUSY}, o AS (SELECT *, max("end") OVER (PARTITION BY engine_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b), g AS (SELECT engine_id, reach AS gap_start, "start" AS gap_end FROM o WHERE "start" > reach), t AS (SELECT DISTINCT engine_id, CAST(round(ts * 1000) AS BIGINT) AS p, name FROM e WHERE e2e_latency IS NULL)
SELECT g.engine_id, gap_start, gap_end, min(p) AS op_start FROM g JOIN t ON g.engine_id = t.engine_id AND p < gap_end AND p + 60000 > gap_start GROUP BY 1, 2, 3""")
def h6_gap_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """First minute-long event without a latency that overlaps each idle gap."""
    islands = intervals.merged_ranged(busy(spark, d), ["engine_id"])
    g = intervals.gaps(islands, ["engine_id"])
    o = events(spark, d, "ts", "name", "engine_id", "e2e_latency").where("e2e_latency is null").select("engine_id", "name", F.round(F.col("ts") * 1000).cast("long").alias("start")).distinct().withColumn("end", F.col("start") + 60_000)
    return intervals.first_overlap(g, o, "engine_id", 3_600_000.0).select("engine_id", "gap_start", "gap_end", "op_start")


@query(f"""WITH {E}, s AS (SELECT span_id, min(ts) AS start_ts, min(name) AS name, min(parent_span_id) AS parent FROM e WHERE type = 'span_start' GROUP BY 1), n AS (SELECT span_id, max(ts) AS end_ts, min(name) AS name, min(parent_span_id) AS parent FROM e WHERE type = 'span_end' GROUP BY 1)
SELECT coalesce(s.span_id, n.span_id) AS span_id, coalesce(s.name, n.name) AS name, coalesce(s.parent, n.parent) AS parent_span_id, CASE WHEN n.span_id IS NULL THEN 'open' WHEN s.span_id IS NULL THEN 'orphan' ELSE 'closed' END AS state FROM s FULL JOIN n ON s.span_id = n.span_id""")
def h7_paired_spans(spark: SparkSession, d: str) -> DataFrame:
    return intervals.paired_spans(events(spark, d, *SPAN)).select("span_id", "name", "parent_span_id", "state")


@query(f"""WITH {E}, s AS (SELECT span_id, min(name) AS name, min(parent_span_id) AS parent FROM e GROUP BY 1) SELECT c.span_id, p.name AS parent_name, p.span_id IS NULL AS unknown_parent FROM s c LEFT JOIN s p ON c.parent = p.span_id WHERE c.parent IS NOT NULL""")
def h8_parent_names(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d, "span_id", "name", "parent_span_id").groupBy("span_id").agg(F.min("name").alias("name"), F.min("parent_span_id").alias("parent"))
    p = s.select(F.col("span_id").alias("parent"), F.col("name").alias("parent_name"))
    return s.where("parent is not null").drop("name").join(p, "parent", "left").select("span_id", "parent_name", F.col("parent_name").isNull().alias("unknown_parent"))


@query(f"""WITH RECURSIVE {E}, st AS (SELECT span_id, min(ts) AS s, min(parent_span_id) AS p, min(sample_index) AS si FROM e WHERE type = 'span_start' GROUP BY 1), en AS (SELECT span_id, max(ts) AS e, min(parent_span_id) AS p, min(sample_index) AS si FROM e WHERE type = 'span_end' GROUP BY 1),
x AS (SELECT coalesce(st.span_id, en.span_id) AS id, coalesce(st.p, en.p) AS parent, coalesce(st.si, en.si) AS si, s, e FROM st FULL JOIN en ON st.span_id = en.span_id),
w AS (SELECT si, id, 0 AS k, parent AS at, [id] AS seen, CAST(NULL AS DOUBLE) AS closed FROM x WHERE si IS NOT NULL UNION ALL SELECT w.si, w.id, k + 1, y.parent, list_append(seen, y.id), CASE WHEN y.s IS NOT NULL THEN y.e END FROM w JOIN x y ON y.si = w.si AND y.id = w.at WHERE NOT list_contains(seen, y.id)),
a AS (SELECT si, id, max(k) AS depth, arg_min(closed, k) FILTER (closed IS NOT NULL) AS above FROM w GROUP BY 1, 2),
n AS (SELECT si, id, lead(s) OVER (PARTITION BY si, parent ORDER BY s, id) AS next FROM x WHERE s IS NOT NULL AND si IS NOT NULL), l AS (SELECT si, max(greatest(s, e)) AS last FROM x GROUP BY 1)
SELECT x.si AS sample_index, x.id AS span_id, CAST(coalesce(depth, 0) AS INT) AS depth, round(CASE WHEN x.si IS NULL THEN coalesce(e, s) WHEN e IS NULL THEN least(last, next, above) ELSE e END, 6) + 0.0 AS shown_end FROM x LEFT JOIN a ON a.si = x.si AND a.id = x.id LEFT JOIN n ON n.si = x.si AND n.id = x.id LEFT JOIN l ON l.si = x.si""")
def l8_span_trees(spark: SparkSession, d: str) -> DataFrame:
    return intervals.clipped_tree(intervals.paired_spans(events(spark, d, *SPAN))).withColumn("shown_end", r6("shown_end"))


@query(f"""WITH {E}, r AS (SELECT engine_id, row_number() OVER (PARTITION BY engine_id ORDER BY ts, event_id) AS rn, ts, event_id, count(*) OVER (PARTITION BY engine_id) AS n FROM e WHERE name = 'weight_sync') SELECT engine_id, CAST(floor((rn - 1) / 3) AS BIGINT) AS step, min(event_id) AS first_event, count(*) AS launches FROM r WHERE floor((rn - 1) / 3) < floor(n / 3) GROUP BY 1, 2""")
def l11_triples(spark: SparkSession, d: str) -> DataFrame:
    """Launches of each engine in full triples (a last incomplete one is no step)."""
    e = events(spark, d, "ts", "name", "engine_id").where("name = 'weight_sync'")
    r = transforms.positioned(e.select("engine_id", "event_id", "ts"), ["ts", "event_id"], "rn", 1, ["engine_id"], "n").where("floor((rn - 1) / 3) < floor(n / 3)")
    return r.groupBy("engine_id", F.floor((F.col("rn") - 1) / 3).alias("step")).agg(F.min("event_id").alias("first_event"), F.count("*").alias("launches"))


@query(ORACLE["l10_utilisation"].replace("SELECT engine_id, CAST(sum(e - s) AS BIGINT) AS busy, CAST(max(e) - min(s) AS BIGINT) AS span, round(CASE", ", z AS (SELECT CASE").replace(") + 0.0 AS utilisation FROM m GROUP BY 1", " AS u FROM m GROUP BY engine_id) SELECT count(*) AS ranks, round(max(u) - min(u), 6) + 0.0 AS spread, max(u) - min(u) > 0.05 AS imbalanced FROM z").replace("ELSE 0 END, 6 AS u", "ELSE 0 END AS u"))
def l12_imbalance(spark: SparkSession, d: str) -> DataFrame:
    islands = intervals.merged_ranged(busy(spark, d), ["engine_id"])
    u = intervals.utilisation(islands, ["engine_id"])
    return u.agg(F.count("*").alias("ranks"), r6(F.max("utilisation") - F.min("utilisation")).alias("spread"), (F.max("utilisation") - F.min("utilisation") > 0.05).alias("imbalanced"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, round(list_dot_product(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / greatest(sqrt(list_dot_product(CAST(qe AS DOUBLE[]), CAST(qe AS DOUBLE[]))), 1e-12) / greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12), 9) AS score FROM q, embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, rank, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 10""")
def h9_dense_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100 as a query against all vectors."""
    v = table(spark, d, "embeddings")
    out = retrieval.dense_top_k(v, v.where("vec_id % 100 = 0"), 10)
    return out.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


# words of letters, marks and digits of any script; scripts without spaces by pairs of neighbouring signs
_RUNS = r"""regexp_extract_all(regexp_replace(lower({x}), '([\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}]+)', ' \1 ', 'g'), '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}]+|[\p{{L}}\p{{N}}\p{{M}}]+')"""
_TERMS = rf"flatten([CASE WHEN regexp_matches(t, '^[\p{{{{Han}}}}\p{{{{Hiragana}}}}\p{{{{Katakana}}}}\p{{{{Thai}}}}]') AND length(t) > 1 THEN [t[i:i + 1] FOR i IN range(1, length(t))] ELSE [t] END FOR t IN {_RUNS}])"


@query(f"""WITH w AS (SELECT doc_id, {_TERMS.format(x='text')} AS w FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id, len(w) AS len, w FROM w WHERE len(w) > 0), st AS (SELECT count(*) AS n, avg(len) AS a FROM d),
tf AS (SELECT doc_id, any_value(len) AS len, term, count(*) AS tf FROM (SELECT doc_id, len, unnest(w) AS term FROM d) GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), q AS (SELECT problem_id AS query_id, term, count(*) AS qtf FROM (SELECT problem_id, unnest({_TERMS.format(x='question')}) AS term FROM problems WHERE problem_id % 100 = 0) GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * len / a))), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, rank, round(score, 5) + 0.0 AS score FROM r WHERE rank <= 5""")
def h10_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Every problem whose id is divisible by 100 as a query against all documents."""
    q = table(spark, d, "problems").where("problem_id % 100 = 0").select(F.col("problem_id").alias("query_id"), F.col("question").alias("text"))
    out = retrieval.bm25_top_k(table(spark, d, "documents"), q, 5)
    return out.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), (F.round("score", 5) + F.lit(0.0)).alias("score"))


# -- splits -------------------------------------------------------------------------------


@query("""WITH p AS (SELECT o_orderdate AS d, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT d, coalesce(sum(n) OVER (ORDER BY d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM p) SELECT CAST(max(d) AS DATE)::VARCHAR AS cut FROM a WHERE after > 1000""")
def i7_time_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.time_cut(table(spark, d, "orders"), "o_orderdate", 1000).select(F.col("cut").cast("date").cast("string").alias("cut"))


@query("""WITH f AS (SELECT run_id, count(*) AS rows FROM documents WHERE run_id IS NOT NULL GROUP BY 1), p AS (SELECT *, row_number() OVER w - 1 AS place, sum(rows) OVER w AS running, count(*) OVER () AS n FROM f WINDOW w AS (ORDER BY md5('42|' || run_id), run_id)),
b AS (SELECT arg_min(place, ROW(abs(running - 100), place)) AS best FROM p WHERE place < n - 1) SELECT run_id, rows, CASE WHEN place <= best THEN 'eval' ELSE 'train' END AS part FROM p, b""")
def i8_family_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.family_split(table(spark, d, "documents").where("run_id is not null"), "run_id", 100, 42)


@query("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), f AS (SELECT *, floor(n * 0.8) AS a, floor(n * 0.1) AS b, floor(n * 0.1) AS c, n * 0.8 - floor(n * 0.8) AS ra, n * 0.1 - floor(n * 0.1) AS rb FROM c), r AS (SELECT *, n - a - b - c AS rest FROM f)
SELECT p_brand, CAST(a + CASE WHEN (ra >= rb AND rest >= 1) OR (ra < rb AND rest >= 3) THEN 1 ELSE 0 END AS BIGINT) AS train, CAST(b + CASE WHEN (ra >= rb AND rest >= 2) OR (ra < rb AND rest >= 1) THEN 1 ELSE 0 END AS BIGINT) AS val, CAST(c + CASE WHEN (ra >= rb AND rest >= 3) OR (ra < rb AND rest >= 2) THEN 1 ELSE 0 END AS BIGINT) AS test FROM r""")
def i9_apportioned_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows per stratum and split after a largest-remainder split 80/10/10."""
    rows = splits.apportioned(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", [("train", 0.8), ("val", 0.1), ("test", 0.1)], 42)
    count = lambda k: F.sum((F.col("part") == k).cast("long")).alias(k)
    return rows.groupBy("p_brand").agg(count("train"), count("val"), count("test"))


@query("""SELECT problem_id, question FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY ingested_at, problem_id) AS rn FROM problems WHERE question IS NOT NULL) WHERE rn = 1""")
def i5_i6_first_wins(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems").where("question is not null").select("problem_id", "question", "ingested_at")
    return splits.first_wins(p, ["question"], ["ingested_at", "problem_id"]).select("problem_id", "question")


@query("""WITH n AS (SELECT count(*) AS n FROM problems), e AS (SELECT problem_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5((42 + epoch) || '|' || problem_id), problem_id) - 1 AS position FROM problems, (SELECT unnest([0, 1]) AS epoch)) SELECT CAST(epoch AS INT) AS epoch, position, problem_id FROM e, n WHERE (epoch = 0 AND position >= n - 20) OR (epoch = 1 AND position < 30)""")
def i2_i3_epoch_batches(spark: SparkSession, d: str) -> DataFrame:
    """A batch that spans the end of one epoch and the start of the next."""
    p = table(spark, d, "problems").select("problem_id")
    n = p.count()
    return splits.batch(p, "problem_id", 42, n - 20, 50, n).select("epoch", "position", "problem_id")


@query("""SELECT session_id, turn, count(*) AS rows FROM turns GROUP BY 1, 2 HAVING count(*) > 1""")
def i13_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return filters.unique(table(spark, d, "turns"), ["session_id", "turn"])


@query("""SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) + 0.0 AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((n_name, r_name), (r_name), ())""")
def i10_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupingSets([["n_name", "r_name"], ["r_name"], []], "n_name", "r_name").agg(F.count("*").alias("customers"), (F.round(F.sum("c_acctbal"), 2) + F.lit(0.0)).alias("balance"))


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.05) GROUP BY 1""")
def h4_semi_join(spark: SparkSession, d: str) -> DataFrame:
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_discount >= 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(l, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT sample_index FROM samples EXCEPT SELECT sample_indices FROM train_data""")
def i15_set_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").select("sample_index").subtract(table(spark, d, "train_data").select("sample_indices"))


@query("""WITH w AS (SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS t, count(*) AS n, round(sum(value), 2) + 0.0 AS v FROM events GROUP BY 1, 2) SELECT event_type, strftime(t, '%Y-%m-%d %H:%M:%S') AS start, n, v FROM w""")
def l14_tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("n"), (F.round(F.sum("value"), 2) + F.lit(0.0)).alias("v"))
    return w.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "v")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def l14_session_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
