"""Queries of row preparation: templates, masks, arrays, audits, curation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import content, unit_audit
from millrace.functions import tokens as K
from millrace.functions.udfs import batched
from millrace.operators import filters, transforms
from millrace.operators.units import scaled_unit
from millrace.plans.base import log10_sql, r6
from millrace.runtime import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""SELECT problem_id, 'Q' || problem_id || ' [' || split || ']: ' || question || chr(10) || 'Cost: $5' AS prompt FROM problems WHERE question IS NOT NULL""")
def c6_prompt_template(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems").where("question is not null")
    return p.select("problem_id", transforms.fill_template("Q$problem_id [${split}]: $question\nCost: $$5", {c: F.col(c) for c in ("problem_id", "split", "question")}).alias("prompt"))


@query("""SELECT DISTINCT sample_index, array_to_string(string_split(trim(regexp_replace(prompt, '\\s+', ' ', 'g')), ' ')[1:12], ' ') AS head FROM samples WHERE prompt IS NOT NULL""")
def c7_truncated_prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").where("prompt is not null").select("sample_index", transforms.truncated_words(F.col("prompt"), 12).alias("head")).distinct()


@query("""WITH t AS (SELECT DISTINCT sample_indices AS sample_index, len(tokens) AS n, response_lengths AS r FROM train_data WHERE tokens IS NOT NULL AND response_lengths IS NOT NULL) SELECT sample_index, CAST(least(r, n) AS BIGINT) AS response_length, CAST(n AS BIGINT) AS mask_size FROM t""")
def c13_c25_sft_masks(spark: SparkSession, d: str) -> DataFrame:
    """A mask over tokens that trains the response, and the response length read back from it."""
    t = table(spark, d, "train_data").where("tokens is not null and response_lengths is not null").select(F.col("sample_indices").alias("sample_index"), F.size("tokens").alias("n"), F.col("response_lengths").alias("r")).distinct()
    r = F.least("r", "n")
    mask = F.concat(F.array_repeat(F.lit(0), (F.col("n") - r).cast("int")), F.array_repeat(F.lit(1), r.cast("int")))
    return t.select("sample_index", transforms.sft_lengths(mask).cast("long").alias("response_length"), F.size(mask).cast("long").alias("mask_size"))


@query("""WITH t AS (SELECT DISTINCT session_id, turn, output_ids, output_log_probs FROM turns WHERE output_ids IS NOT NULL AND output_log_probs IS NOT NULL AND len(output_ids) = len(output_log_probs)) SELECT session_id, turn, CAST(2 * len(output_ids) AS BIGINT) AS tokens, CAST(len(output_ids) AS BIGINT) AS trained, round(coalesce(list_sum(output_log_probs), 0), 6) + 0.0 AS total FROM t""")
def c16_appended_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Trained output followed by as many tokens of a tool."""
    t = table(spark, d, "turns").where("output_ids is not null and output_log_probs is not null and size(output_ids) = size(output_log_probs)").select("session_id", "turn", "output_ids", "output_log_probs").distinct()
    empty, none = F.array().cast("array<int>"), F.array().cast("array<double>")
    m1, p1 = content.appended(empty, none, F.col("output_ids"), F.col("output_log_probs"), F.lit(True))
    m2, p2 = content.appended(m1, p1, F.col("output_ids"), F.lit(None).cast("array<double>"), F.lit(False))
    return t.select("session_id", "turn", F.size(m2).cast("long").alias("tokens"), F.aggregate(m2, F.lit(0).cast("long"), lambda s, x: s + x).alias("trained"), r6(K.total(p2)).alias("total"))


@query("""WITH t AS (SELECT DISTINCT session_id, turn, output_ids FROM turns WHERE len(output_ids) > 0) SELECT session_id, turn, CAST(list_sum(output_ids) AS BIGINT) AS total, CAST(len(output_ids) AS BIGINT) AS n FROM t""")
def c19_packed_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids packed as little-endian int32 in base64 and unpacked again."""
    t = table(spark, d, "turns").where("size(output_ids) > 0").select("session_id", "turn", "output_ids").distinct()
    little = F.array_join(F.transform("output_ids", lambda x: F.regexp_replace(F.lpad(F.hex(x), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1")), "")
    back = t.select("session_id", "turn", content.int32_array(F.base64(F.unhex(little))).alias("ids"))
    return back.select("session_id", "turn", F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.size("ids").cast("long").alias("n"))


@query("""SELECT DISTINCT sample_index, round(ln(1 + response_length) / ln(10), 6) + 0.0 AS y, round(exp(ln(1 + response_length)) - 1, 4) + 0.0 AS x FROM samples WHERE response_length IS NOT NULL AND response_length >= 0""")
def c24_log10p_targets(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").where("response_length >= 0").select("sample_index", "response_length").distinct()
    y = transforms.log10p(F.col("response_length").cast("double"))
    return s.select("sample_index", r6(y).alias("y"), (F.round(transforms.inverse_log10p(y), 4) + F.lit(0.0)).alias("x"))


@query("""SELECT session_id, string_agg('Doc ' || rn || '(Title: ' || coalesce(finish_reason, 'none') || ') turn ' || turn, chr(10) ORDER BY rn) AS passages FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, finish_reason NULLS FIRST) AS rn FROM (SELECT DISTINCT session_id, turn, finish_reason FROM turns WHERE session_id IS NOT NULL)) GROUP BY 1""")
def c29_passages(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turns").where("session_id is not null").select("session_id", "turn", "finish_reason").distinct()
    docs = F.transform(F.array_sort(F.collect_list(F.struct("turn", "finish_reason"))), lambda x: F.struct(F.coalesce(x["finish_reason"], F.lit("none")).alias("title"), F.concat(F.lit("turn "), x["turn"].cast("string")).alias("text")))
    return t.groupBy("session_id").agg(docs.alias("docs")).select("session_id", transforms.passages(F.col("docs")).alias("passages"))


@query("""SELECT doc_id, CASE WHEN length(text) > 256 THEN left(text, 256) || '...' ELSE text END AS compact FROM documents WHERE text IS NOT NULL""")
def c31_compact_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lengths are code points; the cut with its marker is the operator."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", transforms.compact_text(F.col("text")).alias("compact"))


@query("""WITH p AS (SELECT DISTINCT sample_index, prompt FROM samples WHERE prompt IS NOT NULL), s AS (SELECT sample_index, string_split('<image>' || prompt || '<image>', '<image>') AS p FROM p)
SELECT sample_index, array_to_string(flatten([CASE WHEN i > 1 AND p[i] <> '' THEN ['image', 'text'] WHEN i > 1 THEN ['image'] WHEN p[i] <> '' THEN ['text'] ELSE [] END FOR i IN range(1, len(p) + 1)]), '|') AS parts FROM s""")
def c2_c3_media_parts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with two placed images more, split into typed parts; placeholders that a prompt has of its own take images too."""

    def parts(prompt):
        text = f"<image>{prompt}<image>"
        items = content.split_media(text, {"image": [f"{i}.png" for i in range(text.count("<image>"))]})
        return "|".join(p["type"] for p in items)

    s = table(spark, d, "samples").where("prompt is not null").select("sample_index", "prompt").distinct()
    return s.select("sample_index", batched(parts, "string")("prompt").alias("parts"))


@query("""WITH t AS (SELECT DISTINCT session_id, turn, output_log_probs AS o FROM turns WHERE len(output_log_probs) > 0) SELECT session_id, turn, CAST(greatest(len(o) - 3, 0) AS BIGINT) AS trained FROM t""")
def d8_off_policy_masks(spark: SparkSession, d: str) -> DataFrame:
    """The first three tokens, from an older policy, are not trained."""
    t = table(spark, d, "turns").where("size(output_log_probs) > 0").select("session_id", "turn", "output_log_probs").distinct()
    mask = filters.off_policy_masked(F.transform("output_log_probs", lambda _: F.lit(1)), F.lit(3))
    return t.select("session_id", "turn", K.total(mask).cast("long").alias("trained"))


@query("""SELECT problem_id, retained_for_merge FROM problems WHERE retained_for_merge AND unit_classification <> 'unit_required_but_unspecified'""")
def d14_unambiguous_units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "problems").where("retained_for_merge and unit_classification <> 'unit_required_but_unspecified'").select("problem_id", "retained_for_merge")


_LOG10 = log10_sql("answer_value")
_FIRST = "lower(trim(string_split(problem_source, '|')[1]))"


@query(f"""SELECT problem_id, round({_LOG10}, 6) + 0.0 AS log10_positive FROM problems""")
def k21_positive_log10(spark: SparkSession, d: str) -> DataFrame:
    from millrace.functions import grading

    return table(spark, d, "problems").select("problem_id", r6(batched(grading.positive_log10, "double")("answer_value")).alias("log10_positive"))


@query(f"""SELECT problem_id, round({_LOG10}, 6) + 0.0 AS log10_answer, CASE WHEN {_FIRST} LIKE 'synthfp%' THEN 'SynthFP' WHEN {_FIRST} LIKE 'realfp%' THEN 'RealFP' WHEN {_FIRST} LIKE 'fermi-eval%' THEN 'Fermi-Eval' END AS collection FROM problems WHERE {_LOG10} BETWEEN -100 AND 100""")
def d13_curated_problems(spark: SparkSession, d: str) -> DataFrame:
    """Problems whose positive answer lies within 100 decades of 1, with its logarithm and collection."""
    from millrace.functions import grading
    from millrace.functions.text import collection

    p = table(spark, d, "problems").withColumn("log10_answer", batched(grading.positive_log10, "double")("answer_value"))
    return p.where("log10_answer between -100 and 100").select("problem_id", r6("log10_answer").alias("log10_answer"), collection(F.get(F.split("problem_source", r"\|"), F.lit(0))).alias("collection"))


@query()
def k25_unit_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit of the question, and of the row: a unit in one of the two unit columns is a stated one too."""
    schema = "struct<classification: string, unit: string, reason: string, confidence: string, needs_review: boolean, row_classification: string>"

    @F.pandas_udf(schema)
    def run(q: pd.Series, u: pd.Series, v: pd.Series) -> pd.DataFrame:
        audits = [unit_audit.audit(x) for x in q]
        rows = [unit_audit.EXPLICIT if any(t and scaled_unit(t) for t in units) else a[0] for a, units in zip(audits, zip(u, v))]
        return pd.DataFrame([(*a, r) for a, r in zip(audits, rows)], columns=["classification", "unit", "reason", "confidence", "needs_review", "row_classification"])

    return table(spark, d, "problems").select("problem_id", run("question", "answer_unit", "specified_answer_unit").alias("a")).select("problem_id", "a.*")



@query("""WITH t AS (SELECT sample_index, list_distinct(list(name)) AS seen FROM trace_events WHERE sample_index IS NOT NULL GROUP BY 1) SELECT sample_index, CASE WHEN list_contains(seen, 'reward') AND list_contains(seen, 'sglang_generate') THEN 1.0 ELSE 0.0 END AS reward FROM t""")
def o_required_tests(spark: SparkSession, d: str) -> DataFrame:
    """Samples whose trace holds all required steps (the rule of required tests among those passed)."""
    t = table(spark, d, "trace_events").where("sample_index is not null").groupBy("sample_index").agg(F.collect_set("name").alias("seen"))
    return t.select("sample_index", content.tests_reward(F.array(F.lit("reward"), F.lit("sglang_generate")), F.col("seen")).alias("reward"))
