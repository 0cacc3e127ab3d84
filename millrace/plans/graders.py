"""Grader queries over samples, problems and documents: batched UDFs where a grader needs code, SQL-checkable ones built in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import grading as G
from millrace.functions import text as X
from millrace.functions import mazes
from millrace.functions.udfs import batched
from millrace.operators import metrics
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


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").select("sample_index", "source", "prompt", "response", "label").distinct()


# word characters and white space of all of Unicode; an article is a whole run of word characters, marked at both ends
_WORDS, _SPACES = r"[\p{{L}}\p{{N}}_]", r"[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]"
_MARKED = rf"""regexp_replace(translate(lower({{x}}), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{{{|}}}}~', ''), '({_WORDS}+)', chr(57344) || '\1' || chr(57345), 'g')"""
_SQL_NORM = rf"""trim(regexp_replace(translate(regexp_replace({_MARKED}, chr(57344) || '(a|an|the)' || chr(57345), ' ', 'g'), chr(57344) || chr(57345), ''), '{_SPACES}+', ' ', 'g'))"""
_P = "(SELECT DISTINCT sample_index, response, label FROM samples WHERE response IS NOT NULL)"


def answered(spark: SparkSession, d: str) -> DataFrame:
    """All rows with a response, in any script."""
    return pairs(spark, d).where("response is not null").select("sample_index", "response", "label").distinct()


@query(f"SELECT sample_index, {_SQL_NORM.format(x='response')} AS normalized FROM {_P}")
def k1_normalized_answers(spark: SparkSession, d: str) -> DataFrame:
    return answered(spark, d).select("sample_index", X.normalized_answer(F.col("response")).alias("normalized"))


@query(f"""WITH p AS (SELECT sample_index, {_SQL_NORM.format(x='response')} AS a, {_SQL_NORM.format(x='label')} AS b FROM {_P} WHERE label IS NOT NULL),
ta AS (SELECT sample_index, w, count(*) AS n FROM (SELECT sample_index, unnest(string_split(a, ' ')) AS w FROM p WHERE a <> '') GROUP BY 1, 2), tb AS (SELECT sample_index, w, count(*) AS n FROM (SELECT sample_index, unnest(string_split(b, ' ')) AS w FROM p WHERE b <> '') GROUP BY 1, 2),
s AS (SELECT ta.sample_index, sum(least(ta.n, tb.n)) AS same FROM ta JOIN tb ON ta.sample_index = tb.sample_index AND ta.w = tb.w GROUP BY 1), na AS (SELECT sample_index, sum(n) AS n FROM ta GROUP BY 1), nb AS (SELECT sample_index, sum(n) AS n FROM tb GROUP BY 1)
SELECT p.sample_index, CASE WHEN s.same IS NULL OR (a <> b AND (a IN ('yes', 'no', 'noanswer') OR b IN ('yes', 'no', 'noanswer'))) THEN 0.0 ELSE round(2.0 * same / (na.n + nb.n), 6) + 0.0 END AS f1 FROM p LEFT JOIN s USING (sample_index) LEFT JOIN na USING (sample_index) LEFT JOIN nb USING (sample_index)""")
def k2_token_f1(spark: SparkSession, d: str) -> DataFrame:
    return answered(spark, d).where("label is not null").select("sample_index", r6(X.token_f1(F.col("response"), F.col("label"))).alias("f1"))


@query(f"SELECT sample_index, CASE WHEN {_SQL_NORM.format(x='response')} = {_SQL_NORM.format(x='label')} THEN 1 ELSE 0 END AS em FROM {_P} WHERE label IS NOT NULL")
def k3_exact_match(spark: SparkSession, d: str) -> DataFrame:
    same = X.normalized_answer(F.col("response")) == X.normalized_answer(F.col("label"))
    return answered(spark, d).where("label is not null").select("sample_index", same.cast("int").alias("em"))


# the content of the last box; the responses hold no braces within one
_BOX = r"regexp_extract(regexp_extract(response, '(?s).*(\\boxed.*)$', 1), '(?s)^\\boxed\{([^{}]*)\}', 1)"
_BOXED = r"regexp_matches(regexp_extract(response, '(?s).*(\\boxed.*)$', 1), '(?s)^\\boxed\{[^{}]*\}')"
_ANSWERED = "(SELECT DISTINCT sample_index, source, prompt, response, label FROM samples)"


@query(f"SELECT sample_index, CASE WHEN {_BOXED} THEN {_BOX} END AS boxed FROM {_ANSWERED}")
def k8_last_boxed(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("sample_index", batched(G.last_boxed, "string")("response").alias("boxed"))


@query()
def k8_k11_boxed_math(spark: SparkSession, d: str) -> DataFrame:
    reward = batched(G.math_reward, "double")
    box = batched(G.last_boxed, "string")
    return pairs(spark, d).select("sample_index", box("response").alias("boxed"), reward("response", "label").alias("reward"), batched(G.reasoned_math_reward, "double")("response", "label").alias("reasoned_reward"))


_BLANKS, _NOISES = (p.pattern.replace("'", "''") for p in (G._BLANK, G._NOISE))
_UNWRAP = r"regexp_replace({x}, '\\(?:text|mbox|textbf|overline|boxed)\{{([^{{}}]*)\}}', '\1', 'g')"
_UNWRAPPED = _UNWRAP.format(x=_UNWRAP.format(x=_UNWRAP.format(x="m")))


@query(rf"""WITH t AS (SELECT DISTINCT sample_index, coalesce(response, '') AS r, label FROM {_ANSWERED} WHERE regexp_full_match(label, '-?[0-9]+')),
a AS (SELECT *, coalesce(regexp_extract_all(right(r, 300), '(?i)answer\s*:\s*([^\n]+)', 1)[-1], '[INVALID]') AS x FROM t),
n AS (SELECT *, replace(regexp_replace(regexp_replace(regexp_extract(x, '[^=]*$'), '{_BLANKS}', '', 'g'), '{_NOISES}', '', 'g'), '.$', '$') AS n FROM a),
m AS (SELECT *, CASE WHEN regexp_matches(n, '\$.*?\$') THEN regexp_extract(n, '\$(.*?)\$', 1) ELSE n END AS m FROM n), u AS (SELECT *, trim(replace({_UNWRAPPED}, '$', '')) AS u FROM m),
g AS (SELECT *, CASE WHEN regexp_full_match(replace(u, ',', ''), '\d+') THEN replace(u, ',', '') ELSE u END AS given, regexp_extract(right(r, 100), '(?s).*(\\boxed\{{.*)$', 1) AS box FROM u)
SELECT sample_index, CASE WHEN given = CAST(CAST(label AS BIGINT) AS VARCHAR) THEN 1.0 ELSE -1.0 END AS reward, CASE WHEN regexp_matches(box, '^\\boxed\{{[^{{}}]*\}}') AND regexp_extract(box, '^\\boxed\{{([^{{}}]*)\}}', 1) = label THEN 1.0 ELSE -1.0 END AS strict_reward FROM g""")
def k12_integer_answer(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).where(r"label rlike '^-?[0-9]+$'")
    return p.select("sample_index", batched(G.integer_answer_reward, "double")("response", "label").alias("reward"), batched(G.strict_box_reward, "double")("response", "label").alias("strict_reward"))


_LETTER = "CASE WHEN regexp_matches(upper(regexp_extract(t, '(?i){p}', 1)), '^[A-J]$') THEN upper(regexp_extract(t, '(?i){p}', 1)) END"
_LETTERS_NAMED = ", ".join(_LETTER.format(p=p) for p in G.LETTER_PHRASES)
_PLAIN = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


@query(rf"""WITH a AS (SELECT sample_index, response, label, coalesce(string_split(response, '</think>')[-1], '') AS t FROM {_ANSWERED} WHERE source = 'gpqa'),
l AS (SELECT *, coalesce({_LETTERS_NAMED}, list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-J]'))[-1]) AS letter, CASE WHEN upper(trim(label)) IN ('A', 'B', 'C', 'D', 'E', 'F', 'G', 'H', 'I', 'J') THEN upper(trim(label)) END AS is_right, {_PLAIN.format(x="t")} AS said, {_PLAIN.format(x="label")} AS target FROM a)
SELECT sample_index, letter, CASE WHEN response IS NULL THEN 0.0 WHEN letter IS NOT NULL AND is_right IS NOT NULL THEN CASE WHEN letter = is_right THEN 1.0 ELSE 0.0 END WHEN coalesce(target, '') <> '' AND CASE WHEN length(target) > 1 THEN contains(said, target) ELSE list_contains(string_split(said, ' '), target) END THEN 1.0 ELSE 0.0 END AS reward FROM l""")
def k13_multiple_choice(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).where("source = 'gpqa'").select("sample_index", batched(lambda r: G.option_letter(r), "string")("response").alias("letter"), batched(lambda r, t: G.choice_reward(r, t), "double")("response", "label").alias("reward"))


@query()
def k15_dispatched_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Each row is graded by the grader of its source, with its metadata; a ``boxed_`` type hands over the last box's content."""
    from millrace.operators.registry import graded

    kinds = F.create_map(*[F.lit(x) for x in ("fermi", "fermi", "maze", "boxed_f1", "code_regression", "math", "gpqa", "gpqa", "forecast", "f1", "tool_session", "dapo")])
    p = table(spark, d, "samples").select("sample_index", "source", "response", "label", "metadata").distinct().withColumn("rm_type", F.element_at(kinds, F.col("source")))
    return graded(p, "rm_type", "response", "label", metadata="metadata").select("sample_index", "rm_type", r6("reward").alias("reward"))


@query()
def k17_repetition(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", batched(lambda t: round(G.compression_ratio(t), 6) if t else None, "double")("text").alias("ratio"), batched(G.repetitive, "boolean")("text").alias("repetitive"))


_PART, _WHITE = r"\d+(?:\.\d+)?", _SPACES.format()


@query(rf"""WITH a AS (SELECT problem_id, answer_value, regexp_replace(regexp_replace(regexp_replace(answer_value, '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g'), '^{_WHITE}+|{_WHITE}+$', '', 'g') AS s FROM problems), b AS (SELECT *, regexp_matches(s, '^[-+]?{_PART}{_WHITE}*/{_WHITE}*{_PART}') AS ratio, TRY_CAST(regexp_extract(s, '^[-+]?({_PART}){_WHITE}*/{_WHITE}*({_PART})', 1) AS DOUBLE) AS n, TRY_CAST(regexp_extract(s, '^[-+]?({_PART}){_WHITE}*/{_WHITE}*({_PART})', 2) AS DOUBLE) AS d, regexp_extract(s, '(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?') AS first FROM a)
SELECT problem_id, round(CASE WHEN ratio THEN CASE WHEN n > 0 AND d > 0 THEN log10(n / d) END ELSE {log10_sql("first")} END, 6) + 0.0 AS log10_magnitude, round({log10_sql("answer_value")}, 6) + 0.0 AS log10_positive FROM b""")
def k18_k21_log10_answers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems")
    return p.select("problem_id", r6(batched(G.source_answer_log10, "double")("answer_value")).alias("log10_magnitude"), r6(batched(G.positive_log10, "double")("answer_value")).alias("log10_positive"))


# a unit begins with a letter or any sign beyond ASCII that is no white space
_UNIT_HEAD = r"[A-Za-z\x{80}-\x{84}\x{86}-\x{9f}\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}]"
_NUMBER_HEAD = "(?s)^" + _SPACES.format() + r"*([-+]?[0-9][0-9.,]*)"


@query(f"""SELECT problem_id, regexp_extract(answer_value, '{_NUMBER_HEAD}', 1) AS value, regexp_extract(answer_value, '{_NUMBER_HEAD}{_SPACES.format()}*({_UNIT_HEAD}.*?){_SPACES.format()}*$', 2) AS unit FROM problems WHERE answer_value IS NOT NULL""")
def k19_split_answers(spark: SparkSession, d: str) -> DataFrame:
    value, unit = X.split_answer(F.col("answer_value"))
    return table(spark, d, "problems").where("answer_value is not null").select("problem_id", value.alias("value"), unit.alias("unit"))


@query()
def k20_normalized_questions(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: the compatibility form of Unicode is not in it."""
    p = table(spark, d, "problems").where("question is not null")
    return p.select("problem_id", batched(X.normalize_question, "string")("question").alias("normalized"))


_TEN = r"(?:([+]?[\d.,]+)(?:\\times|\\cdot|\*|x|×|·))?10\^(?:\{([+-]?\d+)\}|([+-]?\d+))"


@query(rf"""WITH t AS (SELECT sample_index, label, trim(regexp_replace(response, '(?i)(?:\s*<\|(?:im_end|endoftext)\|>)+\s*$', '')) AS response FROM {_ANSWERED} WHERE source = 'fermi'), b AS (SELECT *, CASE WHEN contains(response, '\boxed') THEN CASE WHEN {_BOXED} THEN {_BOX} END ELSE response END AS x FROM t),
s AS (SELECT sample_index, label, replace(replace(regexp_replace(trim(trim(x), '$'), '\\left|\\right|\\[,;:! ]|\\q?quad|\s+', '', 'g'), '−', '-'), '＋', '+') AS s FROM b),
l AS (SELECT *, coalesce(nullif(regexp_extract(s, '^{_TEN}$', 1), ''), '1') AS lead, TRY_CAST(regexp_extract(s, '^{_TEN}$', 2) || regexp_extract(s, '^{_TEN}$', 3) AS INT) AS power FROM s),
p AS (SELECT *, coalesce({log10_sql("s")}, {log10_sql("lead")} + CASE WHEN regexp_full_match(s, '{_TEN}') THEN power END) AS prediction, {log10_sql("label")} AS target FROM l)
SELECT sample_index, round(prediction, 6) + 0.0 AS prediction, round(CASE WHEN prediction IS NULL OR target IS NULL THEN 0.0 ELSE greatest(0.0, 1 - abs(prediction - target) / 3.0) END, 6) + 0.0 AS score, CASE WHEN abs(prediction - target) <= 0.5 THEN 1 ELSE 0 END AS hit FROM p""")
def k22_k24_fermi_scores(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).where("source = 'fermi'")
    x = p.select("sample_index", batched(G.answer_log10, "double")("response").alias("prediction"), batched(G.positive_log10, "double")("label").alias("target"))
    delta = F.abs(F.col("prediction") - F.col("target"))
    score = F.when(delta.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - delta / 3.0))
    return x.select("sample_index", r6("prediction").alias("prediction"), r6(score).alias("score"), F.coalesce((delta <= 0.5).cast("int"), F.lit(0)).alias("hit"))


@query("""SELECT problem_id, CASE WHEN lower(trim(string_split(problem_source, '|')[1])) LIKE 'synthfp%' THEN 'SynthFP' WHEN lower(trim(string_split(problem_source, '|')[1])) LIKE 'realfp%' THEN 'RealFP' WHEN lower(trim(string_split(problem_source, '|')[1])) LIKE 'fermi-eval%' THEN 'Fermi-Eval' END AS collection FROM problems""")
def k23_collections(spark: SparkSession, d: str) -> DataFrame:
    first = F.get(F.split("problem_source", r"\|"), F.lit(0))
    return table(spark, d, "problems").select("problem_id", X.collection(first).alias("collection"))


_P = r"([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)"
_TAG = rf"(?i)<(?:probability|forecast|answer)>\s*{_P}\s*</(?:probability|forecast|answer)>"


@query(rf"""WITH t AS (SELECT sample_index, label, regexp_replace(regexp_replace(response, '(?i)(\s*<\|(im_end|endoftext)\|>)+\s*$', ''), '(?s)^\s*<think>.*?</think>', '') AS r FROM {_ANSWERED} WHERE source = 'forecast'),
n AS (SELECT *, CASE WHEN len(regexp_extract_all(r, '{_TAG}')) = 1 AND regexp_matches(r, '{_TAG}\s*$') THEN regexp_extract(r, '{_TAG}', 1) WHEN len(regexp_extract_all(r, '{_TAG}')) = 0 AND regexp_full_match(r, '\s*(\$?\\boxed\{{\s*{_P}\s*\}}\$?|{_P})\s*') THEN regexp_extract(r, '{_P}', 1) END AS x FROM t),
p AS (SELECT *, CASE WHEN TRY_CAST(x AS DOUBLE) BETWEEN 0 AND 1 THEN TRY_CAST(x AS DOUBLE) END AS p, CASE WHEN lower(label) = 'yes' THEN 1.0 WHEN lower(label) = 'no' THEN 0.0 ELSE TRY_CAST(label AS DOUBLE) END AS y FROM n),
b AS (SELECT *, CASE WHEN y IN (0, 1) THEN y END AS b FROM p), q AS (SELECT *, least(greatest(coalesce(p, 1 - b), 1e-6), 1 - 1e-6) AS q FROM b)
SELECT sample_index, p, round(CASE WHEN p IS NULL THEN 1.0 ELSE (p - b) * (p - b) END, 6) + 0.0 AS brier, round(CASE WHEN b = 1 THEN ln(q) ELSE ln(1 - q) END, 6) + 0.0 AS log_likelihood FROM q""")
def k26_k27_probabilities(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).where("source = 'forecast'").withColumn("p", batched(lambda r: G.probability(r), "double")("response"))
    y = F.when(F.lower("label") == "yes", 1.0).when(F.lower("label") == "no", 0.0).otherwise(F.expr("try_cast(label as double)"))
    binary = F.when(y.isin(0.0, 1.0), y)
    worst = F.coalesce("p", 1 - binary)
    return p.select("sample_index", "p", r6(metrics.brier(F.col("p"), binary)).alias("brier"), r6(metrics.bernoulli_log_likelihood(worst, binary)).alias("log_likelihood"))


@query(f"""WITH t AS (SELECT sample_index, CASE WHEN {_BOXED} THEN TRY_CAST(trim({_BOX}) AS DOUBLE) END AS v, TRY_CAST(label AS DOUBLE) AS y FROM {_ANSWERED} WHERE source = 'code_regression'), x AS (SELECT sample_index, CASE WHEN isfinite(v) THEN v END AS x, y FROM t),
e AS (SELECT *, (CASE WHEN x >= 0 THEN ln(1 + x) END - CASE WHEN y > -1 THEN ln(1 + y) END) / ln(10.0) AS e FROM x) SELECT sample_index, x, round(CASE WHEN e IS NULL THEN 0.0 ELSE exp(-0.5 * e * e) END, 6) + 0.0 AS score FROM e""")
def k28_k29_gaussian_scores(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).where("source = 'code_regression'").withColumn("x", batched(G.boxed_number, "double")("response"))
    y = F.expr("try_cast(label as double)")
    error = (F.log1p(F.when(F.col("x") >= 0, F.col("x"))) - F.log1p(y)) / F.log(F.lit(10.0))
    ll = F.when(error.isNull(), F.lit(float("-inf"))).otherwise(-0.5 * error * error)
    return p.select("sample_index", "x", r6(F.exp(ll)).alias("score"))


_ANSWER_BOX = r"Answer:\s*\\boxed\{(?:[^{}]|\{[^{}]*\})*\}"
_CALLED = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"


@query(f"""WITH a AS (SELECT sample_index, response AS r, coalesce(response, '') AS t FROM {_ANSWERED}), c AS (SELECT *, replace(regexp_extract(t, '{_CALLED}', 1), chr(10), '\\n') AS call FROM a), j AS (SELECT *, json_valid(call) AND call <> '' AS ok FROM c)
SELECT sample_index, CASE WHEN regexp_matches(t, '{_ANSWER_BOX}') THEN 'answer' WHEN ok AND coalesce(json_extract_string(CASE WHEN ok THEN call END, '$.name'), '') = 'code_interpreter' AND coalesce(trim(json_extract_string(CASE WHEN ok THEN call END, '$.arguments.code')), '') <> '' THEN 'code' WHEN regexp_matches(t, '(?s)<code>.*?</code>') OR regexp_matches(t, '(?s)```python\\s*.*?\\s*```') THEN 'code' END AS tool_action,
CASE WHEN regexp_matches(t, '(?s)<search>.*?</search>') AND (NOT regexp_matches(t, '(?s)<answer>.*?</answer>') OR length(regexp_extract(t, '(?s)^(.*?)<search>.*?</search>', 1)) < length(regexp_extract(t, '(?s)^(.*?)<answer>.*?</answer>', 1))) THEN 'search' WHEN regexp_matches(t, '(?s)<answer>.*?</answer>') THEN 'answer' END AS search_action,
CASE WHEN r IS NULL THEN NULL WHEN regexp_matches(t, '{_CALLED}') THEN regexp_extract(t, '(?s)^(.*<tool_call>\\s*\\{{.*?\\}}\\s*</tool_call>)', 1) WHEN contains(t, '</code>') THEN regexp_extract(t, '(?s)^(.*?</code>)', 1) WHEN regexp_matches(t, '(?s)```python\\s*.*?```') THEN regexp_extract(t, '(?s)^(.*```python\\s*.*?```)', 1) WHEN regexp_matches(t, '{_ANSWER_BOX}') THEN regexp_extract(t, '(?s)^(.*{_ANSWER_BOX})', 1) ELSE t END AS cut FROM j""")
def k31_k32_actions(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    kind = lambda f: batched(lambda r: f(r)[0], "string")("response")
    return p.select("sample_index", kind(G.tool_action).alias("tool_action"), kind(G.search_action).alias("search_action"), batched(lambda r: G.cut_after_action(r) if r is not None else None, "string")("response").alias("cut"))


@query(r"""SELECT DISTINCT sample_index, trim(regexp_replace(prompt, '[^\p{L}\p{N}_]+', ' ', 'g')) AS query FROM samples WHERE prompt IS NOT NULL""")
def k33_sanitized_queries(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "samples").where("prompt is not null")
    return p.select("sample_index", X.sanitized_query(F.col("prompt")).alias("query")).distinct()


@query("""SELECT name, CASE WHEN name LIKE '%sync%' THEN 'communication' WHEN name LIKE '%generate%' THEN 'generation' WHEN name LIKE '%reward%' THEN 'reward' ELSE 'other' END AS category, count(*) AS n FROM (SELECT DISTINCT event_id, name FROM trace_events) GROUP BY 1, 2""")
def k36_span_categories(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "trace_events").select("event_id", "name").distinct()
    rules = (("sync", "communication"), ("generate", "generation"), ("reward", "reward"))
    return t.groupBy("name", X.first_rule(F.col("name"), rules, "other").alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT problem_id, nullif(regexp_extract(problem_source, '.*?([0-9]+)\\D*$', 1), '') AS inferred FROM problems""")
def k37_question_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The last number in the provenance, where there is one."""
    last = F.try_element_at(F.regexp_extract_all("problem_source", F.lit(r"([0-9]+)"), 1), F.lit(-1))
    return table(spark, d, "problems").select("problem_id", last.alias("inferred"))


@query("""SELECT DISTINCT sample_index, CASE WHEN trim(label) IN ('', 'None', 'N/A') THEN NULL ELSE trim(label) END AS value FROM samples""")
def k38_freeze_values(spark: SparkSession, d: str) -> DataFrame:
    v = F.trim("label")
    return table(spark, d, "samples").select("sample_index", F.when(~v.isin("", "None", "N/A"), v).alias("value")).distinct()


@query("""SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents WHERE text IS NOT NULL""")
def k39_digests(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5(F.col("text").cast("binary")).alias("md5"))


@query()
def k39_checksums(spark: SparkSession, d: str) -> DataFrame:
    import zlib

    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.xxhash64("text").alias("xxhash"), F.sha2("text", 256).alias("sha256"), batched(lambda t: zlib.adler32(t.encode()), "long")("text").alias("adler32"))


@query()
def a14_k30_mazes(spark: SparkSession, d: str) -> DataFrame:
    """One generated maze per maze sample, answered by its own shortest path or, every third, by a wrong one."""
    ids = table(spark, d, "samples").where("source = 'maze'").select("sample_index").distinct()

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for i in b["sample_index"]:
                grid = mazes.generate(11, int(i), "prim" if i % 2 else "dfs")
                path = mazes.shortest_path(grid)
                response = " ".join([*(path[:-1] if i % 3 == 0 else path), "DONE"])
                out.append((i, len(path), *mazes.validate(mazes.render(grid), response)[:3]))
            yield pd.DataFrame(out, columns=["sample_index", "optimal_length", "success", "optimal", "reason"])

    return ids.mapInPandas(run, "sample_index long, optimal_length int, success boolean, optimal boolean, reason string")


@query()
def e4_maze_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """(reason, n, share) of the validated mazes."""
    return metrics.shares(a14_k30_mazes(spark, d), "reason").withColumn("share", r6("share"))
