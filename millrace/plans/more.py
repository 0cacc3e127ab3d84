"""Remaining operators of the inventory: conversations, curation, coverage, orders, lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import tokens as K
from millrace.operators import advantages, filters, metrics, packing, splits, transforms
from millrace.operators.grouped import map_groups
from millrace.plans.base import S, TOK, r6, samples, sequences
from millrace.plans.relational import E, events
from millrace.runtime import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""SELECT DISTINCT sample_index, prompt AS first_content, 'user' AS first_role FROM samples WHERE prompt IS NOT NULL""")
def c8_c9_checked_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages with known roles; the first one's content by nested access."""
    s = table(spark, d, "samples").where("prompt is not null").select("sample_index", transforms.role_checked(transforms.as_messages(F.col("prompt"))).alias("m")).distinct()
    return s.select("sample_index", F.col("m")[0]["content"].alias("first_content"), F.col("m")[0]["role"].alias("first_role"))


@query("""SELECT problem_id, split || '|' || coalesce(question_number, 'none') || '|' || problem_id AS identifier FROM problems""")
def c21_identifiers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems")
    return p.select("problem_id", F.concat_ws("|", "split", F.coalesce("question_number", F.lit("none")), F.col("problem_id").cast("string")).alias("identifier"))


@query("""SELECT problem_id, 'due ' || CAST(CAST(ingested_at AS DATE) AS VARCHAR) || ', resolves ' || CAST(CAST(ingested_at AS DATE) + 30 AS VARCHAR) AS text FROM problems WHERE ingested_at IS NOT NULL""")
def c20_expanded_dates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems").where("ingested_at is not null")
    day = F.to_date("ingested_at")
    return p.select("problem_id", transforms.expand_dates(F.lit("due {forecast_due_date}, resolves {resolution_date}"), day, F.date_add(day, 30)).alias("text"))


@query("""SELECT sample_index, CASE WHEN sample_index % 4 = 0 THEN 'override' ELSE json_extract_string(metadata, '$.source_name') END AS source_name, 'math' AS rm_type FROM (SELECT DISTINCT sample_index, metadata FROM samples)""")
def c22_metadata_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Per-dataset values laid over a sample's metadata: the override wins where it is set."""
    s = table(spark, d, "samples").select("sample_index", "metadata").distinct()
    override = F.when(F.col("sample_index") % 4 == 0, "override")
    return s.select("sample_index", F.coalesce(override, F.get_json_object("metadata", "$.source_name")).alias("source_name"), F.lit("math").alias("rm_type"))


@query("""SELECT DISTINCT session_id, turn, array_to_string(list_filter(['prompt', CASE WHEN len(output_ids) > 0 THEN 'output' END, CASE WHEN ill_formed THEN '[image omitted]' END], lambda x: x IS NOT NULL), chr(10)) AS flat FROM turns""")
def c30_flattened_parts(spark: SparkSession, d: str) -> DataFrame:
    """Typed parts as text: newline between parts, empty ones dropped, images named."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.array(part("text", F.lit("prompt")), part("text", F.when(F.size("output_ids") > 0, "output").otherwise("")), F.when(F.col("ill_formed"), part("image", F.lit(None).cast("string"))).otherwise(part("text", F.lit(""))))
    t = table(spark, d, "turns")
    return t.select("session_id", "turn", transforms.flatten_parts(parts, "\n", True, "[image omitted]").alias("flat")).distinct()


@query(f"""WITH {S} SELECT group_index, count(*) AS n, count(reward) AS graded FROM s WHERE group_index IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 AND count(reward) = count(*)""")
def d2_group_predicates(spark: SparkSession, d: str) -> DataFrame:
    """A group filter given as an aggregate predicate: at least two rows, all graded."""
    s = samples(spark, d).where("group_index is not null")
    kept = filters.group_filter(s, "group_index", (F.count("*") >= 2) & (F.count("reward") == F.count("*")))
    return kept.groupBy("group_index").agg(F.count("*").alias("n"), F.count("reward").alias("graded"))


@query(f"""WITH {S} SELECT sample_index, status IN ('aborted', 'failed') AS remove_sample FROM s WHERE status IS NOT NULL""")
def d6_marked_samples(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).where("status is not null").select("sample_index", F.col("status").isin("aborted", "failed").alias("remove_sample"))


@query("""SELECT problem_id, CAST(answer_value AS DOUBLE) AS value FROM problems WHERE ingested_at > TIMESTAMP '2025-03-01' AND retained_for_merge AND answer_value IN ('1e1', '1e2', '1e3')""")
def d12_resolved_binary(spark: SparkSession, d: str) -> DataFrame:
    """Time, flag and value filters before anything else, pushed to the scan."""
    p = table(spark, d, "problems").where("ingested_at > timestamp_ntz '2025-03-01' and retained_for_merge and answer_value in ('1e1', '1e2', '1e3')")
    return p.select("problem_id", F.col("answer_value").cast("double").alias("value"))


@query("""SELECT doc_id, 'https://host.example/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' ELSE '' END AS link FROM documents WHERE doc_id % 3 <> 0""")
def d18_page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links to pages only; the links are made from the ids, as the texts hold none."""
    ending = F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".html").otherwise("")
    link = F.concat(F.lit("https://host.example/"), F.col("doc_id").cast("string"), ending)
    return table(spark, d, "documents").select("doc_id", link.alias("link")).where(filters.web_links(F.col("link")))


@query(f"""WITH {S}, g AS (SELECT group_index, min(sample_index) AS pos, stddev_samp(reward) AS sd FROM s WHERE reward IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS p FROM g), k AS (SELECT group_index, CAST(floor(p / 16) AS BIGINT) AS chunk, pos FROM r WHERE sd > 1e-6 ORDER BY pos LIMIT 64) SELECT group_index, chunk, 42 + 3 * 1000003 + chunk * 10007 AS seed FROM k""")
def d20_batched_rounds(spark: SparkSession, d: str) -> DataFrame:
    """A stated feature: the first 64 accepted groups of rollout 3, with the round of 16 they came in and its seed."""
    g = samples(spark, d).where("reward is not null").groupBy("group_index").agg(F.min("sample_index").alias("pos"), F.stddev_samp("reward").alias("sd"))
    kept = filters.first_n(transforms.positioned(g, ["pos"], "p").where("sd > 1e-6"), 64, ["pos"])
    chunk = F.floor(F.col("p") / 16)
    return kept.select("group_index", chunk.alias("chunk"), (F.lit(42 + 3 * 1_000_003) + chunk * 10_007).alias("seed"))


@query(f"""WITH {TOK}, q AS (SELECT session_id, turn, sum(-new * mask) / greatest(sum(mask), 1) AS e, max(reward) AS r FROM tok GROUP BY 1, 2) SELECT round(sum(e), 6) + 0.0 AS correct_entropy, count(*) AS correct FROM q WHERE r < 0.3""")
def e15_correct_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Sum of per-sequence mean surprise over the chosen (here: low-reward) sequences."""
    c = sequences(spark, d).where("reward < 0.3")
    return c.select(K.masked_mean(K.nll(F.col("new")), F.col("mask")).alias("e")).agg(r6(F.sum("e")).alias("correct_entropy"), F.count("*").alias("correct"))


@query(f"""WITH {S} SELECT source, round(sqrt(avg((reward - response_length / 1000.0) * (reward - response_length / 1000.0))), 6) + 0.0 AS rmse, round(avg(abs(reward - response_length / 1000.0)), 6) + 0.0 AS mae, count(*) AS n FROM s WHERE reward IS NOT NULL AND response_length IS NOT NULL GROUP BY source""")
def e30_g11_scalar_regression(spark: SparkSession, d: str) -> DataFrame:
    """Errors of direct scalar predictions by source."""
    s = samples(spark, d).where("reward is not null and response_length is not null")
    error = F.col("reward") - F.col("response_length") / 1000.0
    return s.groupBy("source").agg(r6(F.sqrt(F.avg(error * error))).alias("rmse"), r6(F.avg(F.abs(error))).alias("mae"), F.count("*").alias("n"))


@query("""SELECT session_id, count(*) FILTER (finish_reason = 'stop') AS success, count(*) FILTER (finish_reason IS NOT NULL AND finish_reason <> 'stop') AS failure, round(count(*) FILTER (finish_reason = 'stop') * 1.0 / greatest(count(finish_reason), 1), 6) + 0.0 AS pass_ratio FROM (SELECT DISTINCT session_id, turn, finish_reason FROM turns WHERE session_id IS NOT NULL) GROUP BY 1""")
def e36_pass_ratio(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turns").where("session_id is not null").select("session_id", "turn", "finish_reason").distinct()
    ok, bad = F.sum((F.col("finish_reason") == "stop").cast("long")), F.sum((F.col("finish_reason") != "stop").cast("long"))
    g = t.groupBy("session_id").agg(F.coalesce(ok, F.lit(0)).alias("success"), F.coalesce(bad, F.lit(0)).alias("failure"))
    return g.withColumn("pass_ratio", r6(F.col("success") / F.greatest(F.col("success") + F.col("failure"), F.lit(1))))


@query(f"""WITH {S}, t AS (SELECT sample_indices AS i, max(rewards) AS r FROM train_data WHERE sample_indices IS NOT NULL GROUP BY 1) SELECT coalesce(s.sample_index, t.i) AS sample_index, CASE WHEN t.i IS NULL THEN 'missing' WHEN s.sample_index IS NULL THEN 'unexpected' ELSE 'both' END AS state FROM s FULL JOIN t ON s.sample_index = t.i""")
def h5_prediction_merge(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train_data").where("sample_indices is not null").groupBy(F.col("sample_indices").alias("i")).agg(F.max("rewards").alias("r"))
    s = samples(spark, d).select("sample_index")
    j = s.join(t, F.col("sample_index") == F.col("i"), "full_outer")
    state = F.when(F.col("i").isNull(), "missing").when(F.col("sample_index").isNull(), "unexpected").otherwise("both")
    return j.select(F.coalesce("sample_index", "i").alias("sample_index"), state.alias("state"))


@query("""SELECT problem_id, CAST(floor((row_number() OVER (ORDER BY problem_id) - 1) / 64) AS BIGINT) AS batch FROM problems""")
def i4_final_partial_batch(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 64 without wrapping; the last may be smaller."""
    p = transforms.positioned(table(spark, d, "problems").select("problem_id"), ["problem_id"], "p")
    return p.select("problem_id", F.floor(F.col("p") / 64).alias("batch"))


@query("""SELECT problem_id, CASE WHEN row_number() OVER (ORDER BY md5('7|' || problem_id), problem_id) - 1 < (SELECT count(*) FROM problems) // 10 THEN 'test' ELSE 'train' END AS part FROM problems""")
def i11_shuffled_holdout(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the problems, the first of a seeded shuffle, is held out."""
    p = splits.epoch_order(table(spark, d, "problems").select("problem_id"), "problem_id", 7, 0)
    n = p.agg(F.count("*").alias("n"))
    return p.join(F.broadcast(n)).select("problem_id", F.when(F.col("position") < F.floor(F.col("n") / 10), "test").otherwise("train").alias("part"))


def run_chunks(documents: DataFrame, most: int, width: int) -> DataFrame:
    """(run_id, doc_id, chunk): the walk over each run in order of id, a new chunk where the size would exceed ``most``.

    A hot run is cut into ranges of ``width`` ids, so that no task gets a third of all rows. Each range tells
    what it does to the chunk open before it, a row a run and range; a walk over these rows gives every range
    the number and size to go on from.
    """
    keys = ["run_id", "part"]
    doc = documents.where("run_id is not null and n_chars is not null").select("run_id", "doc_id", "n_chars")
    ranged = doc.withColumn("part", F.coalesce(F.floor(F.col("doc_id") / width), F.lit(2**62)))  # without an id: last

    def told(key: tuple, part: list[dict]) -> list[tuple]:
        sizes = [r["n_chars"] for r in part]
        return [(*key, sum(sizes), *packing.chunk_carry(sizes, most))]

    def walk(key: tuple, parts: list[dict]) -> list[tuple]:
        out, chunk, total = [], 0, 0
        for r in parts:
            out.append((*key, r["part"], chunk, total))
            chunk, total = packing.carried((r["edges"], r["chunks"], r["opens"], r["fresh"], r["left"]), r["size"], most, chunk, total)
        return out

    def number(key: tuple, part: list[dict]) -> list[tuple]:
        chunks = packing.size_chunks([r["n_chars"] for r in part], most, part[0]["chunk"], part[0]["total"])
        return [(key[0], r["doc_id"], c) for r, c in zip(part, chunks)]

    order = [F.col("doc_id").asc_nulls_last(), F.col("n_chars")]
    carry = map_groups(ranged, keys, order, told, "run_id string, part long, size long, edges array<long>, chunks array<long>, opens array<long>, fresh long, left long")
    opened = map_groups(carry, ["run_id"], ["part"], walk, "run_id string, part long, chunk long, total long")
    return map_groups(ranged.join(opened, keys), keys, order, number, "run_id string, doc_id long, chunk int")


@query("""WITH RECURSIVE s AS (SELECT run_id, doc_id, n_chars, row_number() OVER (PARTITION BY run_id ORDER BY doc_id, n_chars) AS pos FROM documents WHERE run_id IS NOT NULL AND n_chars IS NOT NULL), r AS (SELECT run_id, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS doc_id, 0 AS chunk, CAST(0 AS BIGINT) AS total FROM s WHERE pos = 1 UNION ALL
SELECT r.run_id, s.pos, s.doc_id, CASE WHEN total > 0 AND total + n_chars > 20000 THEN chunk + 1 ELSE chunk END, CASE WHEN total > 0 AND total + n_chars > 20000 THEN n_chars ELSE total + n_chars END FROM r JOIN s ON s.run_id = r.run_id AND s.pos = r.pos + 1) SELECT run_id, doc_id, CAST(chunk AS INT) AS chunk FROM r WHERE pos > 0""")
def j9_size_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each run in chunks of at most 20,000 characters, in order of id; a longer document is a chunk of its own."""
    return run_chunks(table(spark, d, "documents"), 20_000, 100_000)


@query("""SELECT i AS rollout, (i + 1) % 20 = 0 OR (i + 1) % 64 = 0 OR i = (SELECT max(rollout_id) FROM samples) AS fires FROM (SELECT DISTINCT rollout_id AS i FROM samples WHERE rollout_id IS NOT NULL)""")
def j10_periodic_action(spark: SparkSession, d: str) -> DataFrame:
    """Rollouts at which a periodic action fires: every 20th, at the end of an epoch of 64, and the last."""
    r = table(spark, d, "samples").where("rollout_id is not null").select(F.col("rollout_id").alias("rollout")).distinct()
    last = r.agg(F.max("rollout")).first()[0]
    i = F.col("rollout")
    return r.select("rollout", (((i + 1) % 20 == 0) | ((i + 1) % 64 == 0) | (i == F.lit(last))).alias("fires"))


@query("""SELECT sample_indices AS sample_index, CAST(2 * 4 * ceil(len(tokens) / 8.0) AS BIGINT) AS padded, CAST(ceil(len(tokens) / 8.0) AS BIGINT) AS chunk FROM (SELECT sample_indices, max(tokens) AS tokens FROM train_data WHERE sample_indices IS NOT NULL AND tokens IS NOT NULL GROUP BY 1)""")
def j11_zigzag_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunk length when a sequence is cut into twice as many chunks as 4 ranks; rank r holds chunks r and 7 - r."""
    t = table(spark, d, "train_data").where("sample_indices is not null and tokens is not null").groupBy(F.col("sample_indices").alias("sample_index")).agg(F.max(F.size("tokens")).alias("n"))
    chunk = F.ceil(F.col("n") / 8.0)
    return t.select("sample_index", (chunk * 8).alias("padded"), chunk.alias("chunk"))


@query(f"""WITH {E}, c AS (SELECT event_id, engine_id, unnest([queue_time, e2e_latency - queue_time]) AS dur, unnest(['queue', 'serve']) AS lane, unnest([1, 2]) AS k FROM e WHERE queue_time >= 0 AND e2e_latency >= queue_time AND isfinite(queue_time) AND isfinite(e2e_latency)) SELECT event_id, lane, round(sum(dur) OVER (PARTITION BY event_id ORDER BY k) - dur, 6) + 0.0 AS offset_start, round(sum(dur) OVER (PARTITION BY event_id ORDER BY k), 6) + 0.0 AS offset_end FROM c""")
def l9_virtual_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Child spans of a request: queueing, then serving, by running offsets."""
    e = events(spark, d, "queue_time", "e2e_latency").where("queue_time >= 0 and e2e_latency >= queue_time and not isnan(queue_time) and not isnan(e2e_latency) and e2e_latency < double('infinity')")
    lanes = F.array(F.struct(F.lit("queue").alias("lane"), F.lit(0.0).alias("a"), F.col("queue_time").alias("b")), F.struct(F.lit("serve").alias("lane"), F.col("queue_time").alias("a"), F.col("e2e_latency").alias("b")))
    return e.select("event_id", F.explode(lanes).alias("x")).select("event_id", "x.lane", r6("x.a").alias("offset_start"), r6("x.b").alias("offset_end"))


@query(f"""WITH {E}, c AS (SELECT engine_id, count(*) AS load FROM e GROUP BY 1) SELECT engine_id, load FROM (SELECT *, row_number() OVER (ORDER BY load, engine_id NULLS FIRST) AS rn FROM c) WHERE rn = 1""")
def l16_least_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The engine with the least load, the first by name among ties."""
    c = events(spark, d, "engine_id").groupBy("engine_id").agg(F.count("*").alias("load"))
    return c.agg(F.min(F.struct("load", "engine_id")).alias("m")).select("m.engine_id", "m.load")


@query(f"""WITH {S}, g AS (SELECT *, avg(reward) OVER w AS m, coalesce(stddev_samp(reward) OVER w, 0) AS sd FROM s WHERE reward IS NOT NULL WINDOW w AS (PARTITION BY group_index)) SELECT source, round(avg(abs((reward - m) / (sd + 1e-6))), 6) + 0.0 AS mean_abs_advantage FROM g GROUP BY source""")
def f2_f11_dispatched_advantages(spark: SparkSession, d: str) -> DataFrame:
    out = advantages.advantages(samples(spark, d).where("reward is not null"), "grpo")
    return out.groupBy("source").agg(r6(F.avg(F.abs("advantage"))).alias("mean_abs_advantage"))


@query("""WITH w AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT label, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM embeddings), 6) + 0.0 AS share FROM w GROUP BY label""")
def e12_label_shares(spark: SparkSession, d: str) -> DataFrame:
    return metrics.shares(table(spark, d, "embeddings"), "label").withColumn("share", r6("share"))
