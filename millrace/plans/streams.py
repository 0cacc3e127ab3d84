"""Streaming jobs run over a whole table and read back; their SQL is the batch result they must end with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import filters
from millrace.runtime import shared_dir, table
from millrace.streaming import jobs

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""WITH g AS (SELECT group_index, count(*) AS n FROM samples WHERE group_index IS NOT NULL GROUP BY 1 HAVING count(*) >= 4) SELECT group_index, n AS rows FROM g""")
def l1_buffered_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups emitted by the buffer once they have four rows (the table comes as one micro-batch)."""
    s = jobs.table_stream(spark, f"{d}/samples.parquet").where("group_index is not null").select("group_index", "sample_index", "reward")
    out = jobs.drained(jobs.accumulated_groups(s, "group_index", ["sample_index", "reward"], 4), label="groups")
    return out.groupBy("group_index").agg(F.count("*").alias("rows"))


@query("""WITH s AS (SELECT DISTINCT group_index, sample_index, reward FROM samples WHERE group_index IS NOT NULL AND sample_index IS NOT NULL), c AS (SELECT group_index, count(*) FILTER (sample_index % 3 = 0) AS c0, count(*) FILTER (sample_index % 3 = 1) AS c1, count(*) FILTER (sample_index % 3 = 2) AS c2 FROM s GROUP BY 1),
a AS (SELECT *, CASE WHEN c0 >= 3 THEN c0 ELSE 0 END AS e0, CASE WHEN c0 >= 3 THEN 0 ELSE c0 END AS r0 FROM c), b AS (SELECT *, CASE WHEN r0 + c1 >= 3 THEN r0 + c1 ELSE 0 END AS e1, CASE WHEN r0 + c1 >= 3 THEN 0 ELSE r0 + c1 END AS r1 FROM a), d AS (SELECT *, CASE WHEN r1 + c2 >= 3 THEN r1 + c2 ELSE 0 END AS e2 FROM b)
SELECT group_index, CAST(0 AS BIGINT) AS batch_id, e0 AS rows FROM d WHERE e0 > 0 UNION ALL SELECT group_index, 1, e1 FROM d WHERE e1 > 0 UNION ALL SELECT group_index, 2, e2 FROM d WHERE e2 > 0""")
def l1_buffer_over_batches(spark: SparkSession, d: str) -> DataFrame:
    """The samples come as three micro-batches; a group is emitted whole and forgotten once it has three rows, later rows start it anew."""
    base = f"{shared_dir(spark).rstrip('/')}/batches-{uuid.uuid4().hex}"
    rows = table(spark, d, "samples").where("group_index is not null and sample_index is not null").select("group_index", "sample_index", "reward").distinct()
    for k in range(3):  # one after the other, so that the files' times give the order
        rows.where(F.col("sample_index") % 3 == k).coalesce(1).write.parquet(f"{base}/{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/*")
    out = jobs.drained(jobs.accumulated_groups(stream, "group_index", ["sample_index", "reward"], 3), label="groups")
    return out.groupBy("group_index", "batch_id").agg(F.count("*").alias("rows"))


@query("""SELECT session_id, max(turn) AS turn, arg_max(finish_reason, turn) AS finish_reason FROM turns WHERE session_id IS NOT NULL AND finish_reason IS NOT NULL GROUP BY 1""")
def l3_last_chunks(spark: SparkSession, d: str) -> DataFrame:
    s = jobs.table_stream(spark, f"{d}/turns.parquet").where("session_id is not null and finish_reason is not null")
    s = s.select("session_id", "turn", "finish_reason", F.coalesce(F.col("created_at").cast("timestamp"), F.timestamp_seconds(F.lit(0))).alias("at"))
    out = jobs.drained(jobs.last_chunk(s, "session_id", "turn", "finish_reason", "at"), "update", "chunks")
    return jobs.highest(out, "session_id", "turn").select("session_id", "turn", "finish_reason")


@query("""SELECT 'retry' AS sink, count(*) AS n FROM samples WHERE status IN ('aborted', 'failed') UNION ALL SELECT 'done', count(*) FROM samples WHERE status IS NULL OR status NOT IN ('aborted', 'failed')""")
def l2_retry_sink(spark: SparkSession, d: str) -> DataFrame:
    base = f"{shared_dir(spark).rstrip('/')}/retry-{uuid.uuid4().hex}"
    jobs.with_retries(jobs.table_stream(spark, f"{d}/samples.parquet").select("sample_index", "status"), "status in ('aborted', 'failed')", base)()
    sinks = [spark.read.schema("sample_index long, status string").parquet(f"{base}/{k}/*").agg(F.lit(k).alias("sink"), F.count("*").alias("n")) for k in ("retry", "done")]
    return sinks[0].unionByName(sinks[1])


@query("""SELECT event_type, strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 2) + 0.0 AS v FROM events WHERE time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour' GROUP BY 1, 2""")
def l14_streaming_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows that the watermark has closed."""
    s = jobs.table_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.drained(jobs.windowed(s, "ts", "event_type", "value", "1 day"), label="windows")
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", (F.round("v", 2) + F.lit(0.0)).alias("v"))


@query("""SELECT s.sample_index FROM (SELECT DISTINCT sample_index, session_id FROM samples WHERE session_id IS NOT NULL) s WHERE s.session_id NOT IN (SELECT session_id FROM turns WHERE finish_reason = 'stop' AND session_id IS NOT NULL)""")
def l15_unfinished_instances(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").where("session_id is not null").select("sample_index", "session_id").distinct()
    done = table(spark, d, "turns").where("finish_reason = 'stop'").select("session_id")
    return jobs.consumed(s, done, "session_id").select("sample_index")


@query("""SELECT sample_index, prompt FROM (SELECT *, row_number() OVER (ORDER BY created_at, sample_index) AS rn FROM (SELECT sample_index, max(prompt) AS prompt, min(created_at) AS created_at FROM samples GROUP BY 1)) WHERE rn <= 100""")
def d7_popped_buffer(spark: SparkSession, d: str) -> DataFrame:
    """A stated feature: the first 100 of the buffer."""
    s = table(spark, d, "samples").groupBy("sample_index").agg(F.max("prompt").alias("prompt"), F.min("created_at").alias("created_at"))
    return filters.popped(s, 100, ["created_at", "sample_index"], "sample_index")[0].select("sample_index", "prompt")
