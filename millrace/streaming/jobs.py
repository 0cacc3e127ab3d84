"""Structured Streaming jobs: group accumulation, last chunk, retries, windows, resumable copies.

Every job keeps its position in a checkpoint location, so a restart goes on where it stopped; sinks are
written per micro-batch under the batch's number, so that a repeated batch replaces its own output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from millrace.runtime import exists, shared_dir


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table as a stream with the table's own schema; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # written as a pattern, as a stream takes one file only by a pattern
    pattern = f"{path[:-1]}[{path[-1]}]"
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(pattern)


def drained(stream: DataFrame, mode: str = "append", label: str = "stream") -> DataFrame:
    """Run a stream over all that is available and read what it wrote: the batch form of a job.

    In update mode a key may be written several times; ``batch_id`` tells which is the latest.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    run.awaitTermination()
    numbered = StructType(schema.fields).add("batch_id", "long")
    if not exists(spark, f"{base}/out"):  # no micro-batch was run
        return spark.createDataFrame([], numbered)
    return spark.read.schema(numbered).option("basePath", f"{base}/out").parquet(f"{base}/out")


def _plain(v):
    """A value of a pandas column as state keeps it."""
    return None if pd.isna(v) else v.item() if hasattr(v, "item") else v


def accumulated_groups(stream: DataFrame, key: str, columns: list[str], at_least: int, valid: Callable[[pd.DataFrame], bool] = lambda g: True, wait_ms: int | None = None) -> DataFrame:
    """(key, columns): rows by instance until a group has ``at_least`` valid ones; the group is then emitted whole and forgotten.

    State holds the rows of unfinished groups only; rows after an emission start a new group. With ``wait_ms`` an
    incomplete group is dropped after so long without rows.
    """
    fields = {f.name: f.dataType for f in stream.schema}
    out_schema = ", ".join(f"`{c}` {fields[c].simpleString()}" for c in [key, *columns])
    state_schema = ", ".join(f"`{c}` array<{fields[c].simpleString()}>" for c in columns)

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        lists = [list(x) for x in state.get] if state.exists else [[] for _ in columns]
        for b in batches:
            for c, xs in zip(columns, lists):
                xs += map(_plain, b[c])
        group = pd.DataFrame(dict(zip(columns, lists)))
        if len(group) >= at_least and valid(group):
            if state.exists:
                state.remove()
            yield group.assign(**{key: name[0]})[[key, *columns]]
            return
        state.update(tuple(lists))
        if wait_ms is not None:
            state.setTimeoutDuration(wait_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait_ms is not None else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(step, out_schema, state_schema, "append", timeout)


def last_chunk(stream: DataFrame, key: str, sequence: str, value: str, at: str, late: str = "1 hour", span: str = "1 day") -> DataFrame:
    """(key, sequence, value): the chunk with the highest number of each request, updated as chunks come (chunks hold all text so far).

    ``at`` is the time of a chunk. A request is held per ``span`` of time and let go once the watermark has passed
    the span, so state holds what came lately; a request over several spans gives an update for each, of which
    the highest number holds (``highest``). Chunks later than the watermark, or without number or time, are dropped.
    """
    rows = stream.where(F.col(sequence).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    latest = rows.groupBy(key, F.window(at, span).alias("_span")).agg(F.max_by(value, F.struct(sequence, value)).alias("_v"), F.max(sequence).alias("_s"))
    return latest.select(key, F.col("_s").alias(sequence), F.col("_v").alias(value))


def highest(updates: DataFrame, key: str, sequence: str) -> DataFrame:
    """The update with the highest number of each key."""
    return updates.groupBy(key).agg(F.max_by(F.struct(*updates.columns), sequence).alias("r")).select("r.*")


def windowed(stream: DataFrame, at: str, key: str, value: str, window: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per key and event-time window, final once the watermark has passed; later rows are dropped."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    return stream.withWatermark(at, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("v")).select(key, F.col("w.start").alias("start"), "n", "v")


def with_retries(stream: DataFrame, failed: str, base: str) -> Callable[[], None]:
    """A job that writes good rows to ``base``/done and rows where ``failed`` holds to ``base``/retry."""

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("_failed", F.coalesce(F.expr(failed), F.lit(False))).persist()
        try:
            marked.where("not _failed").drop("_failed").write.mode("overwrite").parquet(f"{base}/done/batch_id={batch_id}")
            marked.where("_failed").drop("_failed").write.mode("overwrite").parquet(f"{base}/retry/batch_id={batch_id}")
        finally:
            marked.unpersist()

    def run() -> None:
        stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()

    return run


def consumed(batch: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Rows of a micro-batch whose instance has not been finished before."""
    return batch.join(finished.select(key).distinct(), key, "left_anti")
