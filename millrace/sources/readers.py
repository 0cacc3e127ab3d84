"""Scans. Paths that don't exist and unknown kinds of files are errors; column pruning and filters reach the files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import mazes
from millrace.operators.transforms import positioned
from millrace.runtime import exists

_SLICE = re.compile(r"(?P<path>.*)@\[(?P<start>-?\d*):(?P<end>-?\d*)\]$")


def split_path(path: str) -> tuple[str, int | None, int | None]:
    """(path, start, end) of ``file@[start:end]``; negative bounds are an error."""
    m = _SLICE.fullmatch(path)
    if not m:
        return path, None, None
    start, end = (int(m[k]) if m[k] else None for k in ("start", "end"))
    if (start or 0) < 0 or (end or 0) < 0:
        raise ValueError(f"negative bounds in {path}")
    return m["path"], start, end


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """One object per line; blank and malformed lines are dropped."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def read(spark: SparkSession, path: str, order: Iterable[str] = ()) -> DataFrame:
    """JSONL or parquet by extension, perhaps with a row slice.

    A slice needs an order to be defined; without ``order`` rows come in the order of files and of rows in them.
    """
    where, start, end = split_path(path)
    if not exists(spark, where):
        raise FileNotFoundError(where)
    kind = os.path.splitext(where)[1]
    if kind == ".jsonl":
        df = jsonl(spark, where)
    elif kind == ".parquet":
        df = spark.read.parquet(where)
    else:
        raise ValueError(f"unsupported kind of file: {where}")
    if start is None and end is None:
        return df
    order = list(order)
    if not order:
        df = df.withColumn("_file", F.col("_metadata.file_path"))
        if kind == ".parquet":
            df = df.withColumn("_block", F.lit(0)).withColumn("_row", F.col("_metadata.row_index"))
        else:  # within a block of a file rows are read in their order
            df = df.withColumn("_block", F.col("_metadata.file_block_start")).withColumn("_row", F.monotonically_increasing_id())
        order = ["_file", "_block", "_row"]
    placed = positioned(df, order, "_pos")
    keep = F.col("_pos") >= (start or 0)
    if end is not None:
        keep &= F.col("_pos") < end
    return placed.where(keep).drop("_pos", "_file", "_block", "_row")


def json_array(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A file with one array of objects; an element that is no object is an error."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def javascript_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a file of the form ``name = [...]``."""
    text = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", r"(?s)=\s*(\[.*\])\s*;?\s*$", 1)
    return text.select(F.explode(F.from_json(body, f"array<struct<{schema}>>", {"mode": "FAILFAST"})).alias("o")).select("o.*")


def dated_pairs(spark: SparkSession, questions: str, resolutions: str, question_schema: str, resolution_schema: str) -> tuple[DataFrame, DataFrame]:
    """Question files ``YYYY-MM-DD-llm.json`` and resolution files ``YYYY-MM-DD_resolution_set.json``, each with its round.

    Both sides must have the same rounds.
    """
    day = lambda suffix: F.regexp_extract(F.col("_metadata.file_name"), rf"^(\d{{4}}-\d{{2}}-\d{{2}}){suffix}$", 1)
    read_all = lambda p, s: spark.read.option("multiLine", True).schema(s).json(p)
    q = read_all(questions, question_schema).withColumn("round", day(r"-llm\.json"))
    r = read_all(resolutions, resolution_schema).withColumn("round", day(r"_resolution_set\.json"))
    both = q.select("round").distinct().join(r.select("round").distinct().withColumn("_r", F.lit(1)), "round", "full_outer")
    lonely = [x["round"] for x in both.join(q.select("round").distinct().withColumn("_q", F.lit(1)), "round", "left").where("_r is null or _q is null").limit(20).collect()]
    if lonely:
        raise ValueError(f"rounds without a partner: {sorted(lonely)}")
    return q, r


def without_eval(spark: SparkSession, path: str, columns: list[str], eval_ids: DataFrame, key: str) -> DataFrame:
    """Pruned columns of a parquet table without the ids of the eval set."""
    return spark.read.parquet(path).select(*columns).join(checked_ids(eval_ids, key), key, "left_anti")


def checked_ids(ids: DataFrame, key: str) -> DataFrame:
    """The ids of an eval set; empty sets, null ids and duplicates are errors."""
    bad = ids.agg(F.count("*").alias("n"), F.count(key).alias("k"), F.count_distinct(key).alias("d")).first()
    if bad["n"] == 0 or bad["k"] < bad["n"] or bad["d"] < bad["k"]:
        raise ValueError(f"{key}: {bad['n']} rows, {bad['k']} non-null, {bad['d']} distinct")
    return ids.select(key)


def dump(spark: SparkSession, template: str, rollout_id: int, fallback: bool = True) -> DataFrame:
    """A dump by a path template with ``{rollout_id}``; falls back to rollout 0 where the own one is missing."""
    path = template.format(rollout_id=rollout_id)
    if fallback and not exists(spark, path):
        path = template.format(rollout_id=0)
    return spark.read.parquet(path)


def head_and_tail(df: DataFrame, n: int, order: str) -> DataFrame:
    """n rows: half from the front (rounded down), the rest from the back."""
    placed = positioned(df, [order], "_pos")
    total = df.agg(F.count("*").alias("_n"))
    return placed.join(F.broadcast(total)).where((F.col("_pos") < n // 2) | (F.col("_pos") >= F.col("_n") - (n - n // 2))).drop("_pos", "_n")


def chrome_trace(spark: SparkSession, path: str) -> DataFrame:
    """Complete events of a trace file, plain or gzipped."""
    schema = "traceEvents array<struct<ph string, ts double, dur double, cat string, name string, tid string, pid string>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    return raw.select(F.explode("traceEvents").alias("e")).select("e.*").where("ph = 'X'")


def fetched(corpus: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of the wanted ids."""
    return wanted.join(corpus, key)


def empty(spark: SparkSession, n: int) -> DataFrame:
    """n default samples where there is no data set."""
    return spark.range(n).select(F.col("id").alias("index"), F.lit(None).cast("string").alias("prompt"), F.lit("pending").alias("status"))


def maze_rows(spark: SparkSession, n: int, size: int, seed: int, method: str = "dfs") -> DataFrame:
    """n generated mazes with their shortest path; each row has a seed of its own, so any partitioning gives the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b["id"]:
                grid = mazes.generate(size, seed * 1_000_003 + int(i), method)
                path = mazes.shortest_path(grid)
                out.append((i, mazes.render(grid), " ".join([*path, "DONE"]), len(path)))
            yield pd.DataFrame(out, columns=["identifier", "prompt", "response", "optimal_length"])

    return spark.range(n).mapInPandas(run, "identifier long, prompt string, response string, optimal_length int")
