"""Sinks: fixed-schema parquet with lineage, artifacts checked on reload, JSONL, dumps, metrics."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.runtime import bounded_rows


def fixed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns and types of a fixed schema; a null in a required column fails the write."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    out = []
    for f in schema:
        c = F.col(f.name).cast(f.dataType)
        if not f.nullable:
            c = F.when(F.col(f.name).isNotNull(), c).otherwise(F.raise_error(F.lit(f"{f.name} is null")).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    # a name that begins with an underscore is hidden from scans
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def parquet(df: DataFrame, path: str, schema: T.StructType | None = None, lineage: dict | None = None, mode: str = "errorifexists") -> None:
    """Zstandard parquet; the committer makes the files appear at once; lineage goes beside them."""
    (fixed(df, schema) if schema else df).write.mode(mode).option("compression", "zstd").parquet(path)
    if lineage is not None:
        _write_text(df.sparkSession, f"{path.rstrip('/')}/_meta.json", json.dumps(lineage, sort_keys=True))


def lineage_of(spark: SparkSession, path: str) -> dict:
    return json.loads(_read_text(spark, f"{path.rstrip('/')}/_meta.json"))


def reloaded(spark: SparkSession, path: str, lineage: dict, identity: DataFrame | None = None) -> DataFrame:
    """A stage's artifact if its lineage is the one expected and its identity columns hold the same rows."""
    if lineage_of(spark, path) != lineage:
        raise ValueError(f"{path} was made from something else")
    df = spark.read.parquet(path)
    if identity is not None:
        own = df.select(*identity.columns)
        if not own.exceptAll(identity).isEmpty() or not identity.exceptAll(own).isEmpty():
            raise ValueError(f"{path} holds other rows")
    return df


def jsonl(df: DataFrame, path: str, finite: bool = True) -> None:
    """One object per line; an existing path is an error; NaN and infinities become null."""
    if finite:
        clean = lambda n: F.when(~F.isnan(n) & (F.abs(F.col(n)) < float("inf")), F.col(n))
        df = df.select(*[clean(n).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def predictions(df: DataFrame, path: str) -> None:
    """One JSON object per line in one file that appears at once; NaN and infinities are errors.

    The rows of one evaluation come through one task; a larger table belongs into ``jsonl``.
    """
    spark = df.sparkSession
    numbers = [n for n, t in df.dtypes if t in ("double", "float")]
    if numbers:
        bad = df.agg(*[F.max(F.isnan(n) | (F.abs(F.col(n)) == float("inf"))).alias(n) for n in numbers]).first()
        if any(bad):
            raise ValueError(f"not finite: {[n for n in numbers if bad[n]]}")
    staging = f"{path}.tmp-{uuid.uuid4().hex}"
    df.coalesce(1).write.option("ignoreNullFields", False).json(staging)
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        part = next((f.getPath() for f in fs.listStatus(p(staging)) if f.getPath().getName().startswith("part-")), None)
        if part is None:  # no rows
            _write_text(spark, path, "")
            return
        fs.delete(p(path), False)
        if not fs.rename(part, p(path)):
            raise OSError(f"could not move to {path}")
    finally:
        fs.delete(p(staging), True)


def text_report(df: DataFrame, path: str, title: str, most: int = 10_000) -> str:
    """A titled table as text, written and returned; more than ``most`` rows are an error. Numbers are right-aligned, nulls are dashes."""
    rows = bounded_rows(df, most, title)
    shown = [[("-" if v is None else f"{v:,.6g}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)) for v in r] for r in rows]
    widths = [max(len(x) for x in column) for column in zip(df.columns, *shown)]
    right = [t in ("double", "float", "int", "bigint", "smallint", "tinyint") for _, t in df.dtypes]
    line = lambda cells: "  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cells, widths, right)).rstrip()
    text = "\n".join([title, "=" * len(title), line(df.columns), line(["-" * w for w in widths]), *map(line, shown)]) + "\n"
    _write_text(df.sparkSession, path, text)
    return text


def rollout_dump(df: DataFrame, path: str, evaluation: bool = False) -> None:
    """Samples by rollout, evaluation apart from training."""
    df.withColumn("evaluation", F.lit(evaluation)).write.mode("append").partitionBy("rollout_id", "evaluation").parquet(path)


def rank_dump(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("rank").parquet(path)


def metrics(df: DataFrame, path: str, step: int, prefix: str = "") -> None:
    """Wide one-row metrics as rows (step, key, value)."""
    pairs = F.array(*[F.struct(F.lit(prefix + c).alias("key"), F.col(c).cast("double").alias("value")) for c in df.columns])
    df.select(F.explode(pairs).alias("m")).select(F.lit(step).alias("step"), "m.key", "m.value").write.mode("append").parquet(path)


def report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file per partition of a bounded result."""
    df.coalesce(1).write.mode("overwrite").json(path)


def required_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
