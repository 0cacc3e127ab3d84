"""What comes between generation and training: siblings, requeues, skips, remote rewards, statuses, resumable cursors."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import splits
from millrace.operators.transforms import positioned
from millrace.runtime import cut

#: Seconds between tries of a remote client at most; each wait doubles from one second on, and a random part of a second is added.
LONGEST_WAIT = 30


def fan_out(df: DataFrame, index: str, most: int) -> DataFrame:
    """1 + index % ``most`` siblings of each row, numbered from 0 in ``sibling``, that share the index as ``rollout_id``. A null index has no siblings."""
    return df.withColumn("sibling", F.explode(F.sequence(F.lit(0).cast("long"), F.pmod(F.col(index), F.lit(most)).cast("long")))).withColumn("rollout_id", F.col(index))


def repeated(df: DataFrame, times: int, each: int) -> DataFrame:
    """Every row ``each`` times in every one of ``times`` rounds, with (round, copy)."""
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return df.withColumn("round", steps(times)).withColumn("copy", steps(each))


def without_finished(df: DataFrame, finished: DataFrame, key: str, order: Iterable[str]) -> DataFrame:
    """Rows that are left when each entry of ``finished`` takes out one row of its key, the first ones in ``order``.

    Rows are numbered within their key by range partitions, so a key of any size will do. Null keys stay.
    """
    taken = finished.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_f")).agg(F.count("*").alias("_taken"))
    placed = positioned(df, order, "_at", keys=[key])
    left = placed.join(taken, F.col(key) == F.col("_f"), "left")
    return left.where(F.col("_at") >= F.coalesce("_taken", F.lit(0))).select(*df.columns)


def requeued(df: DataFrame, run: Callable[[DataFrame, int], DataFrame], failed: str, most: int) -> DataFrame:
    """Rows after at most ``most`` attempts, with ``attempts`` and ``given_up``: failed ones are run again, and only they.

    ``run`` maps (rows, attempt from 1) to the rows with their outcome; ``failed`` is a condition on it. Rows are cut
    between attempts, so that a lost executor repeats no attempt.
    """
    columns, todo, done = df.columns, df, None
    for attempt in range(1, most + 1):
        out = cut(run(todo, attempt).withColumn("_failed", F.coalesce(F.expr(failed), F.lit(False))))
        keep = out if attempt == most else out.where("not _failed")
        keep = keep.withColumn("attempts", F.lit(attempt)).withColumnRenamed("_failed", "given_up")
        done = keep if done is None else done.unionByName(keep)
        todo = out.where("_failed").select(*columns)
        if attempt == most or todo.isEmpty():
            return done
    raise ValueError("no attempt is allowed")


def remote_rewards(df: DataFrame, client: Callable[[list[dict]], list[float | None]], columns: tuple[str, str, str] = ("prompt", "response", "label"), tries: int = 10, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """``reward`` of each row from a client that grades a batch of {prompt, response, label}.

    A batch that fails is tried again after ``min(2 ** n, LONGEST_WAIT)`` seconds and a random part of one; the last failure
    fails the task. The client goes to the executors with the job.
    """
    schema = df.withColumn("reward", F.lit(None).cast("double")).schema

    def graded(rows: list[dict]) -> list[float | None]:
        for n in range(tries):
            try:
                return client(rows)
            except Exception:  # noqa: BLE001  whatever a client raises is worth another try
                if n + 1 == tries:
                    raise
                wait(min(2.0**n, LONGEST_WAIT) + random.random())
        raise ValueError("no try is allowed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [dict(zip(("prompt", "response", "label"), r)) for r in b[list(columns)].itertuples(index=False)]
            yield b.assign(reward=pd.array(graded(rows) if rows else [], dtype="Float64"))

    return df.mapInPandas(run, schema)


def interaction_length(response_length: Column, mask: Column, tokens: Column) -> Column:
    """Length of an interaction's response: stated, else the mask's, else the tokens', else 0."""
    some = lambda c: F.when(F.size(c) > 0, F.size(c))
    return F.coalesce(response_length, some(mask), some(tokens), F.lit(0))


def interaction_status(status: Column) -> Column:
    """Status of a sample from that of an interaction, in any case; null where it is another."""
    low = F.lower(status)
    return F.when(low.isin("completed", "truncated", "aborted"), low)


def turn_finish(tools: Column, raw: Column) -> Column:
    """A turn that called a tool ends by ``tool_calls``, another as it says, or by ``stop``."""
    return F.when(F.size(tools) > 0, "tool_calls").otherwise(F.coalesce(F.nullif(raw, F.lit("")), F.lit("stop")))


def selected_index(response: Column, candidates: Column) -> Column:
    """0-based candidate that the first ``Judgment: n`` of a response names; null if there is none of that number."""
    n = F.regexp_extract(response, r"Judgment:\s*(\d+)", 1).try_cast("int") - 1
    return F.when((n >= 0) & (n < candidates), n)


# What executed snippets must not hold.
UNSAFE = (
    r"import\s+os", r"import\s+sys", r"import\s+subprocess", r"import\s+shutil", r"import\s+glob", r"import\s+pathlib", r"__import__", r"eval\s*\(", r"exec\s*\(", r"open\s*\(", r"file\s*\(", r"input\s*\(", r"raw_input\s*\(", r"compile\s*\(",
    r"execfile\s*\(", r"getattr\s*\(", r"setattr\s*\(", r"delattr\s*\(", r"hasattr\s*\(", r"globals\s*\(", r"locals\s*\(", r"vars\s*\(", r"dir\s*\(", r"type\s*\(", r"isinstance\s*\(", r"issubclass\s*\(", r"super\s*\(", r"property\s*\(",
    r"staticmethod\s*\(", r"classmethod\s*\(", r"__\w+__",
)


def unsafe_reason(code: Column, allowed: Iterable[str]) -> Column:
    """Why a snippet must not be run: the first unsafe pattern it holds, or a module outside ``allowed``; null if neither. Null code is safe."""
    first = F.coalesce(*[F.when(F.regexp_like(code, F.lit(f"(?i){p}")), F.lit(p)) for p in UNSAFE])
    named = F.concat(F.regexp_extract_all(code, F.lit(r"import\s+(\w+)"), 1), F.regexp_extract_all(code, F.lit(r"from\s+(\w+)"), 1))
    other = F.get(F.array_except(named, F.array(*map(F.lit, allowed))), F.lit(0))
    return F.coalesce(first, F.when(other.isNotNull(), F.concat(F.lit("import of "), other)))


@dataclass
class Cursor:
    """A place in endless shuffled epochs of a table, that can be saved and gone on from."""

    key: str
    seed: int
    rows: int
    offset: int = 0

    def take(self, df: DataFrame, n: int) -> DataFrame:
        """The next n rows with (epoch, position); they may span epochs. An empty table gives none."""
        if not self.rows:
            return df.limit(0).withColumn("position", F.lit(0).cast("long")).withColumn("epoch", F.lit(0))
        out = splits.batch(df, self.key, self.seed, self.offset, n, self.rows)
        self.offset += n
        return out

    def saved(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @staticmethod
    def restored(text: str, rows: int) -> Cursor:
        """The cursor of a saved text, for a table of as many rows; another number is an error, as places would differ."""
        cursor = Cursor(**json.loads(text))
        if cursor.rows != rows:
            raise ValueError(f"the table had {cursor.rows} rows, now {rows}")
        return cursor
