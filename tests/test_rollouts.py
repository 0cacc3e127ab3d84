"""Siblings, requeues, skips, remote rewards, cursors and kinds of kernels."""

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import kernel_kind
from millrace.operators import rollouts


def test_requeues_run_only_what_failed(spark):
    seen = []

    def run(rows, attempt):
        seen.append(rows.count())
        return rows.withColumn("bad", F.col("id") >= attempt * 2)

    out = {r["id"]: (r["attempts"], r["given_up"]) for r in rollouts.requeued(spark.range(5), run, "bad", 2).collect()}
    assert out == {0: (1, False), 1: (1, False), 2: (2, False), 3: (2, False), 4: (2, True)} and seen == [5, 3]
    assert rollouts.requeued(spark.range(0), run, "bad", 3).count() == 0


def test_each_finished_entry_takes_one_row(spark):
    rows = rollouts.repeated(spark.createDataFrame([("a",), ("b",), (None,)], "k string"), 2, 2)
    left = rollouts.without_finished(rows, spark.createDataFrame([("a",), ("a",), ("a",), ("c",), (None,)], "k string"), "k", ["round", "copy"]).collect()
    assert sorted((r["k"] or "", r["round"], r["copy"]) for r in left) == [("", 0, 0), ("", 0, 1), ("", 1, 0), ("", 1, 1), ("a", 1, 1), ("b", 0, 0), ("b", 0, 1), ("b", 1, 0), ("b", 1, 1)]


def test_remote_rewards_try_again(spark, tmp_path):
    folder = str(tmp_path)

    def client(rows):
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        if len(os.listdir(folder)) < 3:
            raise OSError("away")
        return [None if r["label"] is None else float(r["response"] == r["label"]) for r in rows]

    df = spark.createDataFrame([("p", "x", "x", 1), ("p", None, "y", 2), ("p", "z", None, 3)], "prompt string, response string, label string, i int").coalesce(1)
    out = rollouts.remote_rewards(df, client, wait=lambda s: None)
    assert [(r["i"], r["reward"]) for r in out.orderBy("i").collect()] == [(1, 1.0), (2, 0.0), (3, None)] and out.columns == [*df.columns, "reward"]

    def away(rows):
        raise OSError("away")

    with pytest.raises(Exception, match="away"):
        rollouts.remote_rewards(df, away, tries=2, wait=lambda s: None).collect()


def test_interactions(spark):
    rows = spark.createDataFrame([("COMPLETED", 5, [1], [1, 2], "Judgment: 2. Judgment: 1", [1], "length"), ("paused", None, [1, 1], [1], "Judgment: 9", [], ""), (None, None, [], [1, 2, 3], "none", None, None), ("Aborted", None, None, None, None, [], "abort")], "s string, n int, m array<int>, t array<int>, r string, u array<int>, f string")
    got = rows.select(rollouts.interaction_status(F.col("s")).alias("s"), rollouts.interaction_length(F.col("n"), F.col("m"), F.col("t")).alias("n"), rollouts.selected_index(F.col("r"), F.lit(3)).alias("i"), rollouts.turn_finish(F.col("u"), F.col("f")).alias("f")).collect()
    assert [tuple(r) for r in got] == [("completed", 5, 1, "tool_calls"), (None, 2, None, "stop"), (None, 3, None, "stop"), ("aborted", 0, None, "abort")]


def test_unsafe_code(spark):
    code = {"import numpy as np": None, "import OS": r"import\\s+os", "x = eval (3)": r"eval\\s*\\(", "from requests import x": "import of x", "a.__class__": r"__\\w+__", None: None, "print(1)": None}
    rows = spark.createDataFrame([(k,) for k in code], "c string")
    got = {r["c"]: r["r"] for r in rows.select("c", rollouts.unsafe_reason(F.col("c"), ["numpy"]).alias("r")).collect()}
    assert got == {k: v.replace("\\\\", "\\") if v else v for k, v in code.items()}


def test_cursors_go_on(spark):
    df = spark.range(7)
    whole = rollouts.Cursor("id", 3, 7)
    one = [(r["epoch"], r["position"], r["id"]) for _ in range(4) for r in sorted(whole.take(df, 5).collect(), key=lambda r: (r["epoch"], r["position"]))]
    cursor, two = rollouts.Cursor("id", 3, 7), []
    for _ in range(4):
        two += [(r["epoch"], r["position"], r["id"]) for r in sorted(cursor.take(df, 5).collect(), key=lambda r: (r["epoch"], r["position"]))]
        cursor = rollouts.Cursor.restored(cursor.saved(), 7)
    assert one == two and sorted(x[2] for x in one[:7]) == list(range(7))
    with pytest.raises(ValueError):
        rollouts.Cursor.restored(cursor.saved(), 8)
    assert rollouts.Cursor("id", 3, 0).take(df.limit(0), 5).count() == 0


def test_kernel_kinds(spark):
    names = {"ncclDevKernel": "NCCL Communication", "deep_ep::combine": "DeepEP Combine (MoE)", "deep_ep_x": "DeepEP (other)", "FlashAttnFwd": "Flash Attention", "fmha": "Attention (other)", "cutlass_80": "GEMM/MatMul (other)", "RMSNorm": "Normalization", "vectorized_elementwise": "Elementwise Ops", "CatArrayBatchedCopy": "Concat/Cat", "cat": "Other Compute", "x": "Other Compute", None: None}
    rows = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r["n"]: r["k"] for r in rows.select("n", kernel_kind(F.col("n")).alias("k")).collect()} == names
