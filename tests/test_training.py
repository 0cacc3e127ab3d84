"""Training columns, contracts, joins with contracts, path reports and what else has no SQL."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import content
from millrace.operators import eval_config, joins, metrics, packing, training
from millrace.sources import cache

SAMPLE = "sample_index long, response_length int, reward double, status string, rollout_id long, metadata string, loss_mask array<int>, remove_sample boolean, rollout_log_probs array<double>, teacher_log_probs array<double>, other int"


def test_columns_by_what_the_table_holds(spark):
    rows = [(0, 3, 1.0, "truncated", None, '{"raw_reward": 5, "round_number": 2, "source_name": "a"}', None, None, [0.1] * 3, None, 1), (1, 2, 0.5, "completed", 0, None, [1, 0], False, None, [0.2] * 2, 1), (2, None, None, None, 0, '{"x": 1}', None, False, None, None, 1), (3, 2, 0.0, "completed", 7, "no json", [1, 1], True, None, None, 1)]
    out = training.train_columns(spark.createDataFrame(rows, SAMPLE))
    assert set(out.columns) == {"sample_index", "response_length", "reward", "raw_reward", "truncated", "rollout_id", "loss_mask", "rollout_log_probs", "round_number", "source_name", "rollout_mask_sum"}
    got = {r["sample_index"]: r for r in out.collect()}
    assert got[0]["rollout_id"] == 1 and got[0]["raw_reward"] == 5.0 and got[0]["truncated"] == 1 and got[0]["source_name"] == "a" and got[0]["round_number"] == 2
    assert got[1]["raw_reward"] == 0.5 and got[1]["rollout_mask_sum"] == got[2]["rollout_mask_sum"] == 1 and got[2]["loss_mask"] == [] and got[3]["loss_mask"] == [0, 0] and got[3]["rollout_mask_sum"] == 0
    plain = spark.createDataFrame([(0, 1, 1.0, None, 4, None)], "sample_index long, response_length int, reward double, status string, rollout_id long, metadata string")
    assert set(training.train_columns(plain).columns) == {"sample_index", "response_length", "reward", "raw_reward", "truncated", "rollout_id", "loss_mask", "rollout_mask_sum"}
    row = training.train_columns(plain, target=F.lit(2.5)).first()
    assert row["reward"] == 0.0 and row["regression_target"] == 2.5
    keyed = plain.withColumn("reward", F.create_map(F.lit("a"), F.lit(0.25)))
    assert training.train_columns(keyed, "a").first()["reward"] == 0.25 and training.train_columns(keyed, "b").first()["reward"] is None
    assert training.train_columns(plain.limit(0)).count() == 0
    with pytest.raises(Exception, match="differs in length"):
        training.train_columns(spark.createDataFrame([(0, 3, 1.0, None, 1, None, [1], False, None, None, 1)], SAMPLE)).collect()


def test_contract_of_the_sequence_objective(spark):
    schema = "sample_index long, group_index long, rollout_id long, response_length int, remove_sample boolean"
    good = spark.createDataFrame([(i, i // 2, i, 3, False) for i in range(6)], schema)
    assert training.assert_maxrl(good, 2).count() == 6 and all(r["violations"] == 0 for r in training.maxrl_violations(good, 2).collect())
    bad = spark.createDataFrame([(0, 0, 0, 3, False), (1, 0, 0, 0, False), (2, None, 2, None, True), (3, 1, 3, 2, False)], schema)
    assert {r["rule"]: r["violations"] for r in training.maxrl_violations(bad, 2).collect()} == {"shared_rollout_id": 1, "empty_response": 2, "removed_sample": 1, "no_group": 1, "incomplete_group": 1}
    with pytest.raises(ValueError, match="no_group"):
        training.assert_maxrl(bad, 2)


def test_zigzag_covers_every_trained_token(spark):
    rows = [(n, r) for n in (1, 2, 7, 8, 9, 40, 41) for r in (0, 1, 5, 17) if r <= n]
    out = spark.createDataFrame(rows, "n long, r long").select("n", "r", training.zigzag(F.col("n"), F.col("r"), 2).alias("z")).collect()
    for x in out:
        tokens = sorted(t for z in x["z"] for k in "01" for t in range(*z[f"tokens_{k}"]))
        assert tokens == list(range(max(x["n"] - x["r"], 1), x["n"])), x
        assert sorted(t for z in x["z"] for k in "01" for t in range(*z[f"chunk_{k}"])) == list(range(4 * x["z"][0]["chunk_size"]))


def test_eval_data_sets():
    d = eval_config.datasets
    assert d(["/p"]) == [{"name": "aime", "path": "/p"}] and d(["a", "/p", "b", "/q"]) == [{"name": "a", "path": "/p"}, {"name": "b", "path": "/q"}] and d(None) == d([]) == []
    assert d({"a": None, "b": {"name": "c"}}) == [{"name": "a"}, {"name": "c"}] and d([{"name": "x", "n": 1}]) == [{"name": "x", "n": 1}]
    for wrong, error in ((["a", "b", "c"], ValueError), ([{"path": "x"}], ValueError), ("text", TypeError), (5, TypeError)):
        with pytest.raises(error):
            d(wrong)
    fields = {"n": (("n", "k"), ("n",), ("eval_n", "n"))}
    assert eval_config.resolved({"k": 3}, {"n": 4}, {"n": 5}, fields)["n"] == 3 and eval_config.resolved({"n": None}, {"n": 4}, {"n": 5}, fields)["n"] is None
    assert eval_config.resolved({}, {"n": 4}, {"n": 5}, fields)["n"] == 4 and eval_config.resolved({}, None, {"eval_n": None, "n": 5}, fields)["n"] == 5 and eval_config.resolved({}, {}, {}, fields)["n"] is None
    assert eval_config.with_overrides({"a": 1, "rm_type": "x"}, {"b": 2}, "math") == {"a": 1, "rm_type": "math", "b": 2} and eval_config.with_overrides("text", {}) == {}


def test_paths_of_two_prompts(spark):
    rows = spark.range(2048).select((F.col("id") % 2).alias("group_index"), (F.col("id") == 0).alias("success"), F.lit(False).alias("optimal"), F.when(F.col("id") == 0, "ok").otherwise("wall").alias("reason"))
    got = {r["metric"]: r["value"] for r in metrics.maze_report(rows, (1, 4, 16, 64, 256, 1024), size=1024).collect()}
    assert got["pass@1"] == pytest.approx(1 / 2048) and got["pass@1024"] == pytest.approx(0.5) and got["optimal_pass@1024"] == 0 and got["success_rate"] == pytest.approx(1 / 2048) and got["reason/ok"] == pytest.approx(1 / 2048)
    assert set(got) >= {"optimal_pass@1", "pass@256", "optimal_rate", "reason/wall"}
    for bad in (rows.where("not (group_index = 1 and reason = 'wall' and rand() < 2)").unionByName(rows.limit(3)), rows):
        with pytest.raises(ValueError):
            metrics.maze_report(bad, (1,), size=1000)
    assert metrics.maze_report(rows.limit(0), (1,)).count() == 0 and {r["metric"] for r in metrics.maze_train_metrics(rows).collect()} == {"success_rate", "optimal_rate", "reason/ok", "reason/wall"}


def test_strict_pass_at_k():
    assert metrics.strict_pass_at_k(1024, 1, 1024) == 1.0 and metrics.strict_pass_at_k(4, 1, 2) == pytest.approx(0.5) and metrics.strict_pass_at_k(4, 0, 4) == 0
    for wrong in ((4, 5, 1), (4, -1, 1), (4, 1, 0), (4, 1, 5)):
        with pytest.raises(ValueError):
            metrics.strict_pass_at_k(*wrong)


def test_adaptive_bins(spark):
    values = [float(v) for v in np.random.default_rng(1).normal(size=500).round(2)] + [99.0, -99.0]
    out = sorted(metrics.adaptive_histogram(spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double"), "x", 10).collect(), key=lambda r: r["bin"])
    low, high = np.quantile(values, [0.005, 0.995])
    inner = [v for v in values if low <= v <= high]
    counts, edges = np.histogram(inner, bins=10)
    assert [r["n"] for r in out[1:-1]] == counts.tolist() and np.allclose([r["low"] for r in out[1:-1]], edges[:-1])
    assert out[0]["n"] == sum(v < low for v in values) and out[-1]["n"] == sum(v > high for v in values) and out[0]["low"] is None and out[-1]["high"] is None
    one = metrics.adaptive_histogram(spark.createDataFrame([(3.0,)] * 5, "x double"), "x", 10).where("bin = 1").first()
    assert (one["low"], one["high"], one["n"]) == (2.5, 3.5, 5) and metrics.adaptive_histogram(spark.createDataFrame([], "x double"), "x", 3).count() == 0


def test_as_of_against_brute_force(spark):
    rng = random.Random(2)
    pick = lambda: ("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.choice([None, *range(60)]))
    left = [(i, *pick()) for i in range(300)]
    right = [(1000 + i, *pick(), rng.choice([None, i])) for i in range(120)]
    a, b = spark.createDataFrame(left, "i long, k string, t long").repartition(5), spark.createDataFrame(right, "i long, k string, t long, v long")
    got = {r["i"]: r["v_as_of"] for r in joins.as_of(a, b, "k", "t", "i", ["v"]).collect()}
    want = {}
    for i, k, t in left:
        before = [(u, j, v) for j, q, u, v in right if k is not None and t is not None and q == k and u is not None and u <= t]
        want[i] = max(before, key=lambda x: x[:2])[2] if before else None
    assert got == want and any(v is not None for v in want.values())
    assert joins.as_of(a.limit(0), b, "k", "t", "i", ["v"]).count() == 0 and joins.as_of(a, b.limit(0), "k", "t", "i", ["v"]).where("v_as_of is not null").count() == 0


def test_keyed_join_and_members(spark):
    a = spark.createDataFrame([(1, "x", 2), (1, None, 2), (3, "y", 4)], "a int, b string, c int")
    b = spark.createDataFrame([(1, "x", 2, 9), (1, None, 2, 8), (1, None, 2, 7)], "a int, b string, c int, v int")
    assert [r["v"] for r in joins.keyed(a, b, ["a", "b", "c"]).collect()] == [9]
    with pytest.raises(ValueError, match="more than once"):
        joins.keyed(a, b.unionByName(b), ["a", "b", "c"])
    inside, outside = joins.members(a, spark.createDataFrame([("x",), (None,), ("x",)], "b string"), "b")
    assert inside.count() == 1 and outside.count() == 2


def test_parts_of_one_size():
    assert packing.greedy([5, 1, 1, 1], 2) == [[0], [1, 2, 3]] and packing.greedy([5, 1, 1, 1], 2, True) == [[0, 3], [1, 2]]
    with pytest.raises(ValueError):
        packing.greedy([1, 2, 3], 2, True)


def test_deltas_and_images():
    old, new = np.arange(50, dtype=np.uint8), np.arange(50, dtype=np.uint8)
    new[[3, 40]] = 255
    delta = content.overwrite_delta(new, old)
    assert (content.with_delta(old, delta) == new).all() and (content.with_delta(new, delta) == new).all() and len(delta) == 4 + 2 * 5
    image = content.image_of
    assert image({"type": "image", "image": "data:image/png;base64,aGk="}) == ("bytes", b"hi") and image({"type": "image_url", "image_url": {"url": "file:///a/b.png"}}) == ("path", "/a/b.png")
    assert image({"image": b"x"}) == ("bytes", b"x") and image({"image": "aGk="}) == ("bytes", b"hi") and image({"image": "pic.jpeg"}) == ("path", "pic.jpeg") and image({"type": "text", "text": "t"}) is None and image({"image": "http://h/x"}) == ("path", "http://h/x") and image({"type": "image", "image": "no base 64"}) == ("path", "no base 64")


def test_cached_tables_follow_their_source(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.read.parquet(str(tmp_path / "in")).withColumn("y", F.col("id") + 1)

    spark.range(3).write.parquet(str(tmp_path / "in"))
    ask = lambda version: cache.cached(spark, str(tmp_path / "in"), str(tmp_path / "root"), version, build).count()
    assert (ask("1"), ask("1"), len(made)) == (3, 3, 1)
    assert (ask("2"), len(made)) == (3, 2)
    spark.range(2).write.mode("append").parquet(str(tmp_path / "in"))
    assert (ask("2"), len(made)) == (5, 3)
