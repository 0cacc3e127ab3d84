"""Scans, sinks, streams and the forecast data set on small files."""

import gzip
import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import filters, forecast, intervals, metrics, registry, retrieval, splits, transforms
from millrace.sources import readers, sinks
from millrace.streaming import jobs


def test_jsonl_and_slices(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(['{"a": 1}', "", "{broken", '{"a": 2}', '{"a": 3}', '{"a": 4}']))
    assert [r["a"] for r in readers.read(spark, str(path)).orderBy("a").collect()] == [1, 2, 3, 4]
    assert [r["a"] for r in readers.read(spark, f"{path}@[1:3]", ["a"]).orderBy("a").collect()] == [2, 3]
    assert [r["a"] for r in readers.read(spark, f"{path}@[2:]", ["a"]).orderBy("a").collect()] == [3, 4]
    for bad, error in ((f"{path}@[-1:]", ValueError), (str(tmp_path / "none.jsonl"), FileNotFoundError), (str(tmp_path), ValueError)):
        with pytest.raises(error):
            readers.read(spark, bad)


def test_other_scans(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"q": "x"}, {"q": "y"}]')
    assert readers.json_array(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "d.js").write_text('var data = [{"q": "x", "n": 1},\n {"q": "y", "n": 2}];\n')
    assert [r["n"] for r in readers.javascript_array(spark, str(tmp_path / "d.js"), "q string, n int").collect()] == [1, 2]
    with gzip.open(tmp_path / "t.json.gz", "wt") as f:
        json.dump({"traceEvents": [{"ph": "X", "ts": 1.0, "dur": 2.0, "cat": "kernel", "name": "k", "tid": "1", "pid": "1"}, {"ph": "M"}]}, f)
    assert readers.chrome_trace(spark, str(tmp_path / "t.json.gz")).count() == 1
    ids = spark.createDataFrame([(1,), (2,)], "i int")
    assert readers.checked_ids(ids, "i").count() == 2
    for bad in ([(1,), (1,)], [(None,)], []):
        with pytest.raises(ValueError):
            readers.checked_ids(spark.createDataFrame(bad, "i int"), "i")
    df = spark.range(10)
    assert sorted(r["id"] for r in readers.head_and_tail(df, 5, "id").collect()) == [0, 1, 7, 8, 9]
    assert readers.empty(spark, 3).count() == 3
    m = readers.maze_rows(spark, 4, 7, 1).collect()
    assert len({r["prompt"] for r in m}) == 4 and sorted(map(tuple, readers.maze_rows(spark, 4, 7, 1).repartition(3).collect())) == sorted(map(tuple, m))


def test_sinks(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    path = str(tmp_path / "out")
    sinks.parquet(df, path, schema, {"seed": 42})
    assert dict(spark.read.parquet(path).dtypes) == {"a": "int", "b": "string"} and sinks.lineage_of(spark, path) == {"seed": 42}
    assert sinks.reloaded(spark, path, {"seed": 42}, df.select("b")).count() == 2
    for lineage, identity in (({"seed": 1}, None), ({"seed": 42}, df.select("b").limit(1))):
        with pytest.raises(ValueError):
            sinks.reloaded(spark, path, lineage, identity)
    with pytest.raises(Exception, match="a is null"):
        sinks.parquet(spark.createDataFrame([(None, "x")], "a long, b string"), str(tmp_path / "bad"), schema)
    nan = spark.createDataFrame([(float("nan"),), (1.5,)], "x double")
    sinks.jsonl(nan, str(tmp_path / "j"))
    assert sorted(r["x"] or 0 for r in spark.read.schema("x double").json(str(tmp_path / "j")).collect()) == [0, 1.5]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.jsonl(nan, str(tmp_path / "j"))
    sinks.metrics(spark.createDataFrame([(1.0, 2)], "loss double, n int"), str(tmp_path / "m"), 3, "train/")
    assert {(r["step"], r["key"], r["value"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {(3, "train/loss", 1.0), (3, "train/n", 2.0)}
    sinks.rollout_dump(spark.createDataFrame([(1, 5)], "rollout_id long, v int"), str(tmp_path / "d"))
    assert readers.dump(spark, str(tmp_path / "d") + "/rollout_id={rollout_id}", 1).count() == 1


def test_group_buffer_over_micro_batches(spark, tmp_path):
    for i, rows in enumerate(([("a", 1), ("b", 2)], [("a", 3), ("a", 4)], [("a", 5), ("b", 6), ("c", 7)])):
        spark.createDataFrame(rows, "instance string, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("instance string, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = jobs.drained(jobs.accumulated_groups(stream, "instance", ["v"], 2), label="t").collect()
    sizes = {}
    for r in out:
        sizes.setdefault((r["instance"], r["batch_id"]), []).append(r["v"])
    assert {k[0] for k in sizes} == {"a", "b"} and all(len(v) >= 2 for v in sizes.values()) and sum(map(len, sizes.values())) in (5, 6)


def test_last_chunks_over_micro_batches(spark, tmp_path):
    day = lambda h: datetime.datetime(2025, 1, 1) + datetime.timedelta(hours=h)
    for i, rows in enumerate(([("a", 1, "x", day(0)), ("b", 2, None, day(0))], [("a", 3, "xyz", day(1)), ("a", 2, "xy", day(1)), ("c", None, "n", day(1))], [("b", 5, "q", day(30)), ("a", 1, "old", day(2))], [("b", 6, "r", day(40))])):
        spark.createDataFrame(rows, "k string, n int, v string, at timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("k string, n int, v string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = jobs.drained(jobs.last_chunk(stream, "k", "n", "v", "at"), "update", "c").collect()
    best = {}
    for r in sorted(out, key=lambda r: r["batch_id"]):
        best[r["k"]] = max(best.get(r["k"], (0, "")), (r["n"], r["v"] or ""))
    assert best == {"a": (3, "xyz"), "b": (6, "r")}
    nothing = jobs.drained(stream.where("false").select("k"), label="n")
    assert nothing.count() == 0 and "batch_id" in nothing.columns


def test_predictions_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, "a"), (2, None, None)], "i long, p double, s string").repartition(3)
    path = str(tmp_path / "p.jsonl")
    for _ in range(2):  # the second one replaces the first
        sinks.predictions(rows, path)
    assert sorted((json.loads(x) for x in open(path)), key=lambda r: r["i"]) == [{"i": 1, "p": 0.5, "s": "a"}, {"i": 2, "p": None, "s": None}]
    assert [f for f in os.listdir(tmp_path) if "tmp" in f and not f.startswith(".")] == []
    with pytest.raises(ValueError, match="not finite"):
        sinks.predictions(rows.withColumn("p", F.lit(float("nan"))), path)
    sinks.predictions(rows.limit(0), str(tmp_path / "e.jsonl"))
    assert open(tmp_path / "e.jsonl").read() == ""
    text = sinks.text_report(spark.createDataFrame([("x", 1234, 0.5), (None, None, 2.0)], "name string, n long, share double"), str(tmp_path / "r.txt"), "Shares")
    assert text == "Shares\n======\nname      n  share\n----  -----  -----\nx     1,234    0.5\n-         -      2\n" and open(tmp_path / "r.txt").read() == text
    with pytest.raises(ValueError):
        sinks.text_report(rows, str(tmp_path / "q.txt"), "t", most=1)


def test_slices_follow_files_and_rows(spark, tmp_path):
    for i in range(4):  # the largest file comes last by name, and a scan takes it first
        spark.range(i * 100, i * 100 + 10 + 30 * i).coalesce(1).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    names = sorted(f for f in os.listdir(tmp_path / "t.parquet") if f.endswith(".parquet"))
    want = [r["id"] for f in names for r in spark.read.parquet(str(tmp_path / "t.parquet" / f)).collect()]
    got = readers.read(spark, f"{tmp_path}/t.parquet@[5:75]")
    assert sorted(r["id"] for r in got.collect()) == sorted(want[5:75]) and got.columns == ["id"]
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps({"x": i}) for i in range(20)))
    assert sorted(r["x"] for r in readers.read(spark, f"{tmp_path}/l.jsonl@[3:7]").collect()) == [3, 4, 5, 6]


def test_islands_of_a_hot_key(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), s := rng.randrange(4000), s + rng.choice([0, 1, 3, 400 if rng.random() < 0.02 else 2])) for _ in range(900)] + [(None, 1, 2), (None, 2, 5), ("a", None, 3), ("a", 9, 3)]
    df = spark.createDataFrame(rows, "k string, start long, end long").repartition(7)
    whole = {tuple(r) for r in intervals.merged(df, ["k"]).select("k", "start", "end").collect()}
    assert {tuple(r) for r in intervals.merged_ranged(df, ["k"]).select("k", "start", "end").collect()} == whole and len(whole) > 100
    assert intervals.merged_ranged(df.limit(0), ["k"]).count() == 0


def test_retry_job_resumes(spark, tmp_path):
    spark.createDataFrame([(1, "ok"), (2, "aborted"), (3, None)], "i long, status string").write.parquet(str(tmp_path / "in"))
    base = str(tmp_path / "base")
    stream = jobs.table_stream(spark, str(tmp_path / "in"))
    run = jobs.with_retries(stream, "status = 'aborted'", base)
    run()
    run()  # nothing new: nothing is written twice
    read = lambda k: sorted(r["i"] for r in spark.read.schema("i long, status string").parquet(f"{base}/{k}/*").collect())
    assert read("done") == [1, 3] and read("retry") == [2]


def test_forecast_build(spark, tmp_path):
    (tmp_path / "q").mkdir(), (tmp_path / "r").mkdir()
    question = lambda i, dates: {"id": i, "source": "s", "question": f"Will it by {{resolution_date}}? ({i})", "background": None, "source_intro": "due {forecast_due_date}", "resolution_dates": dates, "freeze_datetime": "2025-01-01T00:00:00+00:00", "freeze_datetime_value": "N/A"}
    for day in ("2025-01-01", "2025-02-01"):
        (tmp_path / f"q/{day}-llm.json").write_text(json.dumps({"forecast_due_date": day, "questions": [question("one", ["2025-03-01", "2025-03-02"]), question("two", "N/A"), question(["one", "two"], "N/A")]}))
        resolutions = [{"id": "one", "source": "s", "direction": None, "resolution_date": "2025-03-01", "resolved_to": 1.0, "resolved": True}, {"id": "one", "source": "s", "direction": None, "resolution_date": "2025-03-02", "resolved_to": 0.5, "resolved": True}, {"id": "two", "source": "s", "direction": None, "resolution_date": "2025-04-01", "resolved_to": 0.0, "resolved": True}, {"id": "two", "source": "s", "direction": None, "resolution_date": "2024-04-01", "resolved_to": 0.0, "resolved": True}]
        (tmp_path / f"r/{day}_resolution_set.json").write_text(json.dumps({"question_set": f"{day}-llm.json", "resolutions": resolutions}))
    q, r = readers.dated_pairs(spark, str(tmp_path / "q"), str(tmp_path / "r"), forecast.QUESTIONS, forecast.RESOLUTIONS)
    rows = forecast.earliest(forecast.candidates(q, r, "2025-01-15"))
    got = {(x["instance_key"], x["resolved_value"]) for x in rows.collect()}
    assert got == {("multi_horizon|s|one|2025-01-01|2025-03-01", 1), ("multi_horizon|s|one|2025-02-01|2025-03-01", 1), ("single_event|s|two", 0)}
    assert rows.where("id = 'one' and round = '2025-01-01'").first()["question"] == "Will it by 2025-03-01? (one)"
    parts = forecast.split(rows, 0, 1, 42).groupBy("part").count().collect()
    assert sum(p["count"] for p in parts) == 3
    (tmp_path / "q/2025-03-01-llm.json").write_text(json.dumps({"forecast_due_date": "2025-03-01", "questions": []}))
    with pytest.raises(ValueError):
        readers.dated_pairs(spark, str(tmp_path / "q"), str(tmp_path / "r"), forecast.QUESTIONS, forecast.RESOLUTIONS)


def test_registry(spark):
    @registry.register("stage", "halved")
    def halved(df):
        return df.where("id % 2 = 0")

    assert registry.apply_stages(spark.range(4), ["halved"]).count() == 2
    assert registry.resolve("expr", "pyspark.sql.functions.upper") is F.upper
    with pytest.raises(KeyError):
        registry.resolve("expr", "nothing")
    assert registry.grade("math", r"\boxed{3}", "3") == 1.0 and registry.grade(None, "x", "y") is None and registry.grade("f1", None, "y") == 0.0
    assert registry.grade("boxed_f1", r"it is \boxed{Paris}", "Paris") == 1.0 and registry.grade("boxed_f1", "Paris", "Paris") == 0.0 and registry.grade("boxed_math", r"\boxed{3}", "3") == 0.0
    assert registry.grade("dapo", "Answer: 42", "42") == 1.0 and registry.grade("dapo", "42", "42") == -1.0 and registry.grade("dapo", "Answer: 1", "one") is None and registry.grade("dapo", "Answer: 1", None) is None
    assert registry.grade("f1", "Answer: B", "x", '{"rm_type": "gpqa", "correct_letter": "B"}') == 1.0 and registry.grade("f1", "x", "x", "no json") == 1.0
    with pytest.raises(NotImplementedError):
        registry.grade("bleu", "x", "y")
    rows = spark.createDataFrame([("f1", "x", "x", None), (None, "x", "x", None), ("gpqa", "B", "2", '{"correct_letter": "B"}')], "k string, r string, l string, m string")
    assert [r["reward"] for r in registry.graded(rows, "k", "r", "l", metadata="m").collect()] == [1.0, None, 1.0]


def test_splits(spark):
    df = spark.range(1000).withColumn("s", F.col("id") % 3)
    parts = splits.apportioned(df, "s", "id", [("train", 0.8), ("val", 0.1), ("test", 0.1)], 42)
    counts = {(r["s"], r["part"]): r["count"] for r in parts.groupBy("s", "part").count().collect()}
    assert sum(counts.values()) == 1000 and counts[0, "train"] == 267 and counts[1, "val"] in (33, 34)
    wrap = splits.batch(spark.range(10), "id", 1, 8, 5, 10).collect()
    assert sorted((r["epoch"], r["position"]) for r in wrap) == [(0, 8), (0, 9), (1, 0), (1, 1), (1, 2)]
    fam = {r["s"]: r["part"] for r in splits.family_split(df, "s", 300, 1).collect()}
    assert sorted(fam.values()) == ["eval", "train", "train"]
    assert [r["p"] for r in transforms.positioned(spark.range(50).repartition(7), ["id"], "p").orderBy("id").collect()] == list(range(50))


def test_retrieval_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    x[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = retrieval.dense_top_k(v, v.where("vec_id < 3"), 4).collect()
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for q in range(3):
        want = sorted(range(60), key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:4]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert retrieval.dense_top_k(v.limit(0), v.limit(0), 4).count() == 0


def test_filters_and_metrics(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 0.0), (2, 1.0), (3, 0.5), (4, None)], "group_index long, reward double")
    assert {r["group_index"] for r in filters.nonzero_std(df).collect()} == {2}
    assert {r["reason"]: r["groups"] for r in metrics.drop_reasons(df.where("reward is not null")).collect()} == {"zero_std_1.0": 1, "zero_std_0.5": 1}
    many = spark.createDataFrame([(g, 1.0 if i == 0 else 0.0) for g in range(2) for i in range(1024)], "group_index long, reward double")
    rates = {r["k"]: r["pass_rate"] for r in metrics.pass_rates(many.withColumn("reward", F.when(F.col("group_index") == 0, F.col("reward")).otherwise(0.0)), (1, 1024)).collect()}
    assert rates[1] == pytest.approx(1 / 2048) and rates[1024] == pytest.approx(0.5)
    with pytest.raises(Exception, match="more than 1 words"):
        filters.short_enough(spark.createDataFrame([("a b",)], "t string"), "t", 1, strict=True).count()
    ties = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "a double, b double")
    assert metrics.spearman(ties, "a", "b").first()["spearman"] == pytest.approx(8 / 9)
    assert metrics.spearman(ties.limit(1), "a", "b").first()["spearman"] is None


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 501), (None, 100)) for v in rng.integers(0, 40, n)] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in metrics.exact_quantiles(df, "v", {"q0": 0.0, "med": 0.5, "p95": 0.95, "q1": 1.0}, ["k"]).collect()}
    assert set(got) == {"a", "b", "c", None}
    for k, r in got.items():
        xs = [v for kk, v in rows if kk == k and v is not None]
        assert [r["q0"], r["med"], r["p95"], r["q1"]] == pytest.approx(np.quantile(xs, [0, 0.5, 0.95, 1]).tolist())
    whole = metrics.statistics(df, "v").first()
    xs = [v for _, v in rows if v is not None]
    assert whole["median"] == pytest.approx(float(np.median(xs))) and whole["n"] == len(xs)
