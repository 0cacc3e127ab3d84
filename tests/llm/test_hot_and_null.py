"""Settings with nulls, exchanges between parts, hot forms, tables kept between jobs, forced collisions."""

import random

from millrace.llm import bin_packing, format_dedup, mixing, related_splits, tokenizer, visual_form

RECORD = "problem_id long, question string, answer_value string, answer_unit string, specified_answer_unit string, problem_source string, olympiad_source string, split string, ingested_at timestamp_ntz"


def test_bins_are_exchanged_between_parts(spark):
    rng = random.Random(5)
    lengths = [rng.choice([7, 19, 33, 34, 35, 51, 52, 66, 67, 90]) for _ in range(600)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    limits = spark.createDataFrame([("s", 100)], "setting string, capacity int")
    out = bin_packing.pack(items, limits, items_per_part=50).collect()
    fill = {}
    for r in out:
        fill[r["bin"]] = fill.get(r["bin"], 0) + r["length"]
    assert sorted(r["item"] for r in out) == list(range(600)) and max(fill.values()) <= 100
    alone = sum(len(set(bin_packing.best_fit_decreasing(bin_packing.np.array([x for i, x in enumerate(lengths) if i % 12 == p]), 100).tolist())) for p in range(12))
    assert len(fill) < alone and any(r["round"] for r in out)


def test_null_settings_of_a_mixture(spark):
    counts = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "doc_id long, source string, n_tokens long")
    lines = [("m", "a", 0.5, None, 1.0), ("m", "b", 0.5, 3, None), ("n", "a", None, 3, 1.0), ("n", "b", 0.5, 3, 1.0)]
    targets = spark.createDataFrame(lines, "mixture string, source string, target_share double, max_repeats int, size_factor double")
    got = {(r["mixture"], r["source"]): r["rate"] for r in mixing.rates(counts, targets).collect()}
    assert got == {("m", "a"): 0.0, ("m", "b"): 0.0, ("n", "a"): 0.0, ("n", "b"): 1.0}


def test_copies_of_a_hot_form(spark):
    rows = [(i, "same text") for i in range(300)] + [(300, "ѕаme text"), (301, "ѕаme text"), (302, "sаme text"), (303, "other"), (0, "same text")]
    got = {tuple(r) for r in visual_form.lookalikes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, j) for i in range(300) for j in (300, 301, 302)} | {(300, 302), (301, 302)}


def test_a_forced_collision(spark):
    groups = spark.createDataFrame([("problems", 1, 2, 10, 5, 3), ("problems", 1, 2, 11, 6, 1), ("problems", 1, 3, 10, 7, 1), ("raw_records", 1, 2, 10, 8, 1)], "tbl string, h1 long, h2 long, check long, first_id long, copies long")
    assert [tuple(r) for r in format_dedup.collisions(groups).collect()] == [("problems", 1, 2, 2)]


def test_two_jobs_and_members(spark):
    import datetime

    day = lambda d: datetime.datetime(2025, 1, d)
    rows = [(i, "q", "1", None, None, f"X | source {i % 7} | 1", None, "train", day(1 + i % 20)) for i in range(70)]
    rows += [(70, "q", "1", None, None, "X | source 1 | 1", "source 2", "train", day(25)), (71, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, RECORD)
    got = {r["problem_id"]: r for r in related_splits.split_in_jobs(df).collect()}
    assert set(got) == set(range(72)) and {r["increment"] for r in got.values()} == {0, 1}
    now = {}
    for i in range(70):
        now.setdefault(got[i]["component"], set()).add(got[i]["split_now"])
        assert got[i]["split_now"] in (got[i]["split_first"], related_splits.QUARANTINE)
    assert all(len(s) == 1 for s in now.values()) and got[1]["component"] == got[2]["component"] == got[70]["component"]
    members = {r["source"]: (r["component"], r["spellings"]) for r in related_splits.source_members(df).collect()}
    assert len(members) == 7 and members["source 1"] == members["source 2"] and members["source 1"][1] == 2 and members["source 3"][1] == 1
    assert {tuple(r) for r in related_splits.same_sources(df).collect()} == {("source 1", "source 2")}


def test_pattern_is_read_and_not_run(tmp_path):
    (tmp_path / "__init__.py").write_text("raise SystemExit\nPATTERN = 'a+' 'b'\n")
    assert tokenizer.stated_pattern(str(tmp_path)) == "a+b"
