"""Near pairs of questions of every length, and the blocks of long ones."""

import random

import numpy as np

from millrace.llm import split_overlap

RECORD = "problem_id long, question string, answer_value string, answer_unit string, specified_answer_unit string, problem_source string, olympiad_source string, split string, ingested_at timestamp_ntz"


def test_a_word_added_to_four(spark):
    texts = [("red green blue grey", "train"), ("red green blue grey pink", "val"), ("one two six", "train"), ("one two six ten", "val"), ("big old dim hut hill", "train"), ("big old dim hut", "test")]
    df = spark.createDataFrame([(i, q, "1", None, None, "X | s | 1", None, s, None) for i, (q, s) in enumerate(texts)], RECORD)
    assert {tuple(r) for r in split_overlap.found(df).collect()} == {(0, 1), (4, 5)}
    assert sum(r["near"] for r in split_overlap.report(df).collect()) == 2


def test_every_length_against_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    for n in [*range(1, 13), 23, 24, 28, 29, 30, 31, 36, 37, 96, 119, 120, 121, 150]:
        for _ in range(3):
            base = [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(n)]
            texts.append(base)
            for _ in range(3):
                t = list(base)
                for _ in range(rng.randrange(0, n // 5 + 3)):
                    at = rng.randrange(len(t) + 1)
                    t[at : at + rng.randrange(2)] = [f"z{rng.randrange(50)}"] * rng.randrange(2)
                texts.append(t)
    sides = [rng.choice(["train", "val", "test"]) for _ in texts]
    df = spark.createDataFrame([(i, " ".join(t), "1", None, None, "X | s | 1", None, s, None) for i, (t, s) in enumerate(zip(texts, sides))], RECORD)
    near = lambda a, b: bool(a and b) and split_overlap.within(a, b, split_overlap.allowed_edits(max(len(a), len(b))))
    train, other = ([i for i, s in enumerate(sides) if (s == "train") is side] for side in (True, False))
    want = {(min(i, j), max(i, j)) for i in train for j in other if near(texts[i], texts[j])}
    assert {tuple(r) for r in split_overlap.found(df).collect()} == want
    assert any(len(texts[i]) < 30 <= len(texts[j]) or len(texts[j]) < 30 <= len(texts[i]) for i, j in want)


def test_blocks_grow_with_the_length():
    counts = np.zeros(split_overlap.BUCKETS, np.int64)
    for n in (42, 400, 4_000, 40_000):
        _, _, blocks = split_overlap.fingerprints(np.arange(n) * 7919, np.array([n]), counts)
        assert 0 < blocks[0] <= 4 * n


def test_classes_with_their_links(spark):
    texts = [("red green blue grey pink", "train"), ("Red, green blue grey pink!", "val"), ("red green blue grey", "test"), ("one two six ten", "val"), ("red green blue grey pink", "train"), (None, "train")]
    df = spark.createDataFrame([(i, q, "1", None, None, "X | s | 1", None, s, None) for i, (q, s) in enumerate(texts)], RECORD)
    got = {r["problem_id"]: r for r in split_overlap.classes_with_links(df).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and got[0]["class_id"] == got[1]["class_id"] == got[4]["class_id"] != got[2]["class_id"]
    assert {i: (r["same"], r["links"]) for i, r in got.items()} == {0: (True, 1), 1: (True, 0), 2: (False, 1), 3: (False, 0), 4: (True, 1)}


def test_batches_are_coded_in_runs(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(split_overlap, "WORDS", 50)
    sizes = [10, 45, 200, 0, 3, 3, 60]
    batch = pa.RecordBatch.from_arrays([pa.array([list(range(n)) for n in sizes], pa.list_(pa.int64()))], ["words"])
    runs = list(split_overlap._runs(batch))
    assert [len(x) for r in runs for x in r.column("words").to_pylist()] == sizes and len(runs) >= 3
    assert list(split_overlap._runs(batch.slice(0, 0))) == []
    flat = [r.column("words").flatten().to_pylist() for r in runs]
    assert sum(map(len, flat)) == sum(sizes)
