"""Queries over every row, in any script, against brute force in Python."""

import re
import string
import unicodedata
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry

TEXTS = ["The «Cat», an ÉTÉ!", "a the café — an", "für the Übung", "Σίσυφος a ΟΔΟΣ", "猫 a 坐 the", "a² thé", "á an", "Ответ: the 5", "yes", "plain an ascii", "", "the naïve  naïve　x"]
LABELS = ["a cat ÉTÉ", "café", "Übung für", "οδος σίσυφος", "猫 坐", "a²", "x", "ответ 5", "yes", None, "a", "naïve naïve y"]
QUESTIONS = [("ﬁve — Straße?", "1"), ("FIVE — strasse?", "2"), ("how  many　cats", "1"), ("how many cats", "3"), ("Сколько?", "4"), ("сколько?", "4"), (None, "5"), ("plain", "7.5 µm\n"), ("x1", "2770 °F"), ("x2", "8.48×10²"), ("x3", "about 5"), ("x4", "12"), ("x5", "3 ")]


def normal(text):
    plain = "".join(c for c in text.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", plain).split())


def f1(a, b):
    p, t = normal(a), normal(b)
    same = sum((Counter(p.split()) & Counter(t.split())).values())
    if not same or p != t and {p, t} & {"yes", "no", "noanswer"}:
        return 0.0
    return 2 * same / (len(p.split()) + len(t.split()))


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("scripts"))
    rows = [(i, "s", t, t, y) for i, (t, y) in enumerate(zip(TEXTS, LABELS))] + [(99, "s", None, None, "x")]
    spark.createDataFrame(rows + rows[:3], "sample_index long, source string, prompt string, response string, label string").write.parquet(f"{d}/samples.parquet")
    spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(QUESTIONS)], "problem_id long, question string, answer_value string").write.parquet(f"{d}/problems.parquet")
    spark.createDataFrame([(0, "é" * 257), (1, "𝒳" * 256), (2, None), (3, "a")], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def result(spark, data, name):
    return {r[0]: tuple(r)[1:] if len(r) > 2 else r[1] for r in entry.queries()[name](spark, data).collect()}


def test_answers_of_every_row(spark, data):
    both = {i: (t, y) for i, (t, y) in enumerate(zip(TEXTS, LABELS)) if y is not None}
    assert result(spark, data, "k1_normalized_answers") == {i: normal(t) for i, t in enumerate(TEXTS)}
    assert result(spark, data, "k2_token_f1") == pytest.approx({i: f1(*x) for i, x in both.items()}, abs=1e-6)
    assert result(spark, data, "k3_exact_match") == {i: int(normal(t) == normal(y)) for i, (t, y) in both.items()}
    assert result(spark, data, "k33_sanitized_queries") == {i: " ".join(re.sub(r"[^\w\s]", " ", t).split()) for i, t in enumerate(TEXTS)}


def test_questions_of_every_row(spark, data):
    form = {i: " ".join(unicodedata.normalize("NFKC", q).casefold().split()) for i, (q, _) in enumerate(QUESTIONS) if q is not None}
    assert result(spark, data, "k20_normalized_questions") == form
    groups = defaultdict(list)
    for i, q in form.items():
        groups[q].append(QUESTIONS[i][1])
    assert result(spark, data, "e35_conflicting_answers") == {q: (len(set(v)), len(v)) for q, v in groups.items() if len(set(v)) > 1}
    split = result(spark, data, "k19_split_answers")
    assert [split[i] for i in range(7, 13)] == [("7.5", "µm"), ("2770", "°F"), ("8.48", "×10²"), ("", ""), ("12", ""), ("3", "")] and len(split) == len(QUESTIONS)


def test_texts_of_every_row(spark, data):
    assert result(spark, data, "c31_compact_texts") == {0: "é" * 256 + "...", 1: "𝒳" * 256, 3: "a"}
