"""Problem 7: models and cutoffs come from all rows of the tables."""

from collections import Counter

import pytest

from millrace.llm import response_defects as rd
from millrace.llm.gram_models import CELLS

SAMPLES = "sample_index long, session_id string, status string, created_at timestamp, prompt string, response string"
TEXTS = {
    "en": ("How far does the wagon travel and what does it carry?", "The wagon travels about {} miles and it carries the stones of the old town each day."),
    "de": ("Welche Strecke ergeben die Steine und wie schwer sind sie?", "Die Steine ergeben etwa {} Meter und sie sind nicht schwer, wenn man sie zählt."),
    "fr": ("Quelle est la distance et combien de pierres pour cela?", "La distance est environ de {} mètres et les pierres sont dans la tour du village."),
}


def test_the_language_model_counts_every_document(spark):
    """The only German texts come behind 6,000 English ones, one of them longer than 20,000 characters."""
    rows = [("en", TEXTS["en"][1].format(i)) for i in range(6_000)] + [("de", TEXTS["de"][1].format(i)) for i in range(50)] + [("de", TEXTS["de"][1] * 400), (None, "x" * 50), ("en", None)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    model = rd.language_model(rd.labelled_texts(docs.coalesce(1)))
    assert model is not None and rd.TextModels.named(model, [TEXTS["de"][1].format(7)]) == ["de"]
    seen = []
    for parts in (1, 5):
        texts = rd.labelled_texts(docs.repartition(parts))
        models = rd.language_models(texts)
        kinds = rd.document_kinds(texts, models[1:])
        assert kinds.total() == 6_051
        seen.append((kinds, [m.table.tolist() for m in models]))
    assert seen[0] == seen[1]


def test_refusals_are_learned_from_every_response(spark):
    """All refusals come behind 4,000 other answers."""
    rows = [(f"It weighs {i} kilos.",) for i in range(4_000)] + [("I'm sorry, but I can't help with that.",)] * 30 + [(None,)]
    model = rd.refusal_model(spark.createDataFrame(rows, "response string").coalesce(1))
    assert model.classes == ("other", "refusal") and model.table.shape == (CELLS, 2)
    assert rd.refusal_model(spark.createDataFrame(rows[:-12], "response string")) is None


def test_cutoffs_count_every_sound_pair(spark):
    pairs = [(TEXTS[k][0], TEXTS[k][1].format(i)) for i in range(400) for k in TEXTS]
    rows = [(i, None, "truncated" if i < 5 else None, None, p, r) for i, (p, r) in enumerate(pairs)] + [(9_999, None, None, None, "How many?", None), (7, None, None, None, *pairs[7])]
    train, turns = spark.createDataFrame([], "sample_indices long, truncated int"), spark.createDataFrame([], "session_id string, turn int, finish_reason string")
    samples = spark.createDataFrame(rows, SAMPLES)
    seen = []
    for parts in (1, 6):
        counts = rd.counts_of_marks(rd.votes(samples.repartition(parts), train, turns, rd.TextModels()))
        assert counts["language"] == {rd.CODES["en"]: 398, rd.CODES["de"]: 398, rd.CODES["fr"]: 399}  # but for the five that are cut
        assert all(counts[k].total() == 1_195 for k in rd.MARKS)
        seen.append((counts, [tuple(r) for r in rd.labelled(samples.repartition(parts), train, turns).orderBy("sample_index").collect()]))
    assert seen[0] == seen[1]


def test_kinds_of_prompts_and_texts_stand_for_all_pairs():
    """The mean over all texts of another language, against the votes on each such pair."""
    prompts = [TEXTS[k][0] for k in TEXTS for _ in range(2)] + [TEXTS["de"][0] + " Bitte antworte auf Englisch.", "42?"]
    texts = [(k, TEXTS[k][1].format(i)) for k in TEXTS for i in range(3)] + [("de", "Steine Strecken Meter " * 4), ("fr", TEXTS["en"][1])]
    models = rd.TextModels()
    want: Counter = Counter()
    for p in prompts:
        lang = rd.language(p)[0]
        others = {k for k, _ in texts} - {lang}
        if not lang or rd.asked_language(p):
            continue
        for k in others:
            mine = [t for x, t in texts if x == k]
            for v in rd.pair_votes([p] * len(mine), mine, models):
                want[rd.pattern_of(v, "wrong_language")] += 1 / len(others) / len(mine)
    kinds = Counter((rd.CODES[k], rd.text_code(rd.text_kind(rd.content(t), None))) for k, t in texts)
    asked = Counter((rd.CODES[w], 0 if rd.asked_language(p) else rd.prompt_code(w, None)) for p in prompts if (w := rd.language(p)[0]))
    got = rd.planted_languages(asked, kinds)
    assert len(got) > 1 and got == pytest.approx(dict(want))
    assert all(code <= 1 << rd.MARKS["text"] for _, code in kinds)
