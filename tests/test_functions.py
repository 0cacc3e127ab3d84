"""Graders, mazes, masks, packings, trajectories: hand-derived expectations, invariants, brute force."""

import itertools
import math
import random

import numpy as np
import pytest

from millrace.functions import content, grading, masks, mazes, unit_audit
from millrace.operators import advantages, packing, trajectory


@pytest.mark.parametrize(
    ("prediction", "truth", "f1"),
    [("The cat sat", "a cat sat", 1.0), ("cat", "dog", 0.0), ("yes", "yes indeed", 0.0), ("noanswer", "noanswer", 1.0), (None, "x", 0.0), ("a b c", "b c d", 2 * (2 / 2) * (2 / 3) / (2 / 2 + 2 / 3)), ("x x y", "x y y", 2 / 3)],
)
def test_f1(prediction, truth, f1):
    assert grading.f1_score(prediction, truth)[0] == pytest.approx(f1)


def test_boxes():
    assert grading.last_boxed(r"a \boxed{1} then \boxed{\frac{1}{2}} end") == r"\frac{1}{2}"
    assert grading.last_boxed(r"\boxed{1") is None and grading.last_boxed("none") is None and grading.last_boxed(None) is None


@pytest.mark.parametrize(
    ("given", "truth", "equal"),
    [("1/2", r"\frac{1}{2}", True), ("0.5", r"\frac12", True), (r"\dfrac{3}{4}", r"\frac34", True), ("1,000", "1000", True), ("(1, 2)", "(1,2)", True), ("(1,2)", "[1,2]", False), ("2/4", "1/2", False), ("x=5", "5", True), (r"5\text{ cm}", "5", True), ("5.0", "5", False), ("0.25", "1/4", True), ("", "5", False), (r"50\%", "50", True), (r"\sqrt3", r"\sqrt{3}", True), (r"90^\circ", "90", True), ("3", "4", False)],
)
def test_math_equality(given, truth, equal):
    assert grading.equal_math(given, truth) is equal


@pytest.mark.parametrize(
    ("given", "truth", "equal"),
    [("x+1", "1+x", True), (r"\sqrt{8}", r"2\sqrt{2}", True), (r"\frac{x}{2}", "x/2", True), ("2x(x-1)", "2x^2-2x", True), (r"3\pi", r"\pi\cdot 3", True), ("x^2-y^2", "(x-y)(x+y)", True), ("xy", "yx", True), (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt{2}}{2}", True), (r"\sqrt[3]{8x}", r"2\sqrt[3]{x}", True), ("-x", "0-x", True),
     ("x+1", "x+2", False), ("x", "y", False), ("x+y+z", "z+y+x", False), ("x^{2}", "x*x", False), ("2+3", "5", False), ("x/0", "x/0+1", False), ("red", "der", False), ("x+", "x", False), ("(x", "x", False), (r"\sin x", r"\sin{x}", False), ("(x+1, 2)", "(1+x, 2)", True), ("x" * 500 + "+1", "1+" + "x" * 500, False), ("(" * 300, "x", False)],
)
def test_formulas(given, truth, equal):
    assert grading.equal_math(given, truth) is equal


def test_math_rewards():
    assert grading.math_reward(r"so \boxed{5}", "5") == 1 and grading.math_reward("so 5", "5") == 0 and grading.math_reward(r"\boxed{5}", r"\boxed{5}") == 1
    assert grading.reasoned_math_reward(r"<think>x</think> \boxed{5}", "5") == 1 and grading.reasoned_math_reward(r"\boxed{5}", "5") == 0
    assert grading.integer_answer_reward("Answer: $1,234$", "1234") == 1 and grading.integer_answer_reward("no", "3") == -1 and grading.integer_answer_reward("Answer: 7\nAnswer: 8 dollars", "8") == 1
    assert grading.strict_box_reward(r"\boxed{8}", "8") == 1 and grading.strict_box_reward("8", "8") == -1
    with pytest.raises(ValueError):
        grading.integer_answer_reward("Answer: 1", "one")


def test_choices():
    assert grading.option_letter("The answer is B.") == "B" and grading.option_letter("I pick (C)") == "C" and grading.option_letter("<think>A</think> hmm") is None
    assert grading.choice_reward("Answer: B", "B") == 1 and grading.choice_reward("Answer: A", 1, {"choices": ["x", "y"]}) == 0 and grading.choice_reward("it is the red one", "red one", {"choices": ["blue", "red one"]}) == 1 and grading.choice_reward(None, "B") == 0

    for text, letter in (("My choice is D", "D"), ("A is correct here", "A"), ("E is the correct option", "E"), ("we ruled out A, then B, settled on C", "C"), ("My answer is J", "J"), ("My answer is Q", None)):
        assert grading.option_letter(text) == letter
    reward = grading.choice_reward
    assert reward("I just pick B", "J") == 0 and reward("J", "j") == 1 and reward("it is x2", "x", {"valid_letters": ["A", "B"]}) == 0 and reward("it is x", "x", {"valid_letters": ["A", "B"]}) == 1
    assert reward("Answer: B", "irrelevant", {"correct_letter": "b"}) == 1 and reward("the sea", None, {"correct_answer": "The Sea!"}) == 1 and reward("nothing", None, {}) == 0 and reward("the red", 9, {"choices": {"a": "blue", "b": "red"}}) == 0
    assert reward("so the second, red", 1, {"choices": {"a": "blue", "b": "red"}}) == 1


def test_integer_forms():
    table = {"x = 42": "42", "an answer": "answer", "42 square": "42", "100 dollars": "100", r"\text{hello}": "hello", r"\boxed{42}": "42", "1,234,567": "1234567", "a b c": "bc", "42<|endoftext|>": "42", "42<|im_end|>": "42", r"so $x = 7$.": "7.", "so $7.$ then": "7", "7.$": "7", r"\$5.00": "5.00", r"$\text{7}\text{ cm}$": "7", "": ""}
    assert {k: grading.integer_form(k) for k in table} == table


def test_log10():
    assert grading.positive_log10("1e1000000") == 1_000_000 and grading.positive_log10("-3") is None and grading.positive_log10(True) is None and grading.positive_log10("12,34") is None
    assert grading.positive_log10("1,234.5") == pytest.approx(math.log10(1234.5)) and grading.positive_log10("0.00") is None
    assert grading.answer_log10(r"it is \boxed{3.2\times 10^{5}}") == pytest.approx(math.log10(3.2e5)) and grading.answer_log10("10^-3") == -3
    assert grading.fermi_score(2.0, 3.5) == (0.5, 0.0) and grading.fermi_score(None, 1) == (0.0, 0.0) and grading.fermi_score(1.5, 1.0)[1] == 1.0


def test_probabilities():
    assert grading.probability("0.4") == 0.4 and grading.probability(r"\boxed{0.25}") == 0.25 and grading.probability("<think>0.9</think> 0.3") == 0.3 and grading.probability("1.2") is None
    assert grading.probability("<probability>0.7</probability>") == 0.7 and grading.probability("<probability>0.7</probability> more") is None and grading.probability("x " * 25 + "<probability>0.7</probability>", 20) == 0.7
    assert grading.probability("<probability>0.7</probability>", 20) is None


def test_search_formats():
    good = "<|im_start|>assistant\n<think>a</think><search>q</search><information>Paris is it</information><think>b</think><answer>Paris</answer>"
    assert grading.valid_search_sequence(good) and not grading.valid_search_sequence(good.replace("</think><search>", "</think>x<search>"))
    assert grading.search_answer("<answer>e</answer>" + good) == "Paris" and grading.search_answer(good) is None
    assert grading.search_reward("<answer>e</answer>" + good, ["paris"]) == 1.0 and grading.search_reward(good, ["paris"]) == pytest.approx(0.3)
    assert grading.search_action("x <search> q </search>") == ("search", "q") and grading.search_action("x") == (None, "")


def test_tool_actions():
    assert grading.tool_action(r"Answer: \boxed{4}") == ("answer", "4")
    assert grading.tool_action('<tool_call>{"name": "code_interpreter", "arguments": {"code": "print(1)"}}</tool_call>') == ("code", "print(1)")
    assert grading.tool_action("```python\nx\n```") == ("code", "x") and grading.tool_action("hi") == (None, "")
    assert grading.cut_after_action("<code>x</code> and more") == "<code>x</code>"


def test_context_and_repetition():
    doc = "First line here.\nThe quick brown fox jumps over dogs.\nLast."
    assert grading.snippet_context("short ... The quick brown fox jumps over dogs", doc) == "The quick brown fox jumps over dogs."
    assert grading.repetitive("ab" * 6000) and not grading.repetitive("ab") and not grading.repetitive(None)


def test_mazes():
    for method in ("dfs", "prim"):
        grid = mazes.generate(11, 3, method)
        assert mazes.parse(mazes.render(grid)) == grid
        path = mazes.shortest_path(grid)
        text = mazes.render(grid)
        assert mazes.validate(text, " ".join([*path, "DONE"]))[:3] == (True, True, "success")
        assert mazes.validate(text, " ".join(path))[2] == "missing_done" and mazes.validate(text, "FLY DONE")[2] == "invalid_action"
        assert mazes.validate(text, " ".join([*path, "UP", "DONE"]))[2] == "action_after_goal" and mazes.validate(text, "DONE")[2] == "not_at_goal"
        assert mazes.validate(text, " ".join([*path, "DONE", "x"]))[2] == "trailing_token"
        cells = sum(c != "WALL" for row in grid for c in row)
        assert cells == 2 * 25 - 1  # a perfect maze is a tree over its cells
    assert mazes.validate("nonsense", "DONE")[2] == "invalid_grid" and mazes.validate(None, None)[2] == "invalid_grid"


def test_masks():
    chat = [{"role": "system", "content": "be good"}, {"role": "user", "content": "hi you"}, {"role": "assistant", "content": "yes of course"}, {"role": "assistant", "content": "muted words", "step_loss_mask": 0}]
    text, _ = masks.rendered(chat, masks.TEMPLATES["qwen"])
    tokens, mask = masks.loss_mask(chat)
    assert [t.split()[:3] for t in masks.trained_texts(text, tokens, mask)] == [["yes", "of", "course<|im_end|>"]]
    assert masks.aligned([1, 0], 4) == [0, 0, 1, 0]
    with pytest.raises(ValueError):
        masks.aligned([1, 0], 1)


def test_first_fit_and_splits():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.randrange(0, 130) for _ in range(rng.randrange(1, 40))]
        plain, sums = [], []
        for i, n in enumerate(lengths):
            j = next((j for j, s in enumerate(sums) if s + n <= 100), None)
            if j is None:
                plain.append([i])
                sums.append(n)
            else:
                plain[j].append(i)
                sums[j] += n
        bins = packing.first_fit(lengths, 100)
        assert bins == plain
        more = packing.split_largest(bins, len(bins) + 3, lengths)
        assert sorted(i for b in more for i in b) == list(range(len(lengths))) and len(more) == min(len(bins) + 3, len(lengths)) if all(bins) else True


def test_balanced_parts():
    rng = random.Random(4)
    for _ in range(40):
        k = rng.randrange(1, 6)
        w = [rng.randrange(1, 50) for _ in range(k * rng.randrange(1, 7))]
        for equal in (True, False):
            parts = packing.largest_difference(w, k, equal)
            assert sorted(i for p in parts for i in p) == list(range(len(w))) and (not equal or len({len(p) for p in parts}) == 1)
        spread = [sum(w[i] for i in p) for p in packing.largest_difference(w, k)]
        assert max(spread) - min(spread) <= max(w)
    with pytest.raises(ValueError):
        packing.largest_difference([1], 2)


def test_schedule():
    rng = random.Random(6)
    lengths = [rng.randrange(1, 90) for _ in range(40)]
    rows = packing.schedule_step(lengths, 4, 100, align=2, balance=True)
    assert sorted(r[3] for r in rows) == list(range(40))
    per = {r: {m for q, m, *_ in rows if q == r} for r in range(4)}
    assert len({len(v) for v in per.values()}) == 1 and len(per[0]) % 2 == 0
    with pytest.raises(ValueError):
        packing.schedule_step([1] * 5, 4, None, micro_batch=2)
    assert packing.size_chunks([5, 5, 5, 20, 1], 10) == [0, 0, 1, 2, 3]


def test_trajectories():
    T = trajectory.Turn
    user, reply = (lambda x: {"role": "user", "content": x}), (lambda x: {"role": "assistant", "content": x})
    clean = [([user("a")], T([1, 2], [3, 4], "stop", [-1.0, -2.0]), reply("x")), ([user("a"), reply("x"), user("b")], T([1, 2, 3, 4, 5], [6], "length", [-3.0]), reply("y"))]
    (s,) = trajectory.linearised(trajectory.grow(trajectory.Node(), clean, 4), 4)
    assert s["tokens"] == [1, 2, 3, 4, 5, 6] and s["loss_mask"] == [1, 1, 0, 1] and s["log_probs"] == [-1.0, -2.0, 0.0, -3.0] and s["truncated"]
    drifted = [clean[0], (clean[1][0], T([1, 2, 3, 9, 5], [6], "stop"), reply("y"))]
    (s,) = trajectory.linearised(trajectory.grow(trajectory.Node(), drifted, 4), 4)
    assert s["tokens"] == [1, 2, 3, 9, 5, 6] and s["loss_mask"] == [0, 0, 0, 1]
    early = [clean[0], (clean[1][0], T([7, 2, 3, 4, 5], [6], "stop"), reply("y"))]
    assert len(trajectory.linearised(trajectory.grow(trajectory.Node(), early, 4), 4)) == 2
    branched = [clean[0], clean[1], ([user("a"), reply("x"), user("c")], T([1, 2, 3, 4, 8], [9], "stop"), reply("z"))]
    a, b = trajectory.linearised(trajectory.grow(trajectory.Node(), branched, 4), 4)
    assert a["loss_mask"] == [1, 1, 0, 1] and b["loss_mask"] == [0, 0, 0, 1]  # the shared turn is trained once
    rewritten = [clean[0], ([user("a"), reply("X!"), user("b")], T([1, 2, 3, 4, 5], [6], "stop"), reply("y"))]
    (s,) = trajectory.linearised(trajectory.grow(trajectory.Node(), rewritten, 4), 4)
    assert s["tokens"] == [1, 2, 3, 4, 5, 6] and s["loss_mask"] == [1]


def test_maxrl_against_all_subsets():
    rng = np.random.default_rng(1)
    for n in (2, 3, 5):
        ll = np.log(np.concatenate([rng.random(n - 1), [1.0]]))
        a, sigma = -np.expm1(ll), np.exp(ll)
        for degree in range(1, n + 1):
            omega = np.array([sum(sum(np.prod(c) for c in itertools.combinations(np.delete(a, j), d)) / math.comb(n - 1, d) for d in range(degree)) for j in range(n)])
            assert np.allclose(advantages.maxrl_weights(ll, degree, False), sigma * omega)
            assert np.allclose(advantages.maxrl_weights(ll, degree, True), n / (n - 1) * (sigma - sigma.mean()) * omega)
    assert advantages.maxrl_weights(np.array([-math.inf, -math.inf]), 2).tolist() == [0.0, 0.0]
    for bad in ([0.5, 0.1], [math.nan, -1]):
        with pytest.raises(ValueError):
            advantages.maxrl_weights(np.array(bad), 1)


def test_media_and_audit():
    parts = content.split_media("a<image>b<video>", {"image": ["i"], "video": ["v"]})
    assert [p["type"] for p in parts] == ["text", "image", "text", "video"]
    for text, media in (("<image>", {"image": []}), ("x", {"image": ["i"]})):
        with pytest.raises(ValueError):
            content.split_media(text, media)
    assert unit_audit.audit("How long is it? (feet)")[:2] == ("explicit_unit_specified", "foot") and unit_audit.audit("How many gears?")[0] == "unit_not_needed"
    assert unit_audit.audit("How heavy is it?")[0] == "unit_required_but_unspecified" and unit_audit.audit(None)[3:] == ("low", True) and len(unit_audit.logic_sha256()) == 64


def test_reverse_scans_of_ragged_rows(monkeypatch):
    from millrace.functions import tokens

    rng = np.random.default_rng(2)
    rows = [rng.normal(size=n) for n in (5, 0, 1, 40, 7, 7, 300)]
    for padded in (2_000_000, 50):
        monkeypatch.setattr(tokens, "PADDED", padded)
        for got, r in zip(tokens._discount(rows, 0.9), rows):
            want, g = [], 0.0
            for x in r[::-1]:
                g = x + 0.9 * g
                want.append(g)
            assert np.allclose(got, want[::-1])


def test_grouped_walk(spark):
    from millrace.operators.grouped import map_groups

    df = spark.range(5000).selectExpr("if(id % 7 = 0, null, id % 7) AS k", "id AS v")
    out = map_groups(df, ["k"], ["v"], lambda key, rows: [(key[0], len(rows), rows[0]["v"])], "k long, n int, first long").collect()
    assert sorted((r["k"] or 0, r["n"], r["first"]) for r in out) == [(k, len(range(k, 5000, 7)), k) for k in range(7)]
    assert map_groups(df.limit(0), ["k"], ["v"], lambda key, rows: [], "k long").count() == 0
