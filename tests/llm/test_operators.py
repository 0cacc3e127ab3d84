"""Each operator against brute force, and on nulls, empty tables, ties, long texts and clashing columns."""

import math
import random
import unicodedata
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import bin_packing, format_dedup, mixing, quantile_digest, related_splits, response_defects, split_overlap, tokenizer, visual_form

CLASH = "a b n key node root split rows part bucket block form t check id item length value count tbl pattern votes source_a c1 words copies u".split()
PROBLEMS = "problem_id long, question string, answer_value string, answer_unit string, specified_answer_unit string, problem_source string, olympiad_source string, split string, ingested_at timestamp_ntz"
SAMPLES = "sample_index long, session_id string, status string, created_at timestamp_ntz, prompt string, response string"
TRAIN = "sample_indices long, tokens array<int>, response_lengths int, truncated int"
TURNS = "session_id string, turn int, finish_reason string"
EVENTS = "event_id long, ts double, engine_id string, queue_time double, e2e_latency double, decode_throughput double"
DOCS = "doc_id long, text string, source string"


def clash(df):
    """The table with extra columns named like the operators' own."""
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH) if c not in df.columns])


def problems(spark, rows):
    """(id, question, answer, problem_source, olympiad_source, split) rows."""
    return clash(spark.createDataFrame([(i, q, a, None, None, s, o, sp, None) for i, q, a, s, o, sp in rows], PROBLEMS))


def pairs(df):
    return {tuple(r) for r in df.collect()}


# -- 1 ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Rifibela Acad Inv. 2024 (C)", "Inv._'24:_RIFIBELA_Academy_Div._C", True),
        ("State Finals '21: Rurovena Academy Div. C", "rurovena acad. - states, (2021), division c", True),
        ("Kuritino Coll. - Natl., 2011, Div B", "Kuritino Univ. - Natl., 2011, Div B", False),
        ("Kuritino Coll. - Natl., 2011, Div B", "Kuritino Coll. - Natl., 2012, Div B", False),
        ("Kuritino Coll. - Natl., 2011, Div B", "Kuritino Coll. - Reg., 2011, Div B", False),
        ("Kuritino Coll. - Natl., 2011, Div B", "Kuritino Coll. - Natl., 2011, Div C", False),
        ("batch 00175", "Batch-175", True),
        ("batch 00175", "notebook #175", False),
        ("OS-12B", "os-12b", True),
        ("Moviveme H.S. Invite 2018 (B)", "Moviveme  High School - Invitational, '18, Division B", True),
    ],
)
def test_source_keys(a, b, same):
    assert (related_splits.source_key(a) == related_splits.source_key(b)) == same


def test_chains_of_sources(spark):
    rows = [(1, "q", "1", "X | batch 1 | Q1", "code A", "train"), (2, "q", "1", "X | Batch #001 | Q", None, "val"), (3, "q", "1", "X | zzz | Q", " code A ", "test"), (4, "q", "1", None, None, None), (5, "q", "1", "X |  | Q", "", "val"), (6, "q", "1", "X", None, "val")]
    found = pairs(related_splits.same_sources(problems(spark, rows)))
    names = sorted(["batch 1", "code A", "Batch #001", "zzz"])
    assert found == set(combinations(names, 2))
    got = {r["problem_id"]: (r["component"], r["split"]) for r in related_splits.split_records(problems(spark, rows)).collect()}
    assert len(got) == 6 and len({got[i] for i in (1, 2, 3)}) == 1 and len({got[i][0] for i in (4, 5, 6)}) == 3


def test_random_components_and_shares(spark):
    rng = random.Random(5)
    rows = [(i, "q", "1", f"X | s{rng.randrange(150)} | Q", f"s{rng.randrange(150)}" if rng.random() < 0.15 else None, "train") for i in range(600)]
    rows += [(1000 + i, "q", "1", "X | hot | Q", None, "train") for i in range(300)]  # a third of all rows
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _, _, _, s, o, _ in rows:
        mine = s.split("|")[1].strip()
        root(mine)
        if o:
            up[root(o)] = root(mine)
    got = {r["problem_id"]: r for r in related_splits.split_records(problems(spark, rows)).collect()}
    by_root = {}
    for i, _, _, s, _, _ in rows:
        by_root.setdefault(root(s.split("|")[1].strip()), set()).add(got[i]["component"])
    assert all(len(c) == 1 for c in by_root.values()) and len({c for v in by_root.values() for c in v}) == len(by_root)
    assert all(len({got[i]["split"] for i in got if got[i]["component"] == c}) == 1 for v in by_root.values() for c in v)
    n = {k: sum(r["split"] == k for r in got.values()) for k in ("train", "val", "test")}
    largest = max(sum(r["component"] == c for r in got.values()) for v in by_root.values() for c in v)
    assert abs(n["val"] - 90) <= largest and abs(n["test"] - 90) <= largest and sum(n.values()) == 900


def test_increments_keep_splits_and_quarantine(spark):
    store = related_splits.ComponentTable(spark, [("x", 0.5), ("y", 0.5)])
    first = {r["record_id"]: r["split"] for r in store.add(spark.createDataFrame([(1, 10, None), (2, 20, None)], "record_id long, node_a long, node_b long")).collect()}
    assert sorted(first.values()) == ["x", "y"]
    later = {r["record_id"]: r["split"] for r in store.add(spark.createDataFrame([(3, 10, None), (4, 30, None)], "record_id long, node_a long, node_b long")).collect()}
    assert later[3] == first[1]
    merged = store.add(spark.createDataFrame([(5, 10, 20)], "record_id long, node_a long, node_b long")).collect()
    assert [r["split"] for r in merged] == [related_splits.QUARANTINE]


def test_quotas_equal_greedy():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 60))]
        total = sum(sizes)
        deficits = {"train": 0.8 * total, "val": 0.1 * total, "test": 0.1 * total}
        classes = [(s, sizes.count(s)) for s in set(sizes)]
        got = related_splits.quotas(classes, deficits)
        left = dict(deficits)
        for s in sorted(sizes, reverse=True):
            k = max(left, key=lambda x: left[x])
            left[k] -= s
        mine = dict(deficits)
        for s, parts in got.items():
            assert sum(n for _, n in parts) == sizes.count(s)
            for k, n in parts:
                mine[k] -= s * n
        assert sorted(round(v, 6) for v in mine.values()) == pytest.approx(sorted(left.values()), abs=max(sizes))


def test_empty_sources(spark):
    none = clash(spark.createDataFrame([], PROBLEMS))
    assert related_splits.same_sources(none).count() == 0
    assert related_splits.split_records(none).count() == 0


# -- 2 ------------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, [0] * (rng.choice([0, 5, 30, 31, 70, 100, 99, 250])), rng.randrange(40), 0) for i in range(400)]
    rows += [rows[0], (900, None, 3, 0), (None, [1], 1, 0), (901, [1] * 7, None, 1)]
    train = clash(spark.createDataFrame(rows, TRAIN))
    limits = clash(spark.createDataFrame([("s", 100), ("l", 1000), (None, 5)], "setting string, max_tokens_per_gpu int"))
    out = bin_packing.micro_batches(train, limits).collect()
    for setting, capacity in (("s", 100), ("l", 1000)):
        mine = [r for r in out if r["setting"] == setting]
        fill = {}
        for r in mine:
            fill[r["bin"]] = fill.get(r["bin"], 0) + r["length"]
        assert max(fill.values()) <= capacity
        whole = {}
        for r in mine:
            whole[r["sample_index"]] = whole.get(r["sample_index"], 0) + r["length"]
        assert whole == {i: len(t) for i, t, *_ in rows if i is not None and t is not None}
        assert all(r["length"] == capacity or len(dict((x[0], x[1] or []) for x in rows)[r["sample_index"]]) <= capacity or r["piece"] for r in mine)
        trained = sum(r["trained"] for r in mine)
        assert trained == sum(min(len(t), n or 0) for i, t, n, _ in {r[0]: r for r in rows if r[0] is not None and r[1] is not None}.values())
    assert bin_packing.certificate(spark.createDataFrame([], TRAIN), limits).count() == 0


def test_exchange_between_parts(spark):
    rng = random.Random(9)
    items = spark.createDataFrame([(i, rng.choice([51, 49, 34, 33, 12])) for i in range(3000)], "item long, length long")
    limits = spark.createDataFrame([("s", 100)], "setting string, capacity int")
    r = bin_packing.certified(bin_packing.pack(items, limits, items_per_part=200)).first()
    assert r["pieces"] == 3000 and r["bins"] >= r["bound"] and r["excess"] <= 0.03 * r["bound"]


def test_bounds_never_exceed_an_optimum():
    rng = random.Random(1)

    def optimum(items, c):
        best = len(items)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[i] <= c:
                    bins[j] += items[i]
                    go(i + 1, bins)
                    bins[j] -= items[i]
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best

    for _ in range(60):
        items = sorted((rng.randrange(1, 20) for _ in range(8)), reverse=True)
        best = optimum(items, 20)
        assert bin_packing.lower_bound(*np.unique(items, return_counts=True), 20) <= best
        assert bin_packing.best_fit_decreasing(np.array(items), 20).max() + 1 >= best


# -- 3 ------------------------------------------------------------------------------------


def test_percentiles_within_rank_error(spark):
    rng = random.Random(4)
    rows = []
    for i in range(6000):
        v = rng.choice([rng.lognormvariate(0, 2), 1.0, -0.001, 0.0])
        rows.append((i, 1740788044.0 + 86400 * (i % 3), "hot" if i % 3 else "cold", v, None if i % 5 == 0 else float("nan") if i % 7 == 0 else v * 2, None))
    rows += [rows[10], rows[11]]  # delivered again
    rows += [(7000, 1740788044.0, None, 5.0, float("inf"), None)]
    out = quantile_digest.engine_percentiles(clash(spark.createDataFrame(rows, EVENTS))).collect()
    seen = {}
    for e in {r[0]: r for r in rows}.values():
        day = "2025-03-0" + str(1 + (e[0] % 3 if e[0] < 6000 else 0))
        for m, v in (("queue_time", e[3]), ("e2e_latency", e[4])):
            if v is not None and not math.isnan(v):
                for d in (day, None):
                    seen.setdefault((e[2], d, m), []).append(v)
    assert {(r["engine_id"], r["day"], r["metric"]) for r in out} == set(seen)
    for r in out:
        xs = np.sort(seen[r["engine_id"], r["day"], r["metric"]])
        assert r["n"] == len(xs)
        slack = max(1, 2 * quantile_digest.EPS * len(xs))
        rank = math.ceil(r["p"] * len(xs))
        lo, hi = xs[int(max(0, rank - 1 - slack))], xs[int(min(len(xs) - 1, rank - 1 + slack))]
        if math.isinf(hi):
            continue
        wide = 2.0 ** -(quantile_digest.BITS - 12)
        assert lo - abs(lo) * wide - 1e-300 <= r["value"] <= hi + abs(hi) * wide + 1e-300


def test_compression_and_merge():
    rng = np.random.default_rng(0)
    x = rng.lognormal(0, 3, 200_000)
    leaves = quantile_digest.quantize(x) + (1 << quantile_digest.BITS)
    node, count = np.unique(leaves, return_counts=True)
    g, n, c = quantile_digest.compress(np.zeros(len(node), np.int64), node, count)
    assert c.sum() == len(x) and len(n) <= 3 * quantile_digest.K
    for p, value, total, error in quantile_digest.answer(n, c, (0.01, 0.5, 0.99)):
        true = np.searchsorted(np.sort(x), value) / len(x)
        assert abs(true - p) <= quantile_digest.EPS and error <= quantile_digest.EPS * total


def test_quantize_is_monotone():
    x = np.array([-math.inf, -1e300, -2.0, -1e-300, -0.0, 0.0, 1e-300, 1.0, 1.5, 2.0, 1e300, math.inf])
    q = quantile_digest.quantize(x)
    assert (np.diff(q) >= 0).all() and q[4] == q[5] and q[0] < q[2] < q[5] < q[7] < q[9] < q[11] < 1 << quantile_digest.BITS


def test_no_events(spark):
    assert quantile_digest.engine_percentiles(spark.createDataFrame([], EVENTS)).count() == 0
    assert quantile_digest.engine_percentiles(spark.createDataFrame([(1, None, None, None, None, None)], EVENTS)).count() == 0


# -- 4 ------------------------------------------------------------------------------------


def plain_form(text):
    out = ""
    text = text.casefold()
    for i, c in enumerate(text):
        digit = lambda j: 0 <= j < len(text) and unicodedata.category(text[j]) == "Nd"
        if (c == "." and digit(i - 1) and digit(i + 1)) or (c in "-−" and digit(i + 1)):
            out += "." if c == "." else "-"
        elif not c.isspace() and unicodedata.category(c)[0] != "P" and unicodedata.category(c) != "Cf":
            out += c
    return out


def test_copies(spark):
    base = ["How many?", "how  MANY", "«How many…»", "How many 1.5", "how many 15", "How many 1. 5", "x -5", "x 5", "x−5", "x- 5", "a+b", "ab", "a_b", "straße", "STRASSE", "", "?!", "²", "2", None, "x" * 200_000, "X" * 200_000 + "!"]
    answers = ["1", "1.0", "10", "-1", None]
    rows = [(k, q, a, None, None, "train") for k, (q, a) in enumerate((q, a) for q in base for a in answers)]
    raw = [(0, '{"question": "Q?", "answer_value": "7", "n": 1}'), (1, '{"answer_value":" 7 ",\n"question":"q"}'), (2, '{"question": "q"'), (3, None), (4, "[1]"), (5, '{"question": null, "answer_value": "7"}'), (6, '"q"'), (7, "")]
    r = clash(spark.createDataFrame(raw, "raw_id long, payload string"))
    p = problems(spark, rows)
    groups = {}
    for i, q, a, *_ in rows:
        if q is not None and a is not None:
            groups.setdefault((plain_form(q), plain_form(a)), []).append(i)
    want = {("problems", g[0], x) for g in groups.values() for x in g[1:]} | {("raw_records", 0, 1)}
    assert pairs(format_dedup.copies(p, r)) == want
    kept = {(x["tbl"], x["id"]): x["copies"] for x in format_dedup.deduplicated(p, r).collect()}
    assert kept == {("problems", g[0]): len(g) for g in groups.values()} | {("raw_records", 0): 2}
    assert format_dedup.collided(p, r).count() == 0
    assert format_dedup.copies(problems(spark, rows).limit(0), r.limit(0)).count() == 0


# -- 5 ------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def near(a, b):
    m = max(len(a), len(b))
    return m > 0 and 5 * distance(a, b) <= m


def test_overlaps_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 20
    rows, texts = [], []
    for i in range(260):
        if texts and rng.random() < 0.7:
            t = list(rng.choice(texts))
            for _ in range(rng.randrange(0, 7)):
                k = rng.randrange(3)
                at = rng.randrange(len(t)) if t else 0
                if k == 0 and t:
                    t[at] = rng.choice(vocabulary)
                elif k == 1 and t:
                    del t[at]
                else:
                    t.insert(at, rng.choice(vocabulary))
        else:
            t = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 20, 40]))]
        texts.append(t)
        rows.append((i, (", " if i % 2 else "  ").join(w.upper() if i % 3 else w for w in t), "1", "X | s | 1", None, rng.choice(["train", "train", "val", "test"])))
    rows += [(900, None, "1", None, None, "val"), (901, "", "1", None, None, "val"), (902, "?!", "1", None, None, "train"), (903, "w1 w2", "1", None, None, None)]
    long = ["x%d" % (i % 977) for i in range(6000)]
    rows += [(904, " ".join(long), "1", None, None, "train"), (905, " ".join(long[:-700]), "1", None, None, "val")]
    words = {i: split_overlap.words_of(q or "") for i, q, *_ in rows}
    side = {r[0]: None if r[5] is None else r[5] == "train" for r in rows}
    small = [i for i in words if i < 904]
    want = {(min(i, j), max(i, j)) for i in small for j in small if side[i] is True and side[j] is False and near(words[i], words[j])} | {(904, 905)}
    got = pairs(split_overlap.found(problems(spark, rows)))
    assert got == want
    report = split_overlap.report(problems(spark, rows)).collect()
    assert sum(r["overlapping"] for r in report) == len({j for p in want for j in p if side[j] is False})
    assert split_overlap.found(problems(spark, rows).limit(0)).count() == 0


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        most = rng.randrange(0, 6)
        assert split_overlap.within(a, b, most) == (distance(a, b) <= most)


# -- 7 ------------------------------------------------------------------------------------

CASES = [
    ("How many?", None, "empty"), ("How many?", "  ", "empty"), ("How many?", "<think>\nlong thoughts 5.\n</think>\n", "empty"), ("How many?", "**Answer:** \\boxed{ }", "empty"), ("How many?", "N/A", "empty"),
    ("How many?", "I'm sorry, but I can't help with that.", "refusal"), ("Combien ?", "Je ne peux pas répondre à cette question.", "refusal"), ("多少？", "抱歉，我无法回答这个问题。", "refusal"),
    ("How many?", "I cannot give an exact figure, but a fair estimate works. So the answer is about 40.", None), ("How many spools would Dana need each winter?", "**HOW MANY SPOOLS WOULD DANA NEED EACH WINTER**", "copy"),
    ("How many spools would Dana need each winter?", "How many spools would Dana need each winter? So the answer is about 7.", None),
    ("How heavy is the town clock and what would it take to lift it?", "Zuerst schätzen wir, dass die Uhr etwa 70 Kilo wiegt und dass wir sie nicht heben. Die Antwort lautet daher etwa 5.", "wrong_language"),
    ("How heavy is the town clock? Répondez en français.", "On suppose que la cloche pèse environ 7 kilos et que le reste est dans la tour. La réponse est donc 7.", None),
    ("How heavy is it?", "Each of the gears weighs close to 40 grams, which we round up for the", "truncated"), ("How heavy is it?", "Answer: \\frac{64", "truncated"), ("How heavy is it?", "The total comes to 40 gears.", None), ("How heavy is it?", "42", None), ("How heavy is it?", "No", None),
]


def test_defects(spark):
    sound = [("How heavy is the town clock?", f"First, assume that it holds {i} gears. So the answer is about {i * 7}.", None) for i in range(300)]
    rows = [(i, f"s{i}", "completed", None, p, r) for i, (p, r, _) in enumerate(CASES + sound)]
    n = len(CASES)
    rows += [(5000, "s5000", "truncated", None, "How heavy?", "So the answer is about 3."), (5001, None, None, None, "How heavy?", "So the answer is about 3."), (5002, "s5002", None, None, None, "So the answer is about 3."), (None, None, None, None, None, None), rows[0]]
    rows += [(5003, "s5003", None, None, "x " * 100_000, "The word is 3. " * 20_000)]
    train = clash(spark.createDataFrame([(n + 1, [1], 1, 1), (n + 1, [1], 1, 1), (n + 2, None, None, None), (None, None, None, 1)], TRAIN))
    turns = clash(spark.createDataFrame([(f"s{n + 3}", 0, "stop"), (f"s{n + 3}", 1, "length"), (f"s{n + 4}", 0, "length"), (f"s{n + 4}", 1, "stop"), (f"s{n + 5}", 1, None), (None, 1, "length")], TURNS))
    got = {r["sample_index"]: r["defect"] for r in response_defects.found(clash(spark.createDataFrame(rows, SAMPLES)), train, turns).collect()}
    want = {i: d for i, (_, _, d) in enumerate(CASES) if d} | {5000: "truncated", n + 1: "truncated", n + 3: "truncated"}
    assert got == want


def test_defects_of_nothing(spark):
    e = [spark.createDataFrame([], s) for s in (SAMPLES, TRAIN, TURNS)]
    assert response_defects.found(*e).count() == 0


def test_cutoffs_are_validated_on_planted_defects():
    assert response_defects.best_cutoff(np.array([0.9, 0.8, 1.0]), np.array([0.1, 0.0])) == pytest.approx(0.1 + 0.05 * 0.7)
    assert response_defects.best_cutoff(np.array([0.9, 0.8, 0.2]), np.array([0.3, 0.3, 0.3])) == pytest.approx(0.3 + 0.05 * 0.5)
    assert response_defects.best_cutoff(np.empty(0), np.array([0.3])) == 0.5
    pairs = [("How heavy is the town clock and what would it take to lift it?", f"First, assume that it holds {i} gears. Each of the gears weighs close to 40 grams. So the answer is about {i * 7}.") for i in range(60)]
    cases = response_defects.planted(pairs, ["en"] * 60)
    texts = response_defects.TextModels()
    models = {d: response_defects.fit(np.array([0]), np.array([1000.0]), f) for d, f in response_defects.FUNCTIONS.items()}
    cutoffs = response_defects.validated_cutoffs(pairs, texts, models)
    for d in ("empty", "refusal", "copy", "truncated"):
        votes = np.array(response_defects.pair_votes([c[0] for c in cases[d]], [c[1] for c in cases[d]], texts)) | np.array([c[2] for c in cases[d]])
        assert (models[d].posterior(response_defects.pattern_of(votes, d)) >= cutoffs[d]).mean() > 0.98


def test_the_label_model_learns_from_the_data():
    functions = (("a", 0.8, 0.01), ("b", 0.8, 0.01))
    agreeing = response_defects.fit(np.array([0, 1, 2, 3]), np.array([900.0, 2.0, 2.0, 96.0]), functions)
    noisy = response_defects.fit(np.array([0, 1, 2, 3]), np.array([700.0, 200.0, 2.0, 98.0]), functions)
    alone = np.array([1])
    assert agreeing.posterior(np.array([3]))[0] > 0.99 and noisy.posterior(np.array([3]))[0] > 0.9
    assert noisy.false[0] > 5 * agreeing.false[0] and noisy.posterior(alone)[0] < 0.5
    assert response_defects.fit(np.array([0]), np.array([0.0]), functions).prior == response_defects.PRIOR


def test_language_model_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    model = response_defects.language_model(response_defects.labelled_texts(docs.where("doc_id % 3 <> 0")))
    rest = [(r["lang"][:2], r["text"]) for r in docs.where("doc_id % 3 = 0 and length(text) > 40 and lang <> 'und'").collect()]
    named = response_defects.TextModels.named(model, [t for _, t in rest])
    assert sum(a == b for (a, _), b in zip(rest, named)) > 0.97 * len(rest)
    assert response_defects.language_model(response_defects.labelled_texts(None)) is None and response_defects.TextModels.named(None, ["x"]) == [None]
    best, margin, letters = model.score(["", "12 34", "x" * 400_000])
    assert best[0] == best[1] == -1 and letters.tolist() == [0, 0, 400_000] and (margin[:2] == 0).all()


def test_a_language_told_by_the_model_alone(spark):
    docs = [("en", "How far does the wagon travel and what does it carry through the old town each day?"), ("de", "Welche Strecke ergeben die schweren Steine, wenn man sie aneinander legt und zählt?")] * 40
    documents = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(docs)], "doc_id long, lang string, text string")
    cases = [("Welche Strecke ergeben schwere Steine?", "How far the wagon does travel: 40 old town days."), ("Welche Strecke ergeben schwere Steine?", "Die schweren Steine ergeben 40 Strecken.")]
    sound = [("Welche Strecke ergeben schwere Steine?", f"Die schweren Steine ergeben {i} Strecken, wenn man sie zählt.") for i in range(200)]
    rows = [(i, f"s{i}", "completed", None, p, r) for i, (p, r) in enumerate(cases + sound)]
    train, turns = spark.createDataFrame([], TRAIN), spark.createDataFrame([], TURNS)
    got = response_defects.found(spark.createDataFrame(rows, SAMPLES), train, turns, documents).collect()
    assert {(r["sample_index"], r["defect"]) for r in got} == {(0, "wrong_language")}


# -- 8 ------------------------------------------------------------------------------------


def test_tokens_round_trip_and_reference_encoder():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokenizer.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    bpe = tokenizer.encoder()
    rng = random.Random(8)
    texts = ["", " ", "\n\n", "a" * 5000, "ab" * 3000, "é漢😀" * 300, "<|endoftext|>", "don't 12,345  x\t\r\n", "\x00​﻿"]
    texts += ["".join(rng.choice("abcé漢😀 \n\t'.19<|>") for _ in range(rng.randrange(80))) for _ in range(200)]
    for x in texts:
        ids = bpe.encode(x)
        assert ids == t.encode(x, add_special_tokens=False).ids
        assert b"".join(bpe.names[i] for i in ids).decode() == x


def test_rank_queue_is_a_priority_queue():
    q, rng = tokenizer.RankQueue(50_256), random.Random(1)
    ranks = [rng.randrange(50_256) for _ in range(3000)]
    for i, r in enumerate(ranks):
        q.push(r, i)
    seen = []
    while (x := q.pop()) is not None:
        seen += [x[0]] * len(x[1])
    assert seen == sorted(ranks)


def test_encoded_table(spark):
    rows = [(1, None, None), (2, "", "s"), (3, "hello world", "s"), (9_007_199_254_740_993, "x" * 30_000, "s"), (None, "a", None)]
    docs = clash(spark.createDataFrame(rows, DOCS))
    got = {r["doc_id"]: r["ids"] for r in tokenizer.encoded(docs).collect()}
    assert got[1] == [] == got[2] and got[3] == [31373, 995] and set(got) == {r[0] for r in rows}
    assert tokenizer.encoded(docs.limit(0)).count() == 0
    assert sum(r["documents"] for r in tokenizer.token_totals(docs.where("doc_id is not null")).collect()) == 4


# -- 9 ------------------------------------------------------------------------------------


def test_mixture(spark):
    rows = [(i, "word " * (10 + i % 7), "big") for i in range(2000)] + [(5000 + i, "tiny text here", "small") for i in range(20)] + [(6000, None, "big"), (6001, "", "big"), (6002, "x", None), (6003, "x", "other")]
    docs = clash(spark.createDataFrame(rows, DOCS))
    targets = clash(spark.createDataFrame([("m", "big", 0.6, 2, 0.5), ("m", "small", 0.3, 4, 0.5), ("m", "absent", 0.1, 3, 0.5), ("o", "big", 1.0, 3, 2.3), ("z", "big", None, 3, 1.0)], "mixture string, source string, target_share double, max_repeats int, size_factor double"))
    out = mixing.mix(docs, targets).collect()
    assert len({(r["mixture"], r["doc_id"], r["copy"]) for r in out}) == len(out)
    assert {r["source"] for r in out} == {"big", "small"} and not {6000, 6001, 6002, 6003} & {r["doc_id"] for r in out}
    assert sum(r["mixture"] == "m" and r["source"] == "small" for r in out) == 80  # all of the cap
    tokens = {k: sum(r["n_tokens"] for r in out if (r["mixture"], r["source"]) == k) for k in (("m", "big"), ("o", "big"))}
    total = sum(r["n_tokens"] for r in tokenizer.token_counts(docs).collect())
    assert tokens["m", "big"] == pytest.approx(0.3 * total, rel=0.1) and tokens["o", "big"] == pytest.approx(2.3 * total, rel=0.05)
    assert max(r["copy"] for r in out if r["mixture"] == "o") == 3
    again = mixing.mix(docs.repartition(7), targets).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    report = {(r["mixture"], r["source"]): r for r in mixing.report(docs, targets).collect()}
    assert len(report) == 5 and report["m", "small"]["capped"] and report["m", "absent"]["share"] == 0
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


# -- 10 -----------------------------------------------------------------------------------


def slow_form(text):
    out = "".join(visual_form._expansion(c) for c in text if ord(c) != visual_form.ZWJ)
    out = unicodedata.normalize("NFC", out)
    for end in ("\r\n", "\r", "\x85", " ", " "):
        out = out.replace(end, "\n")
    return "\n".join(line.rstrip(" \t\v\f") for line in out.split("\n")).rstrip("\n")


def test_forms_against_a_plain_version():
    rng = random.Random(3)
    alphabet = "aȩ̣́̂ͅ \n\r\t각각क़йﬁéṩｶﾞ가．Ａ ​²½ΩxXоО"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(4000)]
    assert visual_form.normalize_array(pa.array(texts, pa.string())).to_pylist() == [slow_form(t) for t in texts]


def test_forms():
    same = [("ｒｅａｃｈ", "reach"), ("é", "é"), ("a​b", "ab"), ("x y", "x y"), ("сор", "cop"), ("ﬂat", "flat"), ("Ω", "Ω"), ("a\r\nb", "a\nb"), ("well‑known", "well-known"), ("x \n", "x")]
    other = [("e", "é"), ("R", "r"), ("m³", "m3"), ("a", "b"), ("1", "l"), ("-", "—"), ("a b", "a  b"), ("👨‍👩", "👨👩"), ("½", "12")]
    form = lambda t: visual_form.normalize_array(pa.array([t], pa.string())).to_pylist()[0]
    assert all(form(a) == form(b) for a, b in same)
    assert all(form(a) != form(b) for a, b in other)


def test_lookalikes(spark):
    rows = [(1, "town clock", "s"), (2, "tоwn clock", "s"), (3, "town​ clock", None), (4, "town clock", "s"), (5, None, "s"), (6, "", "s"), (7, "​", "s"), (8, " ", "s"), (9, "Town clock", "s"), (10, "x" * 700_000, "s"), (11, "x" * 700_000 + "⁠", "s")]
    docs = clash(spark.createDataFrame(rows, DOCS))
    assert pairs(visual_form.lookalikes(docs)) == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (10, 11)}
    assert visual_form.lookalikes(docs.limit(0)).count() == 0
    assert {r["doc_id"]: r["documents"] for r in visual_form.classes(docs).collect()}[1] == 4
