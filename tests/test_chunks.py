"""Chunks over cuts of a run equal the sequential walk."""

import random

from millrace.operators import packing
from millrace.plans import more


def test_carry_equals_the_walk():
    rng = random.Random(5)
    for _ in range(2000):
        most, parts = rng.choice([1, 7, 20]), [[rng.choice([0, 0, 1, 3, rng.randrange(30)]) for _ in range(rng.randrange(1, 9))] for _ in range(4)]
        chunk = total = 0
        got = []
        for p in parts:
            got += packing.size_chunks(p, most, chunk, total)
            chunk, total = packing.carried(packing.chunk_carry(p, most), sum(p), most, chunk, total)
        assert got == packing.size_chunks(sum(parts, []), most), (most, parts)


def test_runs_beyond_a_cut(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), i, rng.choice([0, 400, 9_000, 30_000])) for i in rng.sample(range(250_000), 60)] + [("c", None, 5)]
    got = {(r["run_id"], r["doc_id"]): r["chunk"] for r in more.run_chunks(spark.createDataFrame(rows, "run_id string, doc_id long, n_chars long"), 20_000, 100_000).collect()}
    want = {}
    for run in "abc":
        own = sorted((r for r in rows if r[0] == run), key=lambda r: (r[1] is None, r[1]))
        want |= {(run, r[1]): c for r, c in zip(own, packing.size_chunks([r[2] for r in own], 20_000))}
    assert got == want
