"""BM25 over words of any script."""

import math
import re
from collections import Counter

from millrace.operators import retrieval

DOCS = [(1, "Мост через реку"), (2, "eine Brücke für Züge"), (3, "这座桥有多长"), (4, "a bridge of 12 tons"), (5, None), (6, "—"), (7, "Brucke fur 桥")]


def words(text):
    out = []
    for run in re.findall(r"[一-鿿]+|[^\W_一-鿿]+", text.lower()):
        out += [run[i : i + 2] for i in range(len(run) - 1)] if "一" <= run[0] <= "鿿" and len(run) > 1 else [run]
    return out


def test_bm25_against_brute_force(spark):
    queries = [(1, "мост, Мост"), (2, "Brücke?"), (3, "桥有多"), (4, "桥"), (5, "bridge")]
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    out = retrieval.bm25_top_k(docs, spark.createDataFrame(queries, "query_id long, text string"), 5)
    got = {(r["query_id"], r["doc_id"]): round(r["score"], 6) for r in out.collect()}
    bags = {i: Counter(words(t)) for i, t in DOCS if t and words(t)}
    mean = sum(b.total() for b in bags.values()) / len(bags)
    want = {}
    for q, text in queries:
        for i, bag in bags.items():
            for w, n in Counter(words(text)).items():
                if tf := bag[w]:
                    df = sum(w in b for b in bags.values())
                    want[q, i] = want.get((q, i), 0) + n * math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * bag.total() / mean))
    assert got == {k: round(v, 6) for k, v in want.items()} and set(got) == {(1, 1), (2, 2), (3, 3), (4, 7), (5, 4)}
