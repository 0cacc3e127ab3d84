"""Retrieval: exact top-k of a stated query set against all rows, dense and BM25, in one pass over the rows per block of queries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from millrace.runtime import stored

#: Queries, and weights of their terms, held by a task at once; a larger set is served in several passes.
QUERY_BLOCK, WEIGHT_BLOCK = 4096, 1_000_000
#: Cells of a matrix of scores; bounds the memory of a batch.
SCORES = 4_000_000

FOUND = "query_id long, id long, score double"


class TopK:
    """The k best rows of each query seen so far; ties go to the smaller id. A score of ``least`` or below is none."""

    def __init__(self, queries: int, k: int, least: float = -np.inf):
        self.k, self.least = k, least
        self.query, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.bar = np.full(queries, -np.inf)  # the k-th best score of each query

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` is queries x rows."""
        k = min(self.k, scores.shape[1])
        own = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        q, r = np.nonzero((scores >= np.maximum(own, self.bar)[:, None]) & (scores > self.least))
        query, found = np.concatenate([self.query, q]), np.concatenate([self.ids, ids[r]])
        value = np.concatenate([self.scores, scores[q, r]])
        order = np.lexsort((found, -value, query))
        query, found, value = query[order], found[order], value[order]
        first = np.searchsorted(query, query)
        place = np.arange(len(query)) - first
        last = place == self.k - 1
        self.bar[query[last]] = value[last]
        keep = place < self.k
        self.query, self.ids, self.scores = query[keep], found[keep], value[keep]

    def frame(self, query_ids: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"query_id": query_ids[self.query], "id": self.ids, "score": self.scores})


def _blocks(rows: Iterable[Row], size: int) -> Iterator[list[Row]]:
    rows = iter(rows)
    while block := list(islice(rows, size)):
        yield block


def _best(found: list[DataFrame], k: int) -> DataFrame:
    """The best k of what the tasks found, at most k rows per query and task."""
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_top_k(corpus: DataFrame, queries: DataFrame, k: int, normalize: bool = True) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of the whole corpus for each query, by inner product.

    The stated query set comes through the driver in blocks of ``QUERY_BLOCK`` and goes to the tasks; each task keeps k
    rows per query over all its batches, so that no pairs are shuffled. Ties go to the smaller id. Null vectors are
    no candidates; a vector of norm 0 scores 0.
    """
    spark = corpus.sparkSession
    out = []
    for rows in _blocks(queries.where("embedding is not null").select("vec_id", "embedding").toLocalIterator(), QUERY_BLOCK):
        qid = np.array([r["vec_id"] for r in rows], np.int64)
        q = np.array([r["embedding"] for r in rows], np.float64)
        if normalize:
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast((qid, q))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, vectors = shared.value
            best = TopK(len(ids), k)
            step = max(1, SCORES // len(ids))
            for b in batches:
                for at in range(0, len(b), step):
                    c = b.iloc[at : at + step]
                    x = np.stack([np.asarray(v, np.float64) for v in c["embedding"]])
                    if normalize:
                        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    # rounded, so that equal vectors tie whatever batch they come in
                    best.add(c["vec_id"].to_numpy(np.int64), np.round(vectors @ x.T, 9))
            yield best.frame(ids)

        out.append(corpus.where("embedding is not null").select("vec_id", "embedding").mapInPandas(run, FOUND))
    if not out:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    return _best(out, k).withColumnRenamed("id", "vec_id")


#: Scripts written without spaces between words, and runs of them.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
_TERM = rf"[{_UNSPACED}]+|[\p{{L}}\p{{N}}\p{{M}}&&[^{_UNSPACED}]]+"


def terms(text: F.Column) -> F.Column:
    """Words of letters, marks and digits of any script, in lower case; a run without spaces between words gives its pairs of neighbours, a single sign itself."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda t: F.when(t.rlike(f"^[{_UNSPACED}]") & (F.length(t) > 1), pairs(t)).otherwise(F.array(t))))


def hashed_terms(text: F.Column) -> F.Column:
    """``terms`` as 64-bit hashes."""
    return F.transform(terms(text), lambda t: F.xxhash64(t))


def bm25_top_k(documents: DataFrame, queries: DataFrame, k: int, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """(query_id, doc_id, score, rank): BM25 over ``documents`` (doc_id, text) for ``queries`` (query_id, text).

    Terms are known by 64-bit hashes. Document frequencies are counted over all documents with map-side combining;
    lengths and counts cover all documents with a word. The weights of the queries' terms come through the driver in
    blocks of at most ``WEIGHT_BLOCK`` and about ``QUERY_BLOCK`` queries; each task scores its documents against a
    block and keeps k per query, so that postings of frequent words are never joined or shuffled. Null and wordless
    texts match nothing; ties go to the smaller id.
    """
    spark = documents.sparkSession
    worded = stored(documents.where("text is not null").select("doc_id", hashed_terms(F.col("text")).alias("w")), "worded").where("size(w) > 0")
    stats = worded.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean")).first()
    wanted = queries.where("text is not null").select("query_id", F.explode(hashed_terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    df = worded.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = wanted.join(df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight")).sort("query_id", "term")
    out = []
    for block in _query_blocks(weights.toLocalIterator()):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared, mean=stats["mean"]) -> Iterator[pd.DataFrame]:
            ids, vocabulary, first, query, weight = shared.value
            best = TopK(len(ids), k, 0.0)
            step = max(1, SCORES // len(ids))
            for c in batches:
                for at in range(0, len(c), step):
                    part = c.iloc[at : at + step]
                    size = np.array([len(w) for w in part["w"]])
                    row = np.repeat(np.arange(len(part)), size)
                    words = np.concatenate(part["w"].to_list())
                    place = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                    known = vocabulary[place] == words
                    key, tf = np.unique(row[known] * len(vocabulary) + place[known], return_counts=True)
                    row, place = key // len(vocabulary), key % len(vocabulary)
                    share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / mean))
                    scores = np.zeros(len(ids) * len(part))
                    uses = first[place + 1] - first[place]  # queries with the word
                    for lo, hi in _runs(uses, SCORES):
                        n, r, s = uses[lo:hi], row[lo:hi], share[lo:hi]
                        use = np.repeat(first[place[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                        scores += np.bincount(query[use] * len(part) + np.repeat(r, n), weights=weight[use] * np.repeat(s, n), minlength=len(scores))
                    # rounded, so that ties don't depend on the order of the sum
                    best.add(part["doc_id"].to_numpy(np.int64), np.round(scores.reshape(len(ids), len(part)), 9))
            yield best.frame(ids)

        out.append(worded.mapInPandas(run, FOUND))
    if not out:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    return _best(out, k).withColumnRenamed("id", "doc_id")


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs whose sizes add up to about ``most``."""
    group = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    ends = [0, *cuts.tolist(), len(sizes)]
    return zip(ends[:-1], ends[1:])


def _query_blocks(rows: Iterable[Row]) -> Iterator[tuple]:
    """(query ids, sorted vocabulary, first weight of each word, query and weight) of blocks of rows that come by query."""
    held: list[Row] = []
    queries = 0
    for r in rows:
        new = not held or held[-1]["query_id"] != r["query_id"]
        if new and held and (queries >= QUERY_BLOCK or len(held) >= WEIGHT_BLOCK):
            yield _indexed(held)
            held, queries = [], 0
        queries += new
        held.append(r)
    if held:
        yield _indexed(held)


def _indexed(rows: list[Row]) -> tuple:
    ids, query = np.unique(np.array([r["query_id"] for r in rows], np.int64), return_inverse=True)
    vocabulary, word = np.unique(np.array([r["term"] for r in rows], np.int64), return_inverse=True)
    order = np.argsort(word, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(vocabulary)))])
    return ids, vocabulary, first, query[order], np.array([r["weight"] for r in rows])[order]
