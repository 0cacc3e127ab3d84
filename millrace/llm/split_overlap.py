"""Same or near-same records across splits (problem 5).

Two questions are near the same if at most a fifth of the words of the longer must be inserted,
deleted or replaced. Method: every question gets a similarity-hash fingerprint, one bit for each word
with its occurrence number; code blocks of segments of the fingerprint are joined across splits; pairs
outside the Hamming radius (one edit changes at most two bits; a fold of the fingerprint to ``SKETCH``
parity bits tells) are dropped; the rest is verified by word edit distance.

Segments of a few bits would join far too many pairs at a radius of a fifth of 40 words, see the
README. The fingerprint is therefore sparse and wide (64-bit positions), cut into g segments, and a block is the
code of two set bits of one segment. With d edits allowed, near pairs share at least g + 1 of the first
d + g + 1 bits of either side in an order of rarity, hence two of them in one segment: no near pair is
lost. g grows with the length, so that the blocks of a text grow in proportion to it. A text whose
partner may have another g gives blocks for both. Rarity comes from a count of all rows, in a
sketch of ``BUCKETS`` counters (bounded size). Partitions of blocks that many rows share are split by
adaptive skew handling of the sort-merge join.

Questions of equal words form one class, known by 128 bits; classes are compared once, rows are attached
at the end.
Defined cases: null questions and questions without a word are no cases; very long texts are compared
whole; a null split takes no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import cut

WORD = re.compile(r"[^\W_]+")
#: The same runs for the JVM.
JVM_WORD = r"[\p{L}\p{N}]+"
BUCKETS = 1 << 16
#: Bits of the folded fingerprint, kept as two longs.
SKETCH = 128
TENTH = 2  # edits allowed, in tenths of the longer text's words
#: Texts of fewer words have one segment; from here on the segments are 3, four times as many from each four times as many words on.
SEGMENTED = 30
#: Words coded at once; bounds the memory of a task.
WORDS = 500_000


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, case disregarded."""
    return WORD.findall(text.lower())


def allowed_edits(n):  # of a number or an array of them
    return TENTH * n // 10


def within(a: list[int], b: list[int], most: int) -> bool:
    """Whether the edit distance of two sequences is at most ``most`` (only the band that matters is filled)."""
    if a == b:
        return True
    k, top = 0, min(len(a), len(b))  # equal ends don't change the distance
    while k < top and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    k, top = 0, min(len(a), len(b))
    while k < top and a[-1 - k] == b[-1 - k]:
        k += 1
    if k:
        a, b = a[:-k], b[:-k]
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    if not n or not m:
        return max(n, m) <= most
    far = most + 1
    before = {j: j for j in range(0, min(m, most) + 1)}
    for i in range(1, n + 1):
        now = {}
        x = a[i - 1]
        for j in range(max(0, i - most), min(m, i + most) + 1):
            if j == 0:
                now[j] = i
                continue
            d = before.get(j - 1, far) + (x != b[j - 1])
            d = min(d, before.get(j, far) + 1, now.get(j - 1, far) + 1)
            now[j] = d
        if min(now.values()) > most:
            return False
        before = now
    return before.get(m, far) <= most


def question_classes(problems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (c1, c2, problem_id, side) and classes (c1, c2, words, lo, hi) of equal word sequences."""
    rows = problems.where("question is not null and problem_id is not null").where(F.lower("split").isin("train", "val", "test"))
    rows = rows.where(F.col("question").rlike(JVM_WORD))
    words = F.transform(F.regexp_extract_all(F.lower("question"), F.lit(JVM_WORD), F.lit(0)), lambda w: F.xxhash64(w))
    worded = rows.select("problem_id", F.when(F.lower("split") == "train", 0).otherwise(1).alias("side"), words.alias("words"))
    # two hashes of the sequence: classes are apart unless 128 bits collide
    worded = cut(worded.withColumn("c1", F.xxhash64("words")).withColumn("c2", F.xxhash64(F.reverse("words"), F.lit(1))))
    members = worded.select("c1", "c2", "problem_id", "side")
    # the words are a function of the class, so any row's will do; sides are combined map-side
    classes = worded.groupBy("c1", "c2").agg(F.first("words").alias("words"), F.min("side").alias("lo"), F.max("side").alias("hi"))
    return members, cut(classes)


def rarity(classes: DataFrame) -> np.ndarray:
    """Counts of all words of all classes in ``BUCKETS`` counters (a bounded result)."""
    counted = classes.select(F.explode("words").alias("w")).groupBy(F.pmod("w", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in counted.collect():
        out[r["bucket"]] = r["n"]
    return out


def coded(classes: DataFrame, counts: np.ndarray) -> DataFrame:
    """(c1, c2, lo, hi, n, f0, f1, blocks): folded fingerprint and code blocks of each class."""
    shared = classes.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in _runs(batch)):
            words = b.column("words")
            n = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            sketch, blocks, sizes = fingerprints(words.flatten().to_numpy(zero_copy_only=False), n, shared.value)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            columns = [b.column(c) for c in ("c1", "c2", "lo", "hi")] + [pa.array(n, pa.int32()), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), pa.ListArray.from_arrays(ends, pa.array(blocks))]
            yield pa.RecordBatch.from_arrays(columns, ["c1", "c2", "lo", "hi", "n", "f0", "f1", "blocks"])

    return classes.select("c1", "c2", "lo", "hi", "words").mapInArrow(run, "c1 long, c2 long, lo int, hi int, n int, f0 long, f1 long, blocks array<long>")


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``WORDS`` words, or of one longer text."""
    group = np.cumsum(batch.column("words").value_lengths().to_numpy(zero_copy_only=False)) // WORDS
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(bounds[:-1], bounds[1:]) if b > a)


def segments(longest: np.ndarray) -> np.ndarray:
    """Segments of the fingerprints of a pair whose longer text has so many words."""
    quarters = np.floor(np.log2(np.maximum(longest, SEGMENTED) / SEGMENTED) / 2)
    return np.where(longest < SEGMENTED, 1, 3 * 4 ** quarters.astype(np.int64))


def fingerprints(words: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded fingerprints (rows x 2), block codes and their number per row, of a batch of rows of word hashes."""
    rows = len(sizes)
    row = np.repeat(np.arange(rows), sizes)
    order = np.lexsort((words, row))
    row, s = row[order], words[order]
    index = np.arange(len(s))
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    nth = (index - np.maximum.accumulate(np.where(first, index, 0))).astype(np.uint64)
    with np.errstate(over="ignore"):  # each occurrence of a word is a bit of its own
        bit = (s.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (nth + np.uint64(1))) * np.uint64(0xBF58476D1CE4E5B9)
    bit ^= bit >> np.uint64(29)
    parity = np.bincount(row * SKETCH + (bit % np.uint64(SKETCH)).astype(np.int64), minlength=rows * SKETCH) & 1
    sketch = np.packbits(parity.astype(np.uint8).reshape(rows, SKETCH), axis=1).view(np.int64).reshape(rows, 2)
    rank = counts[s % BUCKETS] // (nth.astype(np.int64) + 1)
    order = np.lexsort((bit, rank, row))
    bit = bit[order]  # by row, then from the rarest on; the sort kept the rows where they were
    starts = np.cumsum(sizes) - sizes
    place = index - np.repeat(starts, sizes)
    edits = allowed_edits(sizes)
    own = segments(sizes)
    other = segments(10 * sizes // (10 - TENTH))
    codes, owners = [], []
    for g, part in ((own, sizes >= 4), (other, (sizes >= 4) & (other != own))):  # below 4 words near pairs are equal
        keep = np.repeat(part, sizes) & (place < np.repeat(edits + g + 1, sizes))
        r, x = row[keep], bit[keep]
        of = g[r]
        segment = (x >> np.uint64(24)) % of.astype(np.uint64)
        order = np.lexsort((x, segment, r))
        r, x, segment, of = r[order], x[order], segment[order], of[order]
        if not len(r):
            continue
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (segment[1:] != segment[:-1])
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(r)))
        later = np.repeat(at + length, length) - np.arange(len(r)) - 1  # bits of the segment after each
        i = np.repeat(np.arange(len(r)), later)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
        with np.errstate(over="ignore"):
            code = (x[i] * np.uint64(0x94D049BB133111EB) ^ (x[j] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)) + of[i].astype(np.uint64)
        codes.append(code.view(np.int64))
        owners.append(r[i])
    if not codes:
        return sketch, np.empty(0, np.int64), np.zeros(rows, np.int64)
    code, owner = np.concatenate(codes), np.concatenate(owners)
    code = code[np.argsort(owner, kind="stable")]
    return sketch, code, np.bincount(owner, minlength=rows)


def near_classes(classes: DataFrame) -> DataFrame:
    """(a1, a2, b1, b2): different classes, the first with train rows and the second with others, whose words are near the same."""
    codes = cut(coded(classes, rarity(classes)))

    def blocks(side: str, x: str) -> DataFrame:
        named = {"c1": f"{x}1", "c2": f"{x}2", "n": f"n{x}", "f0": f"{x}f0", "f1": f"{x}f1"}
        return codes.where(side).select(F.explode("blocks").alias("block"), *[F.col(c).alias(to) for c, to in named.items()])

    edits = F.floor(F.greatest("na", "nb") * TENTH / 10)
    distance = F.bit_count(F.col("af0").bitwiseXOR(F.col("bf0"))) + F.bit_count(F.col("af1").bitwiseXOR(F.col("bf1")))
    near = (F.abs(F.col("na") - F.col("nb")) <= edits) & (distance <= 2 * edits) & ~((F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")))
    candidates = blocks("lo = 0", "a").join(blocks("hi = 1", "b"), "block").where(near).select("a1", "a2", "b1", "b2").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            good = [within(x.tolist(), y.tolist(), allowed_edits(max(len(x), len(y)))) for x, y in zip(p["wa"], p["wb"])]
            yield p.loc[good, ["a1", "a2", "b1", "b2"]]

    for x in "ab":
        candidates = candidates.join(classes.select(F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2"), F.col("words").alias(f"w{x}")), [f"{x}1", f"{x}2"])
    return candidates.select("a1", "a2", "b1", "b2", "wa", "wb").mapInPandas(verify, "a1 long, a2 long, b1 long, b2 long")


def overlaps(problems: DataFrame) -> DataFrame:
    """(train_id, eval_id, exact): all pairs across train and the other splits that are the same or nearly."""
    members, classes = question_classes(problems)
    same = classes.where("lo = 0 and hi = 1").select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.lit(True).alias("exact"))
    links = cut(near_classes(classes).withColumn("exact", F.lit(False)).unionByName(same))
    train = members.where("side = 0").select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("problem_id").alias("train_id"))
    other = members.where("side = 1").select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("problem_id").alias("eval_id"))
    return links.join(train, ["a1", "a2"]).join(other, ["b1", "b2"]).select("train_id", "eval_id", "exact")


def classes_with_links(problems: DataFrame) -> DataFrame:
    """(problem_id, class_id, same, links): each question with the class of equal ones, whether that stands on both sides, and how many classes of the other side are near it.

    Needs no expansion of copies or pairs of rows.
    """
    members, classes = question_classes(problems)
    near = cut(near_classes(classes))
    ends = near.select(F.col("a1").alias("c1"), F.col("a2").alias("c2"), F.lit(0).alias("side")).unionByName(near.select(F.col("b1").alias("c1"), F.col("b2").alias("c2"), F.lit(1).alias("side")))
    counts = ends.groupBy("c1", "c2", "side").agg(F.count("*").alias("links"))
    both = classes.select("c1", "c2", (F.col("lo") != F.col("hi")).alias("same"))
    rows = members.join(both, ["c1", "c2"]).join(counts, ["c1", "c2", "side"], "left")
    return rows.select("problem_id", F.format_string("%016x%016x", "c1", "c2").alias("class_id"), "same", F.coalesce("links", F.lit(0)).alias("links"))


def found(problems: DataFrame) -> DataFrame:
    """(id_a, id_b), the smaller id first."""
    pairs = overlaps(problems)
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def report(problems: DataFrame) -> DataFrame:
    """(split, source, questions, overlapping, same, near): per split and source, how many questions stand in train too.

    ``same`` counts questions with an equal one in train, ``near`` those with only near ones. Needs no
    expansion of copies: a question overlaps if its class has a link.
    """
    members, classes = question_classes(problems)
    exact = classes.where("lo = 0 and hi = 1").select("c1", "c2", F.lit(2).alias("kind"))
    near = near_classes(classes).select(F.col("b1").alias("c1"), F.col("b2").alias("c2"), F.lit(1).alias("kind"))
    kinds = exact.unionByName(near).groupBy("c1", "c2").agg(F.max("kind").alias("kind"))
    named = problems.select("problem_id", "split", F.trim(F.get(F.split("problem_source", r"\|", -1), F.lit(1))).alias("source"))
    rows = members.where("side = 1").join(kinds, ["c1", "c2"], "left").select("problem_id", F.coalesce("kind", F.lit(0)).alias("kind"))
    rows = rows.join(named, "problem_id")
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return rows.groupBy("split", "source").agg(F.count("*").alias("questions"), count(F.col("kind") > 0).alias("overlapping"), count(F.col("kind") == 2).alias("same"), count(F.col("kind") == 1).alias("near"))
