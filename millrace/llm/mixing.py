"""Mixing sources to target weights (problem 9).

Method: tokens are aggregated per source, a source's repetition rate is its target tokens over its
tokens, at most ``max_repeats``, and each document is emitted floor(rate) times plus one copy drawn by
a seeded hash of its id with the probability of the fraction. A document is decided by itself: no
shuffle beyond the totals per source, and the same result at any partitioning.

Defined cases: a source that is capped, tiny or absent reaches less than its share, which the report
shows; a document with a null or unlisted source or without tokens is not emitted (it adds nothing);
a null share or size factor wants no tokens, a null number of repeats allows no copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokenizer import token_counts
from millrace.runtime import bounded_rows, stored

SEED = 20_250_301
#: Rows of the targets table and distinct sources, both tables of settings.
MAX_TARGETS = 100_000


def rates(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(mixture, source, target_share, max_repeats, wanted, tokens, rate) for each line of the targets."""
    total = F.sum("n_tokens")
    per_source = counts.groupBy("source").agg(total.alias("tokens"), F.count("*").alias("documents"))
    all_tokens = counts.agg(F.coalesce(total, F.lit(0)).alias("n")).first()["n"]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)  # noqa: E731  (the least of a value and a null is the value)
    lines = targets.select("mixture", "source", *map(zero, ("target_share", "max_repeats", "size_factor")))
    lines = lines.join(per_source, "source", "left")
    wanted = F.col("target_share") * F.col("size_factor") * F.lit(all_tokens)
    rate = F.when(F.col("tokens") > 0, F.least(wanted / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return lines.select("mixture", "source", "target_share", "max_repeats", wanted.alias("wanted"), F.coalesce("tokens", F.lit(0)).alias("tokens"), rate.alias("rate"))


def emitted(counts: DataFrame, rated: DataFrame, seed: int = SEED) -> DataFrame:
    """(mixture, doc_id, copy, source, n_tokens): one row per copy of a document in a mixture."""
    lines = bounded_rows(rated.where("rate > 0"), MAX_TARGETS, "targets")
    if not lines:
        return counts.sparkSession.createDataFrame([], "mixture string, doc_id long, copy int, source string, n_tokens long")
    by_source: dict[str, list] = {}
    for r in lines:
        by_source.setdefault(r["source"], []).append((r["mixture"], float(r["rate"])))
    settings = counts.sparkSession.createDataFrame(list(by_source.items()), "source string, uses array<struct<mixture: string, rate: double>>")
    # at most MAX_TARGETS rows, checked above
    used = counts.where("n_tokens > 0").join(F.broadcast(settings), "source").withColumn("u", F.explode("uses"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "u.mixture", "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    copies = (F.floor("u.rate") + (draw < F.col("u.rate") - F.floor("u.rate")).cast("long")).cast("int")
    out = used.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("u.mixture", "doc_id", "copy", "source", "n_tokens")


def mix(documents: DataFrame, targets: DataFrame) -> DataFrame:
    counts = stored(token_counts(documents), "token-counts")
    return emitted(counts, rates(counts, targets))


def report(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(mixture, source, target_share, share, tokens, wanted, documents, most_copies, rate, capped)."""
    counts = stored(token_counts(documents), "token-counts")
    rated = rates(counts, targets).drop("tokens")
    used = emitted(counts, rates(counts, targets))
    per = used.groupBy("mixture", "source", "doc_id").agg(F.count("*").alias("copies"), F.sum("n_tokens").alias("tokens"))
    per = per.groupBy("mixture", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    sums = per.groupBy("mixture").agg(F.sum("tokens").alias("mixture_tokens"))
    out = rated.join(per, ["mixture", "source"], "left").join(sums, "mixture", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    share = F.round(F.coalesce(F.col("tokens") / F.col("mixture_tokens"), F.lit(0.0)), 6)
    return out.select("mixture", "source", "target_share", share.alias("share"), zero("tokens").alias("tokens"), F.round("wanted").cast("long").alias("wanted"), zero("documents").alias("documents"), zero("most_copies").alias("most_copies"), F.round("rate", 6).alias("rate"), (F.col("rate") >= F.col("max_repeats")).alias("capped"))
