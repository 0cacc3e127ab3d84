"""Duplicates hidden by formatting differences (problem 4).

Method: question and answer are canonicalized JVM-side (letter case, white space and punctuation go,
a decimal point between digits and a minus sign before a digit stay), the field order of payloads goes
by reading the fields by name, the pair is hashed to 128 bits, and counts are aggregated with map-side
combining. A second, independent 64-bit hash is part of the grouping key, so that texts which collide
in the first are told apart; ``collisions`` counts them.

Defined cases: a payload that is null, broken or no object is no record; a record with a null question
or a null answer is no record; empty or punctuation-only fields are equal to each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import cut

# Stand-ins, from the private use area, for the two signs that count.
POINT, MINUS = "\ue000", "\ue001"


def canonical(text: F.Column) -> F.Column:
    """Text without letter case, white space, punctuation (Unicode P) and invisible format characters."""
    folded = F.replace(F.translate(F.lower(F.upper(text)), "ς", "σ"), F.lit("ß"), F.lit("ss"))
    signs = F.regexp_replace(F.regexp_replace(folded, r"(?<=\p{Nd})\.(?=\p{Nd})", POINT), r"[-−](?=\p{Nd})", MINUS)
    return F.translate(F.regexp_replace(signs, r"[\p{P}\p{IsWhite_Space}\p{Cf}\x1c-\x1f]+", ""), POINT + MINUS, ".-")


def records(problems: DataFrame, raw_records: DataFrame) -> DataFrame:
    """(tbl, id, question, answer_value) of both tables."""
    own = problems.select(F.lit("problems").alias("tbl"), F.col("problem_id").alias("id"), "question", "answer_value")
    parsed = raw_records.select(F.col("raw_id").alias("id"), F.try_parse_json("payload").alias("o"))
    fields = [F.try_variant_get("o", f"$.{f}", "string").alias(f) for f in ("question", "answer_value")]
    return own.unionByName(parsed.select(F.lit("raw_records").alias("tbl"), "id", *fields))


def hashed(rows: DataFrame) -> DataFrame:
    """(tbl, id, h1, h2, check): the 128 bits as two longs, and the independent check."""
    kept = rows.where("id is not null and question is not null and answer_value is not null")
    form = F.concat(canonical(F.col("question")), F.lit("\u0000"), canonical(F.col("answer_value")))
    kept = kept.select("tbl", "id", form.alias("form"))
    digest = F.md5(F.col("form").cast("binary"))
    half = [F.conv(F.substring(digest, p, 16), 16, -10).cast("long").alias(n) for p, n in ((1, "h1"), (17, "h2"))]
    return kept.select("tbl", "id", *half, F.xxhash64("form").alias("check"))


def groups(hashes: DataFrame) -> DataFrame:
    """(tbl, h1, h2, check, first_id, copies): one record each with the number of its copies."""
    return hashes.groupBy("tbl", "h1", "h2", "check").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))


def collisions(found: DataFrame) -> DataFrame:
    """Groups whose 128 bits are equal while the check differs (expected: none)."""
    return found.groupBy("tbl", "h1", "h2").agg(F.count("*").alias("texts")).where("texts > 1")


def collided(problems: DataFrame, raw_records: DataFrame) -> DataFrame:
    """``collisions`` of both tables."""
    return collisions(groups(hashed(records(problems, raw_records))))


def deduplicated(problems: DataFrame, raw_records: DataFrame) -> DataFrame:
    """(tbl, id, copies): the record kept of each group (smallest id) and how many copies it stands for."""
    return groups(hashed(records(problems, raw_records))).select("tbl", F.col("first_id").alias("id"), "copies")


def copies(problems: DataFrame, raw_records: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b): each further copy with the smallest id of its group."""
    hashes = cut(hashed(records(problems, raw_records)))
    several = groups(hashes).where("copies > 1").drop("copies")
    pairs = hashes.join(several, ["tbl", "h1", "h2", "check"]).where("id > first_id")
    return pairs.select("tbl", F.col("first_id").alias("id_a"), F.col("id").alias("id_b")).distinct()
