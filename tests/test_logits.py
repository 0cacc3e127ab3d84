"""Entropy over whole vectors."""

import math

import __spark_entry__ as entry


def test_entropy_of_all_components(spark, tmp_path):
    spark.createDataFrame([(1, [0.0] * 64), (2, [0.0] * 8 + [9.0] + [0.0] * 55)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r["entropy"] for r in entry.queries()["g16_small_vocabulary_entropy"](spark, str(tmp_path)).collect()}
    z = math.log(63 + math.exp(9))
    assert got == {1: round(math.log(64), 5), 2: round(63 * math.exp(-z) * z + math.exp(9 - z) * (z - 9), 5)}
