"""Span trees of any depth, and spans without a sample."""

from millrace.operators import intervals

SPANS = "sample_index long, span_id string, parent_span_id string, start_ts double, end_ts double, state string"


def test_deep_trees_cycles_and_no_sample(spark):
    deep = [(1, f"s{i}", f"s{i - 1}" if i else None, float(i), 150.0 if i == 0 else None, "closed" if i == 0 else "open") for i in range(101)]
    rows = deep + [(1, "late", None, 200.0, 300.0, "closed"), (2, "a", "b", 1.0, 2.0, "closed"), (2, "b", "a", 1.0, 2.0, "closed")]
    rows += [(None, "n1", "s0", 5.0, None, "open"), (None, "n2", None, 5.0, 7.0, "closed"), (None, "n3", None, None, 8.0, "orphan")]
    got = {r["span_id"]: (r["sample_index"], r["depth"], r["shown_end"]) for r in intervals.clipped_tree(spark.createDataFrame(rows, SPANS)).collect()}
    assert all(got[f"s{i}"] == (1, i, 150.0) for i in range(101))
    assert got["a"][1] == got["b"][1] == 1
    assert (got["n1"], got["n2"], got["n3"]) == ((None, 0, 5.0), (None, 0, 7.0), (None, 0, 8.0))
