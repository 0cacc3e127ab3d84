"""A later job goes on from the table of an earlier one."""

from millrace.llm import related_splits

NODES = "record_id long, node_a long, node_b long"


def test_second_instance_keeps_splits_and_quarantines(spark, tmp_path):
    path = f"{tmp_path}/components"
    open_ = lambda: related_splits.ComponentTable(spark, [("x", 0.5), ("y", 0.5)], path)
    first = {r["record_id"]: r["split"] for r in open_().add(spark.createDataFrame([(1, 10, None), (2, 20, None)], NODES)).collect()}
    (tmp_path / "components" / "v000000002").mkdir()  # broken off: no _SUCCESS
    store = open_()
    assert store.version == 1 and store.table.count() == 2
    later = {r["record_id"]: r["split"] for r in store.add(spark.createDataFrame([(3, 10, None), (4, 20, None), (5, 30, None)], NODES)).collect()}
    assert (later[3], later[4]) == (first[1], first[2]) and sorted(first.values()) == ["x", "y"]
    merged = open_().add(spark.createDataFrame([(6, 10, 20)], NODES)).collect()
    assert [r["split"] for r in merged] == [related_splits.QUARANTINE] and open_().version == 3
