"""Spans and intervals: unions, gaps, overlap joins, span reconstruction.

Windows partition by a stream key (an engine, a rank, a sample). Where one key may hold a large part of
all rows, ``merged_ranged`` cuts keys by time, so that no task gets a whole key.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.grouped import map_groups
from millrace.runtime import bounded_broadcast, cut


def merged(df: DataFrame, keys: Iterable[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end) of the union of closed intervals: a new island begins where start exceeds all ends before."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(f"{start} is not null and {end} is not null and {end} >= {start}").withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def merged_ranged(df: DataFrame, keys: Iterable[str], start: str = "start", end: str = "end") -> DataFrame:
    """``merged`` without one task for all rows of a key.

    Rows are range-partitioned by keys and start. How far the partitions before a row's own reach is carried as one row
    a key and partition (a prefix maximum), and an island that is open where a partition begins is attached to
    the last one that began before it.
    """
    keys = list(keys)
    valid = df.where(f"{start} is not null and {end} is not null and {end} >= {start}").select(*keys, start, end)
    ranged = cut(valid.repartitionByRange(*keys, start).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    reach = ranged.groupBy(*keys, "_part").agg(F.max(end).alias("_most"))
    reach = reach.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.max("_most").over(earlier).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = Window.partitionBy(*keys, "_part").orderBy(start, end)
    before = F.greatest(F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    marked = ranged.join(bounded_broadcast(reach), same).withColumn("_new", F.coalesce((F.col(start) > before).cast("int"), F.lit(1)))
    marked = marked.withColumn("_island", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    parts = cut(marked.groupBy(*keys, "_part", "_island").agg(F.min(start).alias(start), F.max(end).alias(end)))
    # a row a key and partition with an open island or one that began there
    edges = parts.groupBy(*keys, "_part").agg(F.max(F.when(F.col("_island") > 0, F.col("_island"))).alias("_last"), F.max(F.when(F.col("_island") == 0, F.struct(start, end))).alias("_open"))
    began = F.when(F.col("_last").isNotNull(), F.struct("_part", F.col("_last").alias("_island")))
    edges = edges.withColumn("_of", F.last(began, True).over(earlier)).where("_open is not null")
    attached = edges.select(*keys, F.col("_of._part").alias("_part"), F.col("_of._island").alias("_island"), F.col(f"_open.{start}").alias(start), F.col(f"_open.{end}").alias(end))
    whole = parts.where("_island > 0").unionByName(attached)
    return whole.groupBy(*keys, "_part", "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_part", "_island")


def gaps(islands: DataFrame, keys: Iterable[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, gap_start, gap_end, length) between neighbouring islands."""
    w = Window.partitionBy(*keys).orderBy(start)
    out = islands.select(*keys, F.col(end).alias("gap_start"), F.lead(start).over(w).alias("gap_end"))
    return out.where("gap_end is not null").withColumn("length", F.col("gap_end") - F.col("gap_start"))


def utilisation(islands: DataFrame, keys: Iterable[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, busy, span, utilisation): union length over the time from first start to last end."""
    busy, span = F.sum(F.col(end) - F.col(start)), F.max(end) - F.min(start)
    return islands.groupBy(*keys).agg(busy.alias("busy"), span.alias("span"), F.when(span > 0, busy / span).otherwise(0.0).alias("utilisation"))


def first_overlap(gaps_df: DataFrame, ops: DataFrame, key: str, width: float, order: str = "start") -> DataFrame:
    """For each gap the first operation with start < gap_end and end > gap_start.

    A range join by time cells: both sides are placed in every cell they touch and joined by (key, cell); a
    pair that meets in several cells collapses in the aggregation. Long intervals cost cells, not pairs.
    """
    cell = lambda x: F.floor(x / width)
    g = gaps_df.withColumn("_cell", F.explode(F.sequence(cell(F.col("gap_start")), cell(F.col("gap_end")))))
    o = ops.withColumn("_cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))))
    both = g.join(o, [key, "_cell"]).where("start < gap_end and end > gap_start")
    return both.groupBy(key, "gap_start", "gap_end").agg(F.min_by("name", F.struct(order, "end", "name")).alias("name"), F.min("start").alias("op_start"))


def paired_spans(events: DataFrame, key: str = "span_id") -> DataFrame:
    """Span starts joined to their ends: state is closed, open (no end) or orphan (no start)."""
    starts = events.where("type = 'span_start'").groupBy(key).agg(F.min("ts").alias("start_ts"), F.min("name").alias("name"), F.min("parent_span_id").alias("parent_span_id"), F.min("sample_index").alias("sample_index"))
    ends = events.where("type = 'span_end'").groupBy(key).agg(F.max("ts").alias("end_ts"), F.min("name").alias("end_name"), F.min("parent_span_id").alias("end_parent"), F.min("sample_index").alias("end_sample"))
    both = starts.join(ends, key, "full_outer")
    state = F.when(F.col("end_ts").isNull(), "open").when(F.col("start_ts").isNull(), "orphan").otherwise("closed")
    return both.select(key, F.coalesce("name", "end_name").alias("name"), F.coalesce("parent_span_id", "end_parent").alias("parent_span_id"), F.coalesce("sample_index", "end_sample").alias("sample_index"), "start_ts", "end_ts", state.alias("state"))


def clipped_tree(spans: DataFrame) -> DataFrame:
    """Depth of each span and the end at which an open one is drawn, per sample.

    A span tree belongs to one sample and is small; a task holds one sample's spans. Depth counts known
    ancestors, however many; a cycle ends the walk. An open span ends at the least of its next sibling's
    start, its nearest closed ancestor's end and the last time of the sample. A span without a sample
    belongs to no tree: depth 0, and an open one ends at its own start.
    """
    def run(key: tuple, part: list[dict]) -> list[tuple]:
        spans_of = {r["span_id"]: r for r in part}
        times = [t for r in part for t in (r["start_ts"], r["end_ts"]) if t is not None]
        last = max(times, default=None)
        by_parent: dict[str | None, list[tuple[float, str]]] = {}
        for r in part:
            if r["start_ts"] is not None:
                by_parent.setdefault(r["parent_span_id"], []).append((r["start_ts"], r["span_id"]))
        for siblings in by_parent.values():
            siblings.sort()
        out = []
        for r in part:
            chain, seen, at = [], {r["span_id"]}, r["parent_span_id"]
            while at in spans_of and at not in seen:
                chain.append(at)
                seen.add(at)
                at = spans_of[at]["parent_span_id"]
            end = r["end_ts"]
            if r["state"] == "open":
                bounds = [last]
                siblings = by_parent[r["parent_span_id"]]
                after = bisect_left(siblings, (r["start_ts"], r["span_id"])) + 1
                bounds += [t for t, _ in siblings[after : after + 1]]
                bounds += [spans_of[c]["end_ts"] for c in chain if spans_of[c]["state"] == "closed"][:1]
                end = min(b for b in bounds if b is not None)
            out.append((key[0], r["span_id"], len(chain), end))
        return out

    kept = spans.select("sample_index", "span_id", "parent_span_id", "start_ts", "end_ts", "state")
    trees = map_groups(kept.where("sample_index is not null"), ["sample_index"], ["span_id"], run, "sample_index long, span_id string, depth int, shown_end double")
    alone = kept.where("sample_index is null").select(F.col("sample_index").cast("long"), "span_id", F.lit(0).alias("depth"), F.coalesce("end_ts", "start_ts").cast("double").alias("shown_end"))
    return trees.unionByName(alone)
