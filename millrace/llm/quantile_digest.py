"""Percentiles of very large numeric columns by mergeable digests (problem 3).

Method: a value is quantized to a cell of a bounded ordered universe (the leading bits of its IEEE
double in total order), the cells are the leaves of a dyadic tree, and a digest is the counts of the
tree's nodes, compressed so that nodes whose family has at most n / k counts move up to the parent.
Digests merge by adding the counts of equal nodes. The rank of an answer is off by at most the counts
held in the ancestors of its leaf, at most depth * n / k for one compression; merging adds up errors.

Stated error: rank within ``EPS`` * n, value within a relative 2**-(BITS - 12) of a value of that rank.
Defined cases: null and NaN are no measures; infinities are the ends of the universe; a group without
a measure has no row; -0.0 equals 0.0; rows delivered again (same event_id) count once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import stored

#: Bits of the universe: sign, 11 of the exponent and the rest of the mantissa.
BITS = 22
EPS = 0.005
#: A family of at most n / K counts moves up; one compression is off by at most BITS / K = EPS / 2.
K = int(2 * BITS / EPS)
MEASURES = ("queue_time", "e2e_latency", "decode_throughput")
PERCENTILES = (0.5, 0.9, 0.95, 0.99, 0.999)


def quantize(values: np.ndarray) -> np.ndarray:
    """Leaf of each value: the leading ``BITS`` of its bits, in the order of the values."""
    bits = (values + 0.0).view(np.uint64)
    negative = bits >> np.uint64(63) == 1
    ordered = np.where(negative, ~bits, bits | np.uint64(1 << 63))
    return (ordered >> np.uint64(64 - BITS)).astype(np.int64)


def midpoint(leaf: np.ndarray) -> np.ndarray:
    """A value within the cell of each leaf."""
    ordered = (leaf.astype(np.uint64) << np.uint64(64 - BITS)) | np.uint64(1 << (63 - BITS))
    negative = ordered >> np.uint64(63) == 0
    return np.where(negative, ~ordered, ordered & np.uint64((1 << 63) - 1)).view(np.float64)


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compress the digests of many groups at once, level by level from the leaves.

    Nodes are numbered as in a heap: the root is 1, leaves are 2**BITS + leaf.
    """
    if not len(group):
        return group, node, count
    total = np.bincount(group, weights=count)
    limit = np.floor(total / k).astype(np.int64)
    kept = []
    level = np.floor(np.log2(node.astype(np.float64))).astype(np.int64)
    by_level = {d: level == d for d in np.unique(level).tolist()}
    up_g, up_n, up_c = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    for d in range(BITS, -1, -1):
        here = by_level.get(d)
        g = np.concatenate([up_g, group[here]]) if here is not None else up_g
        n = np.concatenate([up_n, node[here]]) if here is not None else up_n
        c = np.concatenate([up_c, count[here]]) if here is not None else up_c
        if not len(g):
            up_g = up_n = up_c = np.empty(0, np.int64)
            continue
        g, n, c = _add(g, n, c)
        if d == 0:
            kept.append((g, n, c))
            break
        # a family is two siblings and what their parent holds already
        parent = n >> 1
        first = np.concatenate([[True], (g[1:] != g[:-1]) | (parent[1:] != parent[:-1])])
        family = np.cumsum(first) - 1
        weight = np.bincount(family, weights=c)
        above = by_level.get(d - 1)
        if above is not None:
            held = _add(group[above], node[above], count[above])
            keys, wanted = (held[0] << (BITS + 1)) + held[1], (g[first] << (BITS + 1)) + parent[first]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            weight = weight + np.where(keys[at] == wanted, held[2][at], 0)
        move = weight[family] <= limit[g]
        kept.append((g[~move], n[~move], c[~move]))
        up_g, up_n, up_c = g[move], parent[move], c[move]
    return tuple(np.concatenate(x) for x in zip(*kept))


def _add(g: np.ndarray, n: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((n, g))
    g, n, c = g[order], n[order], c[order]
    first = np.concatenate([[True], (g[1:] != g[:-1]) | (n[1:] != n[:-1])])
    return g[first], n[first], np.add.reduceat(c, np.flatnonzero(first))


def answer(node: np.ndarray, count: np.ndarray, percentiles: Iterable[float]) -> list[tuple[float, float, int, int]]:
    """(p, value, n, rank error) of one digest; nodes are walked in the order of their largest leaf, inner nodes later."""
    level = np.floor(np.log2(node.astype(np.float64))).astype(np.int64)
    high = ((node + 1) << (BITS - level)) - 1
    low = node << (BITS - level)
    order = np.lexsort((-level, high))
    running = np.cumsum(count[order])
    n = int(running[-1])
    out = []
    for p in percentiles:
        target = max(1, int(np.ceil(p * n)))
        at = order[np.searchsorted(running, target)]
        leaf = high[at]
        around = (low <= leaf) & (leaf <= high) & (level < BITS)
        out.append((float(p), float(midpoint(np.array([leaf - (1 << BITS)]))[0]), n, int(count[around].sum())))
    return out


def day_digests(events: DataFrame) -> DataFrame:
    """(engine_id, day, metric, node, count): compressed digests; any set of them merges by adding counts."""
    rows = events.select("event_id", "engine_id", F.date_format(F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")), "yyyy-MM-dd").alias("day"), *MEASURES)
    rows = rows.where(" or ".join(f"{m} is not null" for m in MEASURES))
    once = rows.groupBy(F.coalesce("event_id", F.xxhash64(*rows.columns)).alias("event")).agg(F.min(F.struct("engine_id", "day", *MEASURES)).alias("e")).select("e.*")

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            group = b.groupby(["engine_id", "day"], dropna=False, sort=False)
            codes = group.ngroup().to_numpy()
            keys = b[["engine_id", "day"]].iloc[np.sort(np.unique(codes, return_index=True)[1])].reset_index(drop=True)
            for m in MEASURES:
                x = b[m].to_numpy(np.float64, na_value=np.nan)
                ok = ~np.isnan(x)
                g, n, c = _add(codes[ok], quantize(x[ok]) + (1 << BITS), np.ones(ok.sum(), np.int64)) if ok.any() else (np.empty(0, np.int64),) * 3
                if len(g):
                    out = keys.iloc[g].reset_index(drop=True)
                    yield out.assign(metric=m, node=n, count=c)

    counted = once.mapInPandas(leaves, "engine_id string, day string, metric string, node long, count long")
    merged = counted.groupBy("engine_id", "day", "metric", "node").agg(F.sum("count").alias("count"))
    return compressed(merged, ["engine_id", "day", "metric"])


def compressed(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Compress digests; groups are whole within a task and their nodes are bounded by the universe."""
    schema = nodes.select(*keys, "node", "count").schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_groups(batches, keys):
            by = whole.groupby(keys, dropna=False, sort=False)
            codes = by.ngroup().to_numpy()
            names = whole[keys].iloc[np.sort(np.unique(codes, return_index=True)[1])].reset_index(drop=True)
            g, n, c = compress(codes, whole["node"].to_numpy(np.int64), whole["count"].to_numpy(np.int64))
            yield names.iloc[g].reset_index(drop=True).assign(node=n, count=c)

    return nodes.select(*keys, "node", "count").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no group is cut by a batch border."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = b[keys].iloc[-1]
        same = np.logical_and.reduce([(b[k] == last[k]) | (b[k].isna() & pd.isna(last[k])) for k in keys]).astype(bool)
        cut_at = len(b) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut_at:
            yield pd.concat([*held, b.iloc[:cut_at]], ignore_index=True)
            held = [b.iloc[cut_at:]]
        elif held and not _same_key(held[-1], b, keys):
            yield pd.concat(held, ignore_index=True)
            held = [b]
        else:
            held.append(b)
    if held:
        yield pd.concat(held, ignore_index=True)


def _same_key(a: pd.DataFrame, b: pd.DataFrame, keys: list[str]) -> bool:
    x, y = a[keys].iloc[-1], b[keys].iloc[0]
    return all(x[k] == y[k] or (pd.isna(x[k]) and pd.isna(y[k])) for k in keys)


def merged_days(digests: DataFrame) -> DataFrame:
    """(engine_id, metric, node, count): the digests of all days of an engine, merged by node addition."""
    return digests.groupBy("engine_id", "metric", "node").agg(F.sum("count").alias("count"))


def percentiles(digests: DataFrame, keys: list[str], at: Iterable[float] = PERCENTILES) -> DataFrame:
    """(keys, p, value, n, rank_error): ``rank_error`` is the bound that holds for this very answer."""
    at = list(at)
    types = dict(digests.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", p double, value double, n long, rank_error long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_groups(batches, keys):
            out = []
            for key, rows in whole.groupby(keys, dropna=False, sort=False):
                name = tuple(None if pd.isna(k) else k for k in key)
                out += [(*name, *a) for a in answer(rows["node"].to_numpy(np.int64), rows["count"].to_numpy(np.int64), at)]
            yield pd.DataFrame(out, columns=[*keys, "p", "value", "n", "rank_error"])

    return digests.select(*keys, "node", "count").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def engine_percentiles(events: DataFrame) -> DataFrame:
    """(engine_id, day, metric, p, value, n, rank_error) per engine and day, and per engine with a null day."""
    digests = stored(day_digests(events), "digests")
    daily = percentiles(digests, ["engine_id", "day", "metric"])
    overall = percentiles(merged_days(digests), ["engine_id", "metric"]).withColumn("day", F.lit(None).cast("string"))
    return daily.unionByName(overall)
