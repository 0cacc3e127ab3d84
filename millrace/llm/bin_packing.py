"""Filling fixed-capacity containers with items (problem 2).

Method: items are spread over partitions of bounded size; each partition packs its items by best-fit
decreasing and certifies its bin count with lower bounds from dual feasible functions. Bins of
partitions that hold more bins than their bound are opened where they have gaps; they are exchanged as
a whole (spread anew over fewer partitions) and their items packed again, and a partition keeps its old
bins unless the new ones are fewer. The rounds end when nothing is open any more or a round saves less
than ``LEAST_SAVED`` of the bins it exchanged.

Defined cases: a null length is no item; a null or negative response length trains nothing; an item of length 0 is placed like any other;
an item longer than the capacity is divided into full pieces and one rest; an empty table gives no bins.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import bounded_rows, cut

#: Items one task packs at once; bounds its memory at any size of the table.
ITEMS_PER_PART = 60_000
#: Share of the exchanged bins that a round must save for another one.
LEAST_SAVED = 0.001
PACKED = "setting string, capacity int, item long, piece int, start long, length int, bin string, round int, gap boolean"


def lower_bound(values: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing of a histogram of lengths needs: the best of the volume and two dual feasible families.

    The first family (threshold e) counts items above C - e as C, drops those below e and keeps the rest;
    the second (k) rounds x (k + 1) / C down, unless it is whole, in units of C / k.
    """
    keep = values > 0
    values, counts = values[keep].astype(np.int64), counts[keep].astype(np.int64)
    if not len(values):
        return 0
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    best = -(-int((values * counts).sum()) // capacity)
    cum_n, cum_v = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(values * counts)])
    thresholds = np.unique(np.minimum(values, capacity - values))
    for e in thresholds[(thresholds > 0) & (thresholds <= capacity // 2)]:
        hi, lo = np.searchsorted(values, capacity - e, "right"), np.searchsorted(values, e, "left")
        best = max(best, int(cum_n[-1] - cum_n[hi]) + -(-int(cum_v[hi] - cum_v[min(lo, hi)]) // capacity))
    for k in range(1, 41):
        scaled = values * (k + 1)
        units = np.where(scaled % capacity == 0, values * k / capacity, scaled // capacity)
        best = max(best, int(np.ceil((units * counts).sum() / k - 1e-9)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item; open bins are kept by rest of capacity, the tightest one found by a bit mask."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    open_at: dict[int, list[int]] = {}
    mask, n_bins = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = mask >> size
        if fitting:
            rest = size + (fitting & -fitting).bit_length() - 1
            stack = open_at[rest]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << rest)
        else:
            b, rest = n_bins, capacity
            n_bins += 1
        bins[i] = b
        rest -= size
        open_at.setdefault(rest, []).append(b)
        mask |= 1 << rest
    return bins


def _pack_part(part: pd.DataFrame, prefix: str, at: int) -> pd.DataFrame:
    capacity = int(part["capacity"].iloc[0])
    part = part.sort_values(["item", "piece"], kind="stable").reset_index(drop=True)
    lengths = part["length"].to_numpy(np.int64)
    bins = best_fit_decreasing(lengths, capacity)
    names = np.array([f"{prefix}-{b}" for b in range(int(bins.max()) + 1)], dtype=object)
    made = at
    if at:  # the old bins stay unless the new ones are fewer
        old, old_names = pd.factorize(part["bin"])
        if len(old_names) <= len(names):
            bins, names, made = old, old_names.to_numpy(object), part["round"]
    n_bins = len(names)
    gap = n_bins > lower_bound(*np.unique(lengths, return_counts=True), capacity)
    fill = np.bincount(bins, weights=lengths, minlength=n_bins)
    # bins with room are opened: in a part above its bound all that are not nearly full, else those whose
    # space only items of other parts can use
    open_again = fill < capacity * (0.995 if gap else 0.9)
    return part.assign(bin=names[bins], round=made, gap=open_again[bins])[[c.split()[0] for c in PACKED.split(", ")]]


def _packer(at: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return _pack_part(part, f"{key[0]}-{at}-{key[1]}", at)

    return run


def pieces(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """(setting, capacity, item, piece, start, length): every item under every setting, divided only if longer than it.

    ``capacities`` is the fixed table of settings (at most 1000 rows, checked); it becomes a literal.
    """
    rows = bounded_rows(capacities.where("setting is not null and capacity > 0"), 1000, "settings")
    if not rows:
        return items.sparkSession.createDataFrame([], "setting string, capacity int, item long, piece int, start long, length int")
    settings = F.array(*[F.struct(F.lit(r["setting"]).alias("setting"), F.lit(int(r["capacity"])).alias("capacity")) for r in rows])
    per = items.where("length >= 0").withColumn("s", F.explode(settings)).select("s.setting", "s.capacity", "item", "length")
    last = F.greatest(F.ceil(F.col("length") / F.col("capacity")) - 1, F.lit(0)).cast("int")
    cuts = per.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = (F.col("piece").cast("long") * F.col("capacity")).alias("start")
    return cuts.select("setting", "capacity", "item", "piece", start, F.least(F.col("capacity").cast("long"), F.col("length") - F.col("piece").cast("long") * F.col("capacity")).cast("int").alias("length"))


def pack(items: DataFrame, capacities: DataFrame, items_per_part: int = ITEMS_PER_PART) -> DataFrame:
    """(setting, capacity, item, piece, start, length, bin, round): a container for every piece.

    ``items`` has (item long, unique; length). ``round`` is the round that made the bin.
    """
    todo = cut(pieces(items, capacities)).withColumn("bin", F.lit(None).cast("string")).withColumn("round", F.lit(0))
    done, at = None, 0
    while True:
        before = {r["setting"]: r for r in todo.groupBy("setting").agg(F.count("*").alias("n"), F.count_distinct("bin").alias("bins")).collect()}
        if not before:
            break
        spread = F.create_map(*[x for s, r in before.items() for x in (F.lit(s), F.lit(max(1, -(-r["n"] // items_per_part))))])
        moved = F.xxhash64("item", "piece") if at == 0 else F.xxhash64("bin", F.lit(at))  # whole bins are exchanged
        parted = todo.withColumn("part", F.pmod(moved, F.element_at(spread, F.col("setting"))).cast("int"))
        packed = cut(parted.groupBy("setting", "part").applyInPandas(_packer(at), PACKED))
        if at:
            after = {r["setting"]: r["bins"] for r in packed.groupBy("setting").agg(F.count_distinct("bin").alias("bins")).collect()}
            settled = [s for s, r in before.items() if r["bins"] - after[s] <= LEAST_SAVED * r["bins"]]
            again = F.col("gap") & ~F.col("setting").isin(settled) if settled else F.col("gap")
        else:
            again = F.col("gap")
        kept = packed.where(~again).drop("gap")
        done = kept if done is None else done.unionByName(kept)
        todo = packed.where(again).drop("gap")
        at += 1
    if done is None:
        return items.sparkSession.createDataFrame([], PACKED).drop("gap")
    return done


def certified(packed: DataFrame) -> DataFrame:
    """(setting, capacity, bins, pieces, tokens, fill, bound, excess): the bound holds for the whole table.

    Lengths are at most the capacity, so the histogram that one task gets is bounded by it.
    """
    histogram = packed.groupBy("setting", "capacity", "length").agg(F.count("*").alias("n"))

    def bound(key: tuple, h: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], key[1], lower_bound(h["length"].to_numpy(), h["n"].to_numpy(), int(key[1])))], columns=["setting", "capacity", "bound"])

    bounds = histogram.groupBy("setting", "capacity").applyInPandas(bound, "setting string, capacity int, bound long")
    per_bin = packed.groupBy("setting", "capacity", "bin").agg(F.count("*").alias("pieces"), F.sum("length").alias("tokens"))
    total = per_bin.groupBy("setting", "capacity").agg(F.count("*").alias("bins"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))
    fill = F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("fill")
    return total.join(bounds, ["setting", "capacity"]).select("setting", "capacity", "bins", "pieces", "tokens", fill, "bound", (F.col("bins") - F.col("bound")).alias("excess"))


def train_items(train_data: DataFrame) -> DataFrame:
    """(item, length, trained): one row per sample; rows delivered again collapse to the longest tokens."""
    rows = train_data.select(F.col("sample_indices").alias("item"), F.size("tokens").cast("long").alias("length"), F.col("response_lengths").cast("long").alias("trained"))
    rows = rows.where("item is not null and length >= 0")
    return rows.groupBy("item").agg(F.max("length").alias("length"), F.max_by("trained", F.struct("length", "trained")).alias("trained"))


def certificate(train_data: DataFrame, pack_limits: DataFrame) -> DataFrame:
    """The bins used for each setting against the bound that no packing can beat."""
    limits = pack_limits.select("setting", F.col("max_tokens_per_gpu").alias("capacity"))
    return certified(pack(cut(train_items(train_data)).select("item", "length"), limits))


def micro_batches(train_data: DataFrame, pack_limits: DataFrame) -> DataFrame:
    """(setting, bin, sample_index, piece, start, length, trained): trained counts response tokens, which end a sample."""
    items = cut(train_items(train_data))
    limits = pack_limits.select("setting", F.col("max_tokens_per_gpu").alias("capacity"))
    packed = pack(items.select("item", "length"), limits)
    whole = items.select("item", F.col("length").alias("total"), "trained")
    first_trained = F.col("total") - F.least(F.greatest(F.coalesce("trained", F.lit(0)), F.lit(0)), F.col("total"))
    end = F.col("start") + F.col("length")
    trained = F.greatest(F.lit(0).cast("long"), end - F.greatest(first_trained, F.col("start")))
    return packed.join(whole, "item").select("setting", "bin", F.col("item").alias("sample_index"), "piece", "start", "length", trained.alias("trained"))
