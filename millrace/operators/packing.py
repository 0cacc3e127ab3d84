"""Scheduling of one training step: micro-batches and their distribution over ranks.

A step is a bounded number of rollouts, so a task holds one step; steps run in parallel. Order-dependent
packings (first fit) follow the position of the samples.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Bins = list[list[int]]


def first_fit(lengths: Sequence[int], capacity: int) -> Bins:
    """Each item into the first bin with room; an oversized one alone.

    A tree of maxima over the rooms finds the first bin in logarithmic time.
    """
    n = len(lengths)
    size = 1
    while size < max(n, 1):
        size *= 2
    room = [0] * (2 * size)
    bins: Bins = []
    for i, length in enumerate(lengths):
        if bins and room[1] >= length:
            at = 1
            while at < size:
                at = 2 * at if room[2 * at] >= length else 2 * at + 1
            b = at - size
            bins[b].append(i)
            left = room[at] - length
        else:
            b = len(bins)
            bins.append([i])
            left = capacity - length
        at = size + b
        # an overfull bin takes nothing more, not even an empty item
        room[at] = left if left >= 0 else -1
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins


def largest_difference(weights: Sequence[int], k: int, equal_size: bool = False) -> Bins:
    """Karmarkar-Karp for k parts: the two widest partial partitions are joined, heavy parts with light ones."""
    n = len(weights)
    if n < k:
        raise ValueError(f"{n} items for {k} parts")
    if equal_size and n % k:
        raise ValueError(f"{n} items don't divide into {k} equal parts")
    # a part is (sum, count, ((index, weight), ...)); partial partitions keep theirs in decreasing order
    empty = (0, 0, ())
    order = sorted(range(n), key=lambda i: (weights[i], i))
    chunks = [order[i : i + k] for i in range(0, n, k)] if equal_size else [[i] for i in order]
    heap = []

    def push(parts: list) -> None:
        parts.sort(reverse=True)
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], _Reversed(parts[0]), len(heap), parts))

    for chunk in chunks:
        push([(weights[i], 1, ((i, weights[i]),)) for i in chunk] + [empty] * (k - len(chunk)))
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[3], heapq.heappop(heap)[3]
        push([(x[0] + y[0], x[1] + y[1], x[2] + y[2]) for x, y in zip(a, reversed(b))])
    return [sorted(i for i, _ in part[2]) for part in heap[0][3]]


class _Reversed:
    """Inverts the order of a key in a heap."""

    __slots__ = ("key",)

    def __init__(self, key: tuple):
        self.key = key

    def __lt__(self, other: _Reversed) -> bool:
        return other.key < self.key

    def __eq__(self, other: object) -> bool:
        return self.key == other.key


def greedy(weights: Sequence[int], k: int, equal_size: bool = False) -> Bins:
    """Items in their order to the lightest part, the first among ties.

    With ``equal_size`` the part with the fewest items comes first, then the lightest; a number of items that is no multiple
    of ``k`` is an error.
    """
    if equal_size and len(weights) % k:
        raise ValueError(f"{len(weights)} items don't make {k} parts of one size")
    parts: Bins = [[] for _ in range(k)]
    heap = [(0, 0, j) for j in range(k)]
    for i, w in enumerate(weights):
        items, total, j = heapq.heappop(heap)
        parts[j].append(i)
        heapq.heappush(heap, (items + equal_size, total + w, j))
    return parts


def split_largest(bins: Bins, target: int, lengths: Sequence[int]) -> Bins:
    """Halve the heaviest bin of several items until there are ``target`` bins or only single items."""
    out = [list(b) for b in bins]
    heap = [(-sum(lengths[i] for i in b), -j) for j, b in enumerate(out) if len(b) > 1]
    heapq.heapify(heap)
    while len(out) < target and heap:
        j = -heapq.heappop(heap)[1]
        halves, sums = ([], []), [0, 0]
        for i in sorted(out[j], key=lambda i: -lengths[i]):
            h = int(sums[0] > sums[1])
            halves[h].append(i)
            sums[h] += lengths[i]
        out[j] = halves[0]
        out.append(halves[1])
        for at, total, half in ((j, sums[0], halves[0]), (len(out) - 1, sums[1], halves[1])):
            if len(half) > 1:
                heapq.heappush(heap, (-total, -at))
    return out


def size_chunks(sizes: Sequence[int], most: int, chunk: int = 0, total: int = 0) -> list[int]:
    """Chunk of each item: a new one begins where the running size would exceed ``most``.

    ``chunk`` and ``total`` are number and size of a chunk that is open before the first item.
    """
    out = []
    for s in sizes:
        if total and total + s > most:
            chunk, total = chunk + 1, 0
        total += s
        out.append(chunk)
    return out


def chunk_carry(sizes: Sequence[int], most: int) -> tuple[list[int], list[int], list[int], int, int]:
    """What items do to the chunk open before them, so that ranges of items can be walked apart; see ``carried``.

    (edges, chunks, opens) has a row for each place at which the first new chunk may begin, at most ``most`` + 1:
    the running size there, the chunks begun from there on, and the size of the last. The last two values are
    the chunks begun and the last size if nothing is open. Sizes are not negative.
    """
    s = np.asarray(sizes, np.int64)
    n, ends = len(s), np.cumsum(s)
    if n and s.min() < 0:
        raise ValueError("a size below 0")
    base = ends - s
    # the item that begins the next chunk after one begun at each item; an item beyond ``most`` stands alone
    later = np.searchsorted(ends, base + most, "right")
    later = np.where((later < n) & (np.append(base, 0)[later] == base), later + 1, later).tolist()
    chunks, opens = [0] * (n + 1), (ends[-1:].repeat(n) - base).tolist()
    for i in range(n - 1, -1, -1):
        chunks[i] = 1 + (chunks[later[i]] if later[i] < n else 0)
        if later[i] < n:
            opens[i] = opens[later[i]]
    edges, at = np.unique(ends, return_index=True)
    kept = int(np.searchsorted(edges, most)) + 1
    at = at[:kept].tolist()
    return edges[:kept].tolist(), [chunks[i] for i in at], [opens[i] for i in at], chunks[0] - 1 if n else 0, opens[0] if n else 0


def carried(carry: tuple[Sequence[int], Sequence[int], Sequence[int], int, int], size: int, most: int, chunk: int, total: int) -> tuple[int, int]:
    """(chunk, total) open behind items of ``carry`` and of ``size`` together, from those open before."""
    edges, chunks, opens, fresh, left = carry
    if not total:
        return chunk + fresh, left
    i = bisect_right(edges, most - total)
    return (chunk + chunks[i], opens[i]) if i < len(edges) else (chunk, total + size)


def flops(length: int) -> int:
    """Relative work of a sequence: linear plus quadratic (fixed model sizes)."""
    return length * 6 * 1_000_000 + length * length * 12 * 4096


def schedule_step(lengths: Sequence[int], dp: int, capacity: int | None, micro_batch: int | None = None, align: int = 1, balance: bool = False) -> list[tuple[int, int, int, int]]:
    """(rank, micro-batch, position, item) of one step: pack, align their number to the ranks, distribute.

    Fixed-size micro-batches cannot be split and must align; dynamic ones are split until they do.
    """
    n = len(lengths)
    if n < dp:
        raise ValueError(f"{n} samples for {dp} ranks")
    bins = first_fit(lengths, capacity) if capacity is not None else [list(range(i, min(i + micro_batch, n))) for i in range(0, n, micro_batch)]
    unit = dp * align
    want = max(-(-len(bins) // unit) * unit, unit)
    if want != len(bins):
        if capacity is None:
            raise ValueError(f"{len(bins)} fixed micro-batches are no multiple of {unit}")
        bins = split_largest(bins, want, lengths)
        if len(bins) != want:
            raise ValueError(f"{n} samples give at most {len(bins)} micro-batches; {want} are needed")
    if balance:
        ranks = largest_difference([sum(flops(lengths[i]) for i in b) for b in bins], dp, equal_size=True)
    else:
        ranks = [list(range(r, len(bins), dp)) for r in range(dp)]
    return [(r, m, p, i) for r, own in enumerate(ranks) for m, b in enumerate(own) for p, i in enumerate(bins[b])]


def schedule(samples: DataFrame, dp: int, capacity: int | None, micro_batch: int | None = None, align: int = 1, balance: bool = False) -> DataFrame:
    """(step, rank, micro_batch, position, sample_index); ``samples`` has (step, sample_index, length)."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample_index").reset_index(drop=True)
        rows = schedule_step(part["length"].tolist(), dp, capacity, micro_batch, align, balance)
        index = part["sample_index"].tolist()
        return pd.DataFrame([(key[0], r, m, p, index[i]) for r, m, p, i in rows], columns=["step", "rank", "micro_batch", "position", "sample_index"])

    return samples.groupBy("step").applyInPandas(run, "step long, rank int, micro_batch int, position int, sample_index long")
