"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

Method: a text is cut into pre-tokens by the vocabulary's pattern; each distinct pre-token is merged
with a rank queue: the bytes form a linked list, every merge rank has a bucket of list positions, a
hierarchical bitmap over the ranks gives the next rank by find-first-set, and entries that no longer
describe their pair are skipped. Merging costs O(n) queue operations however long the pre-token is.
Pre-tokens repeat, so each task keeps a bounded table of those it has merged.

Defined cases: null and empty texts give an empty list; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import ast
import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies on every executor: rank files, and a module that states the pattern as a literal.
TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
#: Pre-tokens of at most this many bytes are kept, at most so many of them.
CACHE_BYTES, CACHE_ENTRIES = 64, 400_000
#: Rows encoded into one output batch.
ROWS = 500


class RankQueue:
    """Set of ranks with find-first-set over a bitmap of three levels of 64-bit words, and a bucket of positions per rank."""

    def __init__(self, size: int):
        n0 = -(-size // 64)
        n1 = -(-n0 // 64)
        self.level0, self.level1, self.level2 = [0] * n0, [0] * n1, [0] * -(-n1 // 64)
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            w = rank >> 6
            if not self.level0[w]:
                v = w >> 6
                if not self.level1[v]:
                    self.level2[v >> 6] |= 1 << (v & 63)
                self.level1[v] |= 1 << (w & 63)
            self.level0[w] |= 1 << (rank & 63)
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank with all its positions."""
        for u, word in enumerate(self.level2):
            if word:
                v = (u << 6) | ((word & -word).bit_length() - 1)
                word = self.level1[v]
                w = (v << 6) | ((word & -word).bit_length() - 1)
                word = self.level0[w]
                rank = (w << 6) | ((word & -word).bit_length() - 1)
                self.level0[w] &= word - 1
                if not self.level0[w]:
                    self.level1[v] &= ~(1 << (w & 63))
                    if not self.level1[v]:
                        self.level2[u] &= ~(1 << (v & 63))
                return rank, self.buckets.pop(rank)
        return None


def stated_pattern(folder: str) -> str:
    """The literal that ``PATTERN`` is set to in the folder's module, which is read and not run."""
    with open(os.path.join(folder, "__init__.py"), encoding="utf-8") as f:
        tree = ast.parse(f.read())
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(getattr(t, "id", None) == "PATTERN" for t in node.targets):
            return ast.literal_eval(node.value)
    raise ValueError(f"no PATTERN in {folder}")


class ByteBpe:
    """Encoder of one vocabulary of ranks."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
        with open(os.path.join(folder, name), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(stated_pattern(folder))
        self.byte_ids = [self.ranks[bytes([i])] for i in range(256)]
        # (id, id) -> id of the merged token, filled as pairs are met
        self.names = {i: t for t, i in self.ranks.items()}
        self.pairs: dict[int, int] = {}
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.cache: dict[str, list[int]] = {}

    def pair_rank(self, a: int, b: int) -> int:
        """Id, which is also the merge rank, of the token that a and b give; -1 if there is none."""
        key = (a << 20) | b
        rank = self.pairs.get(key)
        if rank is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            rank = self.pairs[key] = self.ranks.get(self.names[a] + self.names[b], -1)
        return rank

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.byte_ids[x] for x in piece]
        n = len(ids)
        if n < 2:
            return ids
        rank_of, queue = self.pair_rank, self.queue
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for i in range(n - 1):
            r = rank_of(ids[i], ids[i + 1])
            if r >= 0:
                queue.push(r, i)
        while (least := queue.pop()) is not None:
            rank, positions = least
            positions.sort()
            for i in positions:
                j = after[i]
                # stale: i was swallowed, or its pair is another by now
                if ids[i] < 0 or j >= n or rank_of(ids[i], ids[j]) != rank:
                    continue
                ids[i], ids[j] = rank, -1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    r = rank_of(rank, ids[k])
                    if r >= 0:
                        queue.push(r, i)
                h = before[i]
                if h >= 0:
                    r = rank_of(ids[h], rank)
                    if r >= 0:
                        queue.push(r, h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for piece in self.pattern.findall(text):
            ids = cache.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "replace")
                ids = self.merge(raw)
                if len(raw) <= CACHE_BYTES:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out


_ENCODERS: dict[tuple[str, str], ByteBpe] = {}


def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> ByteBpe:
    """One encoder a process."""
    if (folder, name) not in _ENCODERS:
        _ENCODERS[folder, name] = ByteBpe(folder, name)
    return _ENCODERS[folder, name]


def encoded(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids): the token ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(folder)
        for b in batches:
            for part in _small(b):
                ids = pa.array([bpe.encode(t) for t in part.column("text").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def _small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, as one of long texts would give a very large one of ids."""
    return (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS))


def token_counts(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens); the ids stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(folder)
        for b in batches:
            counts = pa.array([len(bpe.encode(t)) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), counts], ["doc_id", "source", "n_tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, n_tokens long")


def token_totals(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(source, documents, empty, tokens, chars): what the encoding of each source comes to."""
    chars = documents.select("doc_id", F.length("text").alias("chars"))
    counts = token_counts(documents, folder).join(chars, "doc_id")
    return counts.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.when(F.col("n_tokens") == 0, 1).otherwise(0)).cast("long").alias("empty"), F.sum("n_tokens").alias("tokens"), F.sum("chars").alias("chars"))
