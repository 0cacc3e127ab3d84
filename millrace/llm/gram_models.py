"""Naive Bayes over hashed runs of one to three characters, fitted here from labelled texts and applied to whole batches.

Texts are read as their letters, case disregarded; anything else separates words. A fit counts the runs of all rows of a
table where they are, so only sums per class and cell meet; counting and scoring take any number of texts of any length, in
pieces of about ``RUN`` characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the table of log-probabilities, and characters scored at once.
CELLS = 1 << 16
RUN = 300_000
_SEPARATORS = re.compile(r"[\W\d_]+")
_MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def _grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell) of all runs of characters, and the letters of each text."""
    spaced = [" " + _SEPARATORS.sub(" ", t.casefold()).strip() + " " for t in texts]
    sizes = np.array([len(t) for t in spaced], np.int64)
    codes = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), sizes)
    rows, cells = [], []
    mixed = np.zeros(len(codes), np.uint32)
    for n in range(3):  # runs of n + 1 characters that start at each place
        last = len(codes) - n
        if last <= 0:
            break
        with np.errstate(over="ignore"):
            mixed = (mixed[:last] ^ codes[n:]) * _MIX[n]
            mixed ^= mixed >> np.uint32(15)
        whole = row[:last] == row[n:]
        if n == 0:
            whole = whole & (codes != 32)
        rows.append(row[:last][whole])
        cells.append((mixed[whole] % np.uint32(CELLS)).astype(np.int64))
    letters = np.bincount(row[codes != 32], minlength=len(texts))
    return np.concatenate(rows), np.concatenate(cells), letters


def _pieces(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts of about ``RUN`` characters."""
    sizes = np.cumsum([len(t) for t in texts]) // RUN
    bounds = np.flatnonzero(np.concatenate([[True], sizes[1:] != sizes[:-1], [True]])) if len(texts) else [0]
    return zip(bounds[:-1], bounds[1:])


def gram_counts(texts: Sequence[str], at: np.ndarray, classes: int) -> np.ndarray:
    """Counts by class (``at`` has the number of each text's) and cell; the last column has the texts of the class."""
    out = np.zeros((classes, CELLS + 1), np.int64)
    for a, b in _pieces(texts):
        row, cell, _ = _grams(texts[a:b])
        out[:, :CELLS] += np.bincount(at[a:b][row] * CELLS + cell, minlength=classes * CELLS).reshape(classes, CELLS)
    out[:, CELLS] = np.bincount(at, minlength=classes)
    return out


def counted(rows: DataFrame, examples: Callable[[pd.DataFrame], tuple[Sequence[str], np.ndarray]], classes: int) -> np.ndarray:
    """``gram_counts`` over all rows of a table; ``examples`` gives texts and classes of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((classes, CELLS + 1), np.int64)
        for b in batches:
            total += gram_counts(*examples(b), classes)
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells, "n": total.ravel()[cells]})

    # at most a row per class and cell reaches the driver
    sums = rows.mapInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes * (CELLS + 1), np.int64)
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(classes, CELLS + 1)


@dataclass
class GramModel:
    """Classes and the logarithm of each cell's share in each class."""

    classes: tuple[str, ...]
    table: np.ndarray

    @staticmethod
    def of_counts(counts: np.ndarray, classes: Sequence[str]) -> GramModel | None:
        """A model of the classes that occur in ``gram_counts``; None if there are fewer than two."""
        some = [k for k in range(len(classes)) if counts[k, CELLS]]
        if len(some) < 2:
            return None
        seen = counts[some, :CELLS] + 0.1
        return GramModel(tuple(classes[k] for k in some), np.log(seen / seen.sum(1, keepdims=True)).T.astype(np.float32))

    def score(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best class or -1, mean log-odds against the next best per run, letters) of each text."""
        best, margin, letters = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for a, b in _pieces(texts):
            row, cell, letters[a:b] = _grams(texts[a:b])
            n = np.maximum(np.bincount(row, minlength=b - a), 1)
            sums = np.stack([np.bincount(row, weights=self.table[cell, k], minlength=b - a) for k in range(len(self.classes))], axis=1)
            order = np.sort(sums, axis=1)
            some = letters[a:b] > 0
            margin[a:b] = np.where(some, (order[:, -1] - order[:, -2]) / n, 0)
            best[a:b] = np.where(some, sums.argmax(1), -1)
        return best, margin, letters
