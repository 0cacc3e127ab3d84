"""Arrow-batched wrappers of pure functions, for what built-in expressions cannot say."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def batched(f: Callable, kind: str, arity: int | None = None) -> Callable[..., Column]:
    """A vectorized UDF of a function of one row's values; nulls arrive as None."""

    def one(a: pd.Series) -> pd.Series:
        return pd.Series([f(None if _null(x) else x) for x in a], dtype=object)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return _rows(f, a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _rows(f, a, b, c)

    def four(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return _rows(f, a, b, c, d)

    if arity is None:
        arity = f.__code__.co_argcount - len(f.__defaults__ or ())
    return F.pandas_udf({1: one, 2: two, 3: three, 4: four}[arity], kind)


def _rows(f: Callable, *columns: pd.Series) -> pd.Series:
    return pd.Series([f(*(None if _null(v) else v for v in vs)) for vs in zip(*columns)], dtype=object)


def _null(x) -> bool:
    return x is None or (isinstance(x, float) and x != x)
