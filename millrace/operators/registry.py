"""Registry of hooks in four signatures, and the dispatch of graders by reward type.

Kinds: ``expr`` (Column -> Column), ``series`` (pandas Series -> Series), ``group`` (pandas DataFrame ->
DataFrame), ``stage`` (DataFrame -> DataFrame). A dotted path names a hook that is not registered.
"""

from __future__ import annotations

import importlib
import json
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame

from millrace.functions import grading as G
from millrace.functions.udfs import batched

KINDS = ("expr", "series", "group", "stage")
_HOOKS: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    if kind not in KINDS:
        raise ValueError(f"unknown kind of hook: {kind}")

    def add(f: Callable) -> Callable:
        _HOOKS[kind, name] = f
        return f

    return add


def resolve(kind: str, name: str) -> Callable:
    """A registered hook, or the object at a dotted path."""
    if (kind, name) in _HOOKS:
        return _HOOKS[kind, name]
    module, _, attribute = name.rpartition(".")
    if not module:
        raise KeyError(f"no {kind} hook named {name}")
    return getattr(importlib.import_module(module), attribute)


def apply_stages(df: DataFrame, names: list[str]) -> DataFrame:
    """Stages in order."""
    for name in names:
        df = resolve("stage", name)(df)
    return df


def _fermi(response: str | None, label: str | None) -> float:
    target = G.positive_log10(label)
    return 0.0 if target is None else G.fermi_score(G.answer_log10(response), target)[0]


#: Reward types to graders, functions of response, label and the row's metadata (a mapping, perhaps empty); users add theirs.
GRADERS: dict[str, Callable[[str | None, str | None, dict], float | None]] = {
    "f1": lambda r, t, m: G.f1_score(r, t)[0],
    "math": lambda r, t, m: G.math_reward(r, t),
    "deepscaler": lambda r, t, m: G.reasoned_math_reward(r, t),
    "dapo": lambda r, t, m: G.integer_answer_reward(r, t),
    "gpqa": G.choice_reward,
    "fermi": lambda r, t, m: _fermi(r, t),
    "random": lambda r, t, m: float(zlib.crc32(f"{r}|{t}".encode()) & 1),
}


def grade(kind: str | None, response: str | None, label: str | None, metadata: str | dict | None = None) -> float | None:
    """Reward by type; ``boxed_x`` hands x the content of the last box (empty without one).

    A type in ``metadata`` (a mapping or its JSON) goes before ``kind``. Without any type there is no reward (None);
    an unknown one raises. A label that the grader cannot read gives None.
    """
    about = _mapping(metadata)
    kind = str(about.get("rm_type") or kind or "").strip()
    if not kind:
        return None
    name = kind.removeprefix("boxed_")
    if name not in GRADERS:
        raise NotImplementedError(f"no reward type {kind}")
    if name != kind:
        response = G.last_boxed(response) or ""
    try:
        return GRADERS[name](response, label, about)
    except (ValueError, TypeError, OverflowError):
        return None


def _mapping(metadata: str | dict | None) -> dict:
    """Metadata as a mapping; text that is no JSON object gives an empty one."""
    if isinstance(metadata, str):
        try:
            metadata = json.loads(metadata)
        except ValueError:
            return {}
    return metadata if isinstance(metadata, dict) else {}


def graded(df: DataFrame, kind: str, response: str, label: str, out: str = "reward", metadata: str | None = None) -> DataFrame:
    """Reward of each row by its own type, in one pass over the table."""
    columns = (kind, response, label) + ((metadata,) if metadata else ())
    f = grade if metadata else lambda k, r, t: grade(k, r, t)
    return df.withColumn(out, batched(f, "double", len(columns))(*columns))
