"""Evaluation data sets from a configuration: names, paths and fields, the most specific statement first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

#: Name of the data set where only a path is given.
SOLE = "aime"


def datasets(given: Mapping[str, Any] | Sequence[Any] | None) -> list[dict[str, Any]]:
    """Data sets of a mapping by name, a list of mappings with a name, or a flat list of names and paths; one lone path is ``SOLE``.

    A list entry without a name, a flat list of odd length and any other type are errors; nothing gives none.
    """
    if given is None:
        return []
    if isinstance(given, Mapping):
        return [{"name": name, **(fields or {})} for name, fields in given.items()]
    if isinstance(given, (str, bytes)) or not isinstance(given, Sequence):
        raise TypeError(f"data sets as {type(given).__name__}")
    if given and all(isinstance(x, str) for x in given):
        flat = [SOLE, *given] if len(given) == 1 else list(given)
        if len(flat) % 2:
            raise ValueError("names and paths must come in pairs")
        return [{"name": n, "path": p} for n, p in zip(flat[::2], flat[1::2])]
    out = [dict(x or {}) for x in given]
    if any("name" not in x for x in out):
        raise ValueError("a data set has no name")
    return out


def resolved(dataset: Mapping[str, Any], defaults: Mapping[str, Any] | None, args: Mapping[str, Any], fields: Mapping[str, tuple[Sequence[str], Sequence[str], Sequence[str]]]) -> dict[str, Any]:
    """The data set with every field: its own value, else the defaults', else the first argument that is set, else None.

    ``fields`` gives for each field the names under which data set, defaults and arguments state it. A value of None
    in the data set or the defaults is a statement; an argument that is None is none.
    """
    out = dict(dataset)
    for field, (own, default, arguments) in fields.items():
        stated = [source[k] for source, keys in ((dataset, own), (defaults or {}, default)) for k in keys if k in source]
        stated += [args[k] for k in arguments if args.get(k) is not None]
        out[field] = stated[0] if stated else None
    return out


def with_overrides(metadata: Mapping[str, Any] | None, overrides: Mapping[str, Any], rm_type: str | None = None) -> dict[str, Any]:
    """A sample's metadata with the data set's reward type and values laid over it."""
    return {**(metadata if isinstance(metadata, Mapping) else {}), **({"rm_type": rm_type} if rm_type is not None else {}), **overrides}
