"""Message content: placeholders for media, token appending, ids in bytes, test-based grades."""

from __future__ import annotations

import base64
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The placeholders of the kinds of media.
PLACEHOLDERS = {"<image>": "image", "<video>": "video", "<audio>": "audio"}


def split_media(text: str, media: dict[str, list[str]]) -> list[dict[str, str]]:
    """Typed parts of a text whose placeholders take the media of their kind in order; a count that differs is an error."""
    kinds = {p: k for p, k in PLACEHOLDERS.items() if k in media}
    queues = {k: list(v) for k, v in media.items()}
    parts = []
    for piece in re.split("(" + "|".join(map(re.escape, kinds)) + ")" if kinds else r"(?!)", text):
        if piece in kinds:
            if not queues[kinds[piece]]:
                raise ValueError(f"more {piece} placeholders than items")
            parts.append({"type": kinds[piece], kinds[piece]: queues[kinds[piece]].pop(0)})
        elif piece:
            parts.append({"type": "text", "text": piece})
    left = {k: len(v) for k, v in queues.items() if v}
    if left:
        raise ValueError(f"items without a placeholder: {left}")
    return parts


def int32_array(text: Column) -> Column:
    """int32 values packed in base64."""

    def unpack(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else np.frombuffer(base64.b64decode(t), "<i4").tolist() for t in texts], dtype=object)

    return F.pandas_udf(unpack, "array<int>")(text)


def appended(mask: Column, log_probs: Column, more: Column, more_log_probs: Column, trainable: Column) -> tuple[Column, Column]:
    """(mask, log_probs) after tokens are appended; tokens that aren't trained get zeros.

    Trained tokens without log-probabilities, or of another number, fail the job.
    """
    right = ~trainable | (F.size(more) == F.coalesce(F.size(more_log_probs), F.lit(-1)))
    checked = F.when(right, F.size(more)).otherwise(F.raise_error(F.lit("log-probabilities don't match the tokens")).cast("int"))
    bits = F.array_repeat(trainable.cast("int"), checked)
    probs = F.when(trainable, more_log_probs).otherwise(F.array_repeat(F.lit(0.0), checked))
    return F.concat(mask, bits), F.concat(log_probs, probs)


def tests_reward(required: Column, passed: Column) -> Column:
    """1 if all required tests, at least one, are among those that passed."""
    return ((F.size(required) > 0) & (F.size(F.array_except(required, passed)) == 0)).cast("double")


def exit_reward(code: Column) -> Column:
    """1 for exit code 0; no run gives 0."""
    return F.coalesce((code == 0).cast("double"), F.lit(0.0))


def overwrite_delta(new: np.ndarray, old: np.ndarray) -> bytes:
    """What changed between two byte arrays of one length: the number of places (four bytes), the places, the new bytes."""
    places = np.flatnonzero(new != old).astype("<u4")
    return len(places).to_bytes(4, "little") + places.tobytes() + new[places].tobytes()


def with_delta(old: np.ndarray, delta: bytes) -> np.ndarray:
    """The array with a delta laid over it; doing so twice changes nothing."""
    n = int.from_bytes(delta[:4], "little")
    out = old.copy()
    out[np.frombuffer(delta, "<u4", n, 4)] = np.frombuffer(delta, np.uint8, n, 4 + 4 * n)
    return out


def image_of(part: dict) -> tuple[str, bytes | str] | None:
    """("bytes", content) of an image part given as data URI, base64 text or bytes, ("path", where) of one given by place; None for other parts.

    The image is under ``image``, ``image_url`` (text, or a mapping with ``url``) or ``data``. Content is not decoded further.
    """
    value = next((part[k] for k in ("image", "image_url", "data") if part.get(k) is not None), None)
    if isinstance(value, dict):
        value = value.get("url")
    if value is None or part.get("type", "image") not in ("image", "image_url", "input_image"):
        return None
    if isinstance(value, (bytes, bytearray)):
        return "bytes", bytes(value)
    if m := re.match(r"data:[^,;]*(;[^,]*)?,", value):
        body = value[m.end() :]
        return "bytes", base64.b64decode(body) if "base64" in (m[1] or "") else body.encode()
    if re.match(r"[a-z][a-z0-9+.-]*://|/|\.{1,2}/", value, re.I) or re.search(r"\.(?:png|jpe?g|gif|webp|bmp)$", value, re.I):
        return "path", value.removeprefix("file://")
    try:
        return "bytes", base64.b64decode(value, validate=True)
    except ValueError:
        return "path", value
