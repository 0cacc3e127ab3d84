"""Loss masks of conversations under a pluggable template and tokenizer, and the texts that a mask trains on."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass

Tokenize = Callable[[str], list[tuple[int, int]]]


@dataclass(frozen=True)
class Template:
    """How a message is written: ``opening`` with the role, the content, ``closing``.

    ``reply_skipped`` is the part of an assistant's message that prompts it and is not trained (its opening);
    ``closing_trained`` tells whether its end mark is.
    """

    opening: str = "<|im_start|>{role}\n"
    closing: str = "<|im_end|>\n"
    closing_trained: bool = True
    roles: tuple[tuple[str, str], ...] = ()


# The families' templates.
TEMPLATES = {
    "qwen": Template(),
    "qwen3": Template(),
    "qwen3_5": Template(),
    "gemma4": Template("<start_of_turn>{role}\n", "<end_of_turn>\n", True, (("assistant", "model"),)),
    "distill_qwen": Template("<|{role}|>", "<|end_of_sentence|>", True),
}


def words(text: str) -> list[tuple[int, int]]:
    """Spans of white-space tokens with the space before them; stands in for a model's tokenizer."""
    return [m.span() for m in re.finditer(r"\s*\S+|\s+$", text)]


def content_of(message: dict) -> str:
    """Text of a message; typed parts are joined by blanks, other kinds of parts don't count."""
    content = message.get("content") or ""
    if isinstance(content, str):
        return content
    return " ".join(p if isinstance(p, str) else p.get("text", "") for p in content if isinstance(p, str) or p.get("type") == "text")


def rendered(messages: Iterable[dict], template: Template) -> tuple[str, list[tuple[int, int]]]:
    """Text of a conversation and the spans of it that are trained: assistants' words unless ``step_loss_mask`` is not 1."""
    names = dict(template.roles)
    text, spans = "", []
    for m in messages:
        text += template.opening.format(role=names.get(m["role"], m["role"]))
        start = len(text)
        text += content_of(m)
        end = len(text) + (len(template.closing.rstrip("\n")) if template.closing_trained else 0)
        text += template.closing
        if m["role"] == "assistant" and m.get("step_loss_mask", 1) == 1:
            spans.append((start, end))
    return text, spans


def loss_mask(messages: Iterable[dict], family: str = "qwen", tokenize: Tokenize = words) -> tuple[list[tuple[int, int]], list[int]]:
    """(token spans, mask): a token is trained if it begins within a trained span."""
    if family not in TEMPLATES:
        raise ValueError(f"unsupported family: {family}")
    text, spans = rendered(messages, TEMPLATES[family])
    tokens = tokenize(text)
    starts = [s for s, _ in spans]
    mask = []
    for a, b in tokens:
        # white space before a word belongs to the token, its first visible character decides
        first = a + len(text[a:b]) - len(text[a:b].lstrip()) if text[a:b].strip() else a
        k = bisect_right(starts, first) - 1
        mask.append(int(k >= 0 and first < spans[k][1]))
    return tokens, mask


def aligned(mask: list[int], length: int) -> list[int]:
    """Mask padded in front for tokens that images add; too short an input is an error."""
    if length < len(mask):
        raise ValueError(f"{length} tokens for a mask of {len(mask)}")
    return [0] * (length - len(mask)) + mask


def trained_texts(text: str, tokens: list[tuple[int, int]], mask: list[int]) -> list[str]:
    """Text of each run of trained tokens."""
    out, start = [], None
    for (a, b), m in zip(tokens, mask):
        if m and start is None:
            start = a
        if not m and start is not None:
            out.append(text[start:end])
            start = None
        end = b
    return [*out, text[start:end]] if start is not None else out
