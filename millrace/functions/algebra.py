"""Equality of short formulas without a computer algebra system.

Both formulas are parsed and evaluated at the same fixed points; formulas that agree at all of them to twelve digits count as
equal, which is wrong for practically no pair of different ones. Not decided, and so not equal: more than two unknown letters,
exponents in brackets, towers of powers, words, and texts of more than ``LONGEST`` characters.
"""

from __future__ import annotations

import cmath
import math
import re
from collections.abc import Callable

LONGEST = 400
#: Values of the unknowns; away from zeros, poles and each other's multiples.
POINTS = ((1.3178, 0.7219), (2.7391, 1.1933), (0.4127, 3.3661), (5.1049, 2.2317))
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|\\(?:d|t)?(frac)|\\?(sqrt|pi)|\\(cdot|times|div)|\\(?:left|right|[,;!: ])|([a-z])|([-+*/^(){}\[\]×·÷]))")

Formula = Callable[[float, float], complex]


class Unreadable(ValueError):
    """Not a formula that can be compared."""


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Unreadable(text[at:])
        at = m.end()
        found = next((g for g in m.groups() if g), None)
        if found:
            out.append({"cdot": "*", "times": "*", "×": "*", "·": "*", "div": "/", "÷": "/"}.get(found, found))
    return out


class Parser:
    """Recursive descent over sums, products (with or without a sign), powers, fractions and roots; two letters at most, by order of the alphabet."""

    def __init__(self, words: list[str], letters: list[str]):
        self.words, self.at, self.letters = words, 0, letters

    def peek(self) -> str:
        return self.words[self.at] if self.at < len(self.words) else ""

    def take(self, wanted: str = "") -> str:
        word = self.peek()
        if not word or (wanted and word != wanted):
            raise Unreadable(f"{word!r} instead of {wanted!r}")
        self.at += 1
        return word

    def whole(self) -> Formula:
        f = self.sum()
        if self.peek():
            raise Unreadable(self.peek())
        return f

    def sum(self) -> Formula:
        f = self.product()
        while self.peek() in ("+", "-"):
            f = _binary(self.take(), f, self.product())
        return f

    def product(self) -> Formula:
        f = self.signed()
        while (word := self.peek()) and word not in ("+", "-", ")", "}", "]"):
            operator = self.take() if word in ("*", "/") else "*"
            f = _binary(operator, f, self.signed() if word in ("*", "/") else self.power())
        return f

    def signed(self) -> Formula:
        if self.peek() in ("+", "-"):
            sign, f = self.take(), self.signed()
            return f if sign == "+" else lambda x, y: -f(x, y)
        return self.power()

    def power(self) -> Formula:
        base = self.atom()
        if self.peek() != "^":
            return base
        self.take()
        exponent = self.signed() if self.peek() in ("+", "-") else self.atom()
        return _binary("^", base, exponent)

    def group(self) -> Formula:
        """An argument in braces, or a single atom."""
        if self.peek() != "{":
            return self.atom()
        self.take()
        f = self.sum()
        self.take("}")
        return f

    def atom(self) -> Formula:
        word = self.take()
        if word in ("(", "{"):
            f = self.sum()
            self.take(")" if word == "(" else "}")
            return f
        if word == "frac":
            return _binary("/", self.group(), self.group())
        if word == "sqrt":
            degree: Formula = lambda x, y: 2
            if self.peek() == "[":
                self.take()
                degree = self.sum()
                self.take("]")
            inner = self.group()
            return lambda x, y: complex(inner(x, y)) ** (1 / degree(x, y))
        if word == "pi":
            return lambda x, y: math.pi
        if word in self.letters:
            i = self.letters.index(word)
            return (lambda x, y: x) if i == 0 else (lambda x, y: y)
        try:
            n = float(word)
        except ValueError:
            raise Unreadable(word) from None
        return lambda x, y: n


def _binary(operator: str, a: Formula, b: Formula) -> Formula:
    if operator == "+":
        return lambda x, y: a(x, y) + b(x, y)
    if operator == "-":
        return lambda x, y: a(x, y) - b(x, y)
    if operator == "*":
        return lambda x, y: a(x, y) * b(x, y)
    if operator == "/":
        return lambda x, y: a(x, y) / b(x, y)
    return lambda x, y: complex(a(x, y)) ** b(x, y)


def equal_formulas(a: str, b: str) -> bool:
    """Whether two formulas have the same value wherever they are tried."""
    a, b = a.lower(), b.lower()
    both = a + " " + b
    if len(both) > LONGEST or re.search(r"\^[{(]|\^\d+\^|\^\d\d+", both):
        return False
    letters = sorted(set(re.sub(r"sqrt|[dt]?frac|pi|cdot|times|div|left|right|[^a-z]", "", both)))
    if len(letters) > 2:
        return False
    try:
        f, g = (Parser(tokens(t), letters).whole() for t in (a, b))
    except (Unreadable, RecursionError):
        return False
    tried = 0
    for x, y in POINTS:
        try:
            u, v = complex(f(x, y)), complex(g(x, y))
        except (ZeroDivisionError, OverflowError, ValueError):
            continue
        if not (cmath.isfinite(u) and cmath.isfinite(v)):
            continue
        if not cmath.isclose(u, v, rel_tol=1e-12, abs_tol=1e-12):
            return False
        tried += 1
    return tried >= 3
