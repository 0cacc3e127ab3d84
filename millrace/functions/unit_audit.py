"""Whether a question states the unit of its answer, needs none, or needs one that is missing.

Ordered rules: a stated unit, then counts and dimensionless answers, then quantities without a unit, then
a cautious fallback. The fingerprint of the rules goes into the lineage of what is made with them.
"""

from __future__ import annotations

import hashlib
import inspect
import re
import sys

from millrace.operators.units import asked_unit

EXPLICIT, NOT_NEEDED, MISSING = "explicit_unit_specified", "unit_not_needed", "unit_required_but_unspecified"

# Words that ask for a quantity, and for a pure number.
QUANTITIES = (
    "mass weight distance length height width depth diameter radius circumference area volume speed velocity time duration energy power force pressure temperature density "
    "cost price frequency voltage current wavelength thickness lifetime acceleration momentum torque charge heat memory storage data age perimeter consumption flow rate"
).split()
ADJECTIVES = "long far fast heavy hot cold tall deep high wide thick old big large loud".split()
PURE = "ratio fraction probability percentage percent number count factor odds exponent logarithm log factorial sum product".split()

_RULES = (
    # (pattern, classification, reason, confidence, review)
    (re.compile(r"\bwhat\s+(?:is|are|was|would be)\b[^?]*\b(?:" + "|".join(PURE) + r")\b", re.I), NOT_NEEDED, "a pure number is asked for", "high", False),
    (re.compile(r"\b(?:ratio|fraction|probability|odds)\b[^?]*\?", re.I), NOT_NEEDED, "a pure number is asked for", "medium", False),
    (re.compile(r"\bpopulation\b", re.I), NOT_NEEDED, "a population is a count", "high", False),
    (re.compile(r"\bhow\s+many\b|\bnumber\s+of\b", re.I), NOT_NEEDED, "a count is asked for", "high", False),
    (re.compile(r"\bhow\s+(?:" + "|".join(ADJECTIVES) + r")\b", re.I), MISSING, "a quantity is asked for without a unit", "high", False),
    (re.compile(r"\bwhat\b[^?]*\b(?:" + "|".join(QUANTITIES) + r")\b", re.I), MISSING, "a quantity is named without a unit", "medium", False),
    (re.compile(r"\bhow\s+much\b|\bweigh\b", re.I), MISSING, "a magnitude is asked for without a unit", "medium", True),
)


def audit(question: str | None) -> tuple[str, str, str, str, bool]:
    """(classification, unit, reason, confidence, needs review) of a question; only its last sentence asks."""
    text = re.sub(r"\s+", " ", question or "").strip()
    if found := asked_unit(text):
        return EXPLICIT, found[1], "a unit is asked for", "high", False
    asks = re.split(r"(?<=[.!;])\s+", text)[-1] if text else ""
    for pattern, kind, reason, confidence, review in _RULES:
        if pattern.search(asks):
            return kind, "", reason, confidence, review
    return MISSING, "", "neither a unit nor a count is clear", "low", True


def logic_sha256() -> str:
    """Fingerprint of the rules."""
    return hashlib.sha256(inspect.getsource(sys.modules[__name__]).encode()).hexdigest()
