"""Visually identical text with different characters (problem 10).

Method: the texts of an Arrow batch are one array of code points; every code point is replaced by its
expansion through lookup tables (a gather of lengths and offsets), marks are put in canonical order,
and marks are composed with their letters, all on whole batches.

The form: full-width and half-width forms, ligatures, compatibility signs (not raised or lowered
digits and letters, which a reader tells apart), no-break spaces and look-alike letters of other
scripts become the plain character; invisible format characters go; accents are composed; line ends
become LF, and white space that ends a line goes. Case, accents, digits, raised digits, signs, tabs
and inner spacing are kept.

Defined cases: a null text stays null, an empty one empty; a joiner between two pictographs is kept,
as it changes what is drawn; very long texts are treated whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import cut

# Letters of other scripts that are drawn like a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ϳ": "j", "ɡ": "g", "ɑ": "a", "Ϲ": "C", "ϲ": "c", "Ϳ": "J",
    "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "ѵ": "v",
    "Օ": "O", "օ": "o", "Տ": "S", "ո": "n", "ս": "u", "հ": "h", "յ": "j",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
#: Dashes and hyphens drawn like the hyphen-minus.
HYPHENS = "\u2010\u2011"
#: Kinds of compatibility decomposition that keep the look.
KEEP_LOOK = ("<wide>", "<narrow>", "<compat>", "<noBreak>")
#: Format characters and fillers without a glyph.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0\ufe0e\ufe0f"
ZWJ = 0x200D
#: Bytes normalized at once; bounds the memory of a batch.
RUN = 1 << 19
_TOP = 0x110000
_S, _L, _V, _T = 0xAC00, 0x1100, 0x1161, 0x11A7


def _expansion(c: str) -> str:
    """What one character becomes, before composing."""
    if "\uac00" <= c <= "\ud7a3":
        return c
    if c in INVISIBLE or (unicodedata.category(c) == "Cf" and ord(c) != ZWJ):
        return ""
    d = unicodedata.decomposition(c)
    if d:
        tag, *rest = d.split()
        if tag[0] != "<":
            return "".join(_expansion(chr(int(x, 16))) for x in (tag, *rest))
        if tag in KEEP_LOOK and not ("\u2070" <= c <= "\u209f"):
            out = "".join(_expansion(chr(int(x, 16))) for x in rest)
            # a spacing accent is a sign of its own, not a blank with a mark
            return c if unicodedata.category(c) in ("Sk", "Lm") and " " in out else out
    if c in HYPHENS:
        return "-"
    if unicodedata.category(c) == "Zs":
        return " "
    return LOOKALIKES.get(c, c)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Length and offset of each expansion, their characters, classes of marks, sorted pairs with their composites, pictographs."""
    length, offset = np.ones(_TOP, np.uint8), np.arange(_TOP, dtype=np.int32)
    flat = [np.arange(_TOP, dtype=np.uint32)]
    more: list[int] = []
    marks = np.zeros(_TOP, np.uint8)
    pictographs = np.zeros(_TOP, bool)
    pairs = {}
    for i in range(_TOP):
        if 0xD800 <= i < 0xE000 or (0xAC00 <= i <= 0xD7A3) or 0xE000 <= i < 0xF900 or 0xF0000 <= i:
            continue
        c = chr(i)
        cat = unicodedata.category(c)
        if cat == "Cn":
            continue
        out = _expansion(c)
        if out != c:
            length[i], offset[i] = len(out), _TOP + len(more)
            more.extend(map(ord, out))
        marks[i] = unicodedata.combining(c)
        pictographs[i] = cat == "So" and i > 0x2000
        d = unicodedata.decomposition(c)
        if d and d[0] != "<" and " " in d:
            a, b = (int(x, 16) for x in d.split())
            if unicodedata.normalize("NFC", chr(a) + chr(b)) == c:
                pairs[a << 21 | b] = i
    # letters that were replaced by look-alikes compose like the look-alike
    keys = np.array(sorted(pairs), np.int64)
    return length, offset, np.concatenate([*flat, np.array(more, np.uint32)]), marks, keys, np.array([pairs[k] for k in keys.tolist()], np.uint32), pictographs


def normalize_codes(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal form of many texts at once: ``codes`` are their code points, ``rows`` the text of each."""
    length, offset, flat, marks, keys, composed, pictographs = _tables()
    # joiners stay only between pictographs of one text
    joiner = codes == ZWJ
    if joiner.any():
        at = np.flatnonzero(joiner)
        left, right = np.maximum(at - 1, 0), np.minimum(at + 1, len(codes) - 1)
        keep = pictographs[codes[left]] & pictographs[codes[right]] & (rows[left] == rows[at]) & (rows[right] == rows[at]) & (at > 0) & (at < len(codes) - 1)
        drop = np.zeros(len(codes), bool)
        drop[at[~keep]] = True
        codes, rows = codes[~drop], rows[~drop]
    n = length[codes].astype(np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    start = np.repeat(offset[codes].astype(np.int64), n)
    within = np.arange(total) - np.repeat(ends - n, n)
    codes, rows = flat[start + within], np.repeat(rows, n)
    codes, rows = _ordered(codes, rows, marks)
    codes, rows = _composed(codes, rows, marks, keys, composed)
    return _line_ends(codes, rows)


def _ordered(codes: np.ndarray, rows: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order: runs of marks are sorted by their class, stably."""
    ccc = marks[codes]
    wrong = (ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (rows[1:] == rows[:-1])
    if not wrong.any():
        return codes, rows
    run = np.cumsum((ccc == 0) | np.concatenate([[True], rows[1:] != rows[:-1]]))
    order = np.lexsort((ccc, run))
    return codes[order], rows[order]


def _composed(codes: np.ndarray, rows: np.ndarray, marks: np.ndarray, keys: np.ndarray, composed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compose letters with the first mark that they can take, again and again."""
    while len(codes) > 1:
        ccc = marks[codes].astype(np.int64)
        index = np.arange(len(codes))
        new_row = np.concatenate([[True], rows[1:] != rows[:-1]])
        starter = np.maximum.accumulate(np.where((ccc == 0) | new_row, index, 0))
        before = np.concatenate([[0], starter[:-1]])  # the starter that precedes each position
        prev = np.concatenate([[0], index[:-1]])
        adjacent = before == prev
        blocked = ~adjacent & ((ccc[prev] >= ccc) | (ccc == 0))
        # only positions that could compose at all are looked up
        maybe = np.flatnonzero(~new_row & ~blocked & ((ccc > 0) | (codes >= 0x0900)) & (ccc[before] == 0))
        if not len(maybe):
            break
        a, b = codes[before[maybe]].astype(np.int64), codes[maybe].astype(np.int64)
        wanted = a << 21 | b
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        result = np.where(keys[at] == wanted, composed[at], 0).astype(np.int64)
        lv = (a >= _L) & (a < _L + 19) & (b >= _V) & (b < _V + 21)
        result = np.where(lv, _S + ((a - _L) * 21 + (b - _V)) * 28, result)
        lvt = (a >= _S) & (a < _S + 11172) & ((a - _S) % 28 == 0) & (b > _T) & (b < _T + 28)
        result = np.where(lvt, a + (b - _T), result)
        hit = result > 0
        if not hit.any():
            break
        where, what = maybe[hit], result[hit]
        target = before[where]
        first = np.concatenate([[True], target[1:] != target[:-1]])
        # a starter that is itself taken by the one before it waits for the next round
        taken = np.zeros(len(codes), bool)
        taken[where[first]] = True
        free = ~taken[target[first]]
        where, what, target = where[first][free], what[first][free], target[first][free]
        codes = codes.copy()
        codes[target] = what
        keep = np.ones(len(codes), bool)
        keep[where] = False
        codes, rows = codes[keep], rows[keep]
    return codes, rows


def _line_ends(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CR LF, CR and the separators become LF; blanks before a line end or the end of a text go."""
    if not len(codes):
        return codes, rows
    same_next = np.concatenate([rows[1:] == rows[:-1], [False]])
    following = np.concatenate([codes[1:], [0]])
    crlf = (codes == 13) & same_next & (following == 10)
    codes = np.where(np.isin(codes, (13, 0x85, 0x2028, 0x2029)), 10, codes)[~crlf]
    rows = rows[~crlf]
    blank = (codes == 32) | (codes == 9) | (codes == 11) | (codes == 12)
    # distance to the next visible character decides: a run of blanks that ends in LF or the text's end
    n = len(codes)
    index = np.arange(n)
    solid = np.where(~blank, index, n)
    nxt = np.minimum.accumulate(solid[::-1])[::-1]
    safe = np.minimum(nxt, n - 1)
    ends = (nxt == n) | (rows[safe] != rows) | (codes[safe] == 10)
    keep = ~(blank & ends)
    codes, rows = codes[keep], rows[keep]
    # line ends that end a text
    visible = codes != 10
    n = len(codes)
    nxt = np.minimum.accumulate(np.where(visible, np.arange(n), n)[::-1])[::-1]
    safe = np.minimum(nxt, max(n - 1, 0))
    keep = visible | ((nxt < n) & (rows[safe] == rows)) if n else visible
    return codes[keep], rows[keep]


def normalize_array(texts: pa.Array) -> pa.Array:
    """Normal form of an Arrow array of strings; nulls stay null. Work goes in runs of about ``RUN`` bytes, a longer text alone."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return texts
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes) // RUN
    bounds = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
    return pa.concat_arrays([_normalize_run(texts.slice(a, b - a)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])


def _normalize_run(texts: pa.Array) -> pa.Array:
    filled = texts.fill_null("")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    starts = (raw & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(starts)])
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    sizes = np.diff(chars[offsets - offsets[0]])
    rows = np.repeat(np.arange(len(texts)), sizes)
    codes, rows = normalize_codes(codes, rows)
    out_sizes = np.bincount(rows, minlength=len(texts))
    blob = codes.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    out_raw = np.frombuffer(blob, np.uint8)
    first_bytes = np.append(np.flatnonzero((out_raw & 0xC0) != 0x80), len(out_raw))
    out_offsets = first_bytes[np.concatenate([[0], np.cumsum(out_sizes)])].astype(np.int64)
    joined = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(out_offsets.tobytes()), pa.py_buffer(blob))
    if texts.null_count:
        return pc.if_else(texts.is_valid(), joined, pa.scalar(None, pa.large_string()))
    return joined


def normalized(documents: DataFrame) -> DataFrame:
    """(doc_id, text, form)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            form = normalize_array(text).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), text.cast(pa.string()), form], ["doc_id", "text", "form"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, form string")


def lookalikes(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): texts that differ in characters and have one form; texts without a visible character are none.

    Copies are grouped by 128-bit hashes of the form. Only different texts of a form are paired, and rows are
    attached to the pairs of texts, so equal texts of a hot form never meet.
    """
    visible = normalized(documents).where(r"form rlike '(?U)[^\\s\\p{C}]'")
    hashes = cut(visible.select("doc_id", F.md5(F.col("form").cast("binary")).alias("form"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(5), "text").alias("t2")))
    texts = cut(hashes.groupBy("form", "t1", "t2").agg(F.lit(1).alias("one")).drop("one"))
    a, b = (texts.select("form", F.col("t1").alias(f"{k}1"), F.col("t2").alias(f"{k}2")) for k in "ab")
    pairs = a.join(b, "form").where("a1 < b1 or (a1 = b1 and a2 < b2)")
    for k in "ab":
        pairs = pairs.join(hashes.select("form", F.col("t1").alias(f"{k}1"), F.col("t2").alias(f"{k}2"), F.col("doc_id").alias(f"id_{k}")), ["form", f"{k}1", f"{k}2"])
    return pairs.select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b")).where("doc_id_a < doc_id_b").distinct()


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, form_id, texts, documents): each document with its visual class, the texts in it and its size."""
    hashes = normalized(documents).where("form is not null").select("doc_id", F.md5(F.col("form").cast("binary")).alias("form_id"), F.xxhash64("text").alias("t"))
    hashes = cut(hashes)
    per_text = hashes.groupBy("form_id", "t").agg(F.count("*").alias("n"))
    sizes = per_text.groupBy("form_id").agg(F.count("*").alias("texts"), F.sum("n").alias("documents"))
    return hashes.join(sizes, "form_id").select("doc_id", "form_id", "texts", "documents")
