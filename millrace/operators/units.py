"""Quantities recorded in different units (problem 6).

A value is read from ``answer_value`` (any notation, with words and powers of ten that scale it) and its
unit from the first field that states one: ``answer_value``, ``answer_unit``, ``specified_answer_unit``,
or the unit that ``question`` asks for. Stated units convert directly.

Where no field states a unit, a log-scale mixture assigns one: per dimension, the logarithms of values in
common units follow one density, so a unit shows as a component offset by the logarithm of its known
factor (of a unit with a shift, by the logarithm of the shifted value, with the change of scale that
goes with it). Weights and density are fitted by expectation-maximization on histograms of the
logarithms (bounded tables: dimensions x signs x cells), starting from the stated rows; the density is a
smoothed histogram, since a normal one is far too sure where values spread evenly over many decades.
The unit with the highest posterior is assigned, and values below ``SURE`` are flagged uncertain.
The dimension of such a row comes from how its question asks, learned from the rows with stated units.

Defined cases: a row without an id is no record; null or unreadable values and non-finite results give no number (status ``no_value``); a
count or ratio has status ``no_unit``; a zero cannot be put on a log scale, and a negative value only in a unit with
a shift: else they are only converted where the unit is stated; conflicting units: the field nearest the value holds.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.runtime import bounded_rows, cut

# The spellings of the units, without case, blanks, points, hyphens and powers signs.
SPELLINGS = {
    "metre": "m metre meter metres meters mtr",
    "kilometre": "km kms kilometre kilometer kilometres kilometers",
    "centimetre": "cm cms centimetre centimeter centimetres centimeters",
    "millimetre": "mm mms millimetre millimeter millimetres millimeters",
    "mile": "mi mile miles statutemile statutemiles",
    "foot": "ft foot feet",
    "inch": "in inch inches",
    "yard": "yd yds yard yards",
    "nautical_mile": "nmi nauticalmile nauticalmiles",
    "kilogram": "kg kgs kilogram kilograms kilogramme kilogrammes kilo kilos",
    "gram": "g gm gms gram grams gramme grammes",
    "milligram": "mg mgs milligram milligrams milligramme milligrammes",
    "tonne": "t tonne tonnes metricton metrictons metrictonne metrictonnes",
    "pound": "lb lbs pound pounds",
    "ounce": "oz ounce ounces",
    "short_ton": "shortton shorttons usshortton usshorttons uston ustons",
    "second": "s sec secs second seconds",
    "millisecond": "ms msec msecs millisecond milliseconds",
    "minute": "min mins minute minutes",
    "hour": "h hr hrs hour hours",
    "day": "d day days",
    "week": "wk wks week weeks",
    "year": "yr yrs year years",
    "cubic_metre": "m3 cum cubicmetre cubicmeter cubicmetres cubicmeters",
    "litre": "l ltr ltrs litre liter litres liters",
    "millilitre": "ml mls millilitre milliliter millilitres milliliters",
    "us_gallon": "gal gals gallon gallons usgal usgallon usgallons",
    "cubic_foot": "ft3 cuft cubicfoot cubicfeet",
    "cubic_kilometre": "km3 cukm cubickilometre cubickilometer cubickilometres cubickilometers",
    "square_metre": "m2 sqm squaremetre squaremeter squaremetres squaremeters",
    "square_kilometre": "km2 sqkm squarekilometre squarekilometer squarekilometres squarekilometers",
    "hectare": "ha hectare hectares",
    "acre": "ac acre acres",
    "square_foot": "ft2 sqft squarefoot squarefeet",
    "square_mile": "mi2 sqmi squaremile squaremiles",
    "metre_per_second": "m/s m/sec ms1 mps metrepersecond meterpersecond metrespersecond meterspersecond",
    "kilometre_per_hour": "km/h km/hr kmh kmph kph kmh1 kilometreperhour kilometerperhour kilometresperhour kilometersperhour",
    "mile_per_hour": "mi/h mi/hr mph mileperhour milesperhour",
    "foot_per_second": "ft/s ft/sec fts1 fps footpersecond feetpersecond",
    "joule": "j joule joules",
    "kilojoule": "kj kilojoule kilojoules",
    "megajoule": "mj megajoule megajoules",
    "kilowatt_hour": "kwh kwhr kilowatthour kilowatthours",
    "kilocalorie": "kcal kcals kilocalorie kilocalories",
    "electronvolt": "ev electronvolt electronvolts",
    "watt": "w watt watts",
    "kilowatt": "kw kilowatt kilowatts",
    "megawatt": "mw megawatt megawatts",
    "horsepower": "hp horsepower",
    "kelvin": "k kelvin kelvins degreeskelvin",
    "celsius": "c °c ℃ celsius degc degcelsius degreecelsius degreescelsius centigrade",
    "fahrenheit": "f °f ℉ fahrenheit degf degfahrenheit degreefahrenheit degreesfahrenheit",
    "pascal": "pa pascal pascals",
    "kilopascal": "kpa kilopascal kilopascals",
    "bar": "bar bars",
    "atmosphere": "atm atms atmosphere atmospheres",
    "psi": "psi lb/in2 lbs/in2 lbf/in2 poundpersquareinch poundspersquareinch",
    "byte": "b byte bytes",
    "kilobyte": "kb kilobyte kilobytes",
    "megabyte": "mb meg megs megabyte megabytes",
    "gigabyte": "gb gig gigs gigabyte gigabytes",
    "terabyte": "tb terabyte terabytes",
}
# Words that scale.
SCALES = {"hundred": 2, "thousand": 3, "thousands": 3, "million": 6, "millions": 6, "billion": 9, "billions": 9, "trillion": 12, "trillions": 12, "quadrillion": 15}
SURE = 0.9
#: Cells a decade of the histogram of logarithms.
CELLS = 20

UNIT_OF = {form: name for name, forms in SPELLINGS.items() for form in forms.split()}
_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
_NUM = r"[-+−]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?|\.\d+)"
_POWER = r"(\d+)(?:\s*(?:\^|\*\*)\s*[({]?\s*([-+−]?\d+)\s*[)}]?|([⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+))"
_VALUE = re.compile(rf"(?P<n>{_NUM})(?:[eE](?P<e>[-+−]?\d+))?(?:\s*(?:[x×*·]|\\times)\s*{_POWER})?(?:\s*/\s*(?P<d>{_NUM})(?:[eE](?P<de>[-+]?\d+))?)?")
_PURE_POWER = re.compile(_POWER)
_ABOUT = re.compile(r"^(?:about|approximately|approx\.?|around|roughly|circa|ca\.|nearly|some|~|≈|≃|∼|=|\s)+", re.I)
_SCALE = re.compile(r"^\s*(" + "|".join(SCALES) + r")\b\.?", re.I)


def unit_key(text: str) -> str:
    """A spelling without case, blanks, points, hyphens and signs of powers."""
    return re.sub(r"[\s.\-·⋅^*_‐‑−]+", "", unicodedata.normalize("NFKC", text.replace("℃", "°C").replace("℉", "°F")).casefold())


def scaled_unit(text: str) -> tuple[float, str] | None:
    """(scale, canonical unit) of a text that is nothing but a unit, with words or powers of ten before it."""
    rest, scale = text.strip().strip("\"'()[]").strip(), 1.0
    for _ in range(3):
        if m := _SCALE.match(rest):
            scale *= 10.0 ** SCALES[m[1].lower()]
            rest = rest[m.end() :].strip()
            rest = re.sub(r"^of\s+", "", rest, flags=re.I)
        elif m := _PURE_POWER.match(rest):
            scale *= _power(m)
            rest = rest[m.end() :].strip().lstrip("x×*·").strip()
        else:
            break
    unit = UNIT_OF.get(unit_key(rest))
    return (scale, unit) if unit else None


def _power(m: re.Match, at: int = 1) -> float:
    """Value of a base (almost always 10) with its exponent."""
    exponent = int((m[at + 1] or m[at + 2].translate(_SUPER)).replace("−", "-"))
    return float(f"1e{exponent}") if m[at] == "10" else float(m[at]) ** exponent


def _float(text: str) -> float:
    text = text.replace("−", "-")
    if re.fullmatch(r"[-+]?\d{1,3}(,\d{3})+(\.\d+)?", text):
        return float(text.replace(",", ""))
    return float(text.replace(",", "."))


def read_value(text: str | None) -> tuple[float | None, str | None, str]:
    """(number, unit stated in the text or None, rest that is not understood)."""
    if text is None:
        return None, None, ""
    s = re.sub(r"\s+", " ", text).strip().strip("\"'“”`$").strip()
    s = _ABOUT.sub("", s)
    if m := _VALUE.match(s):
        value = _float(m["n"])
        power = int((m["e"] or "0").replace("−", "-"))
        if m[3] == "10":
            power += int((m[4] or m[5].translate(_SUPER)).replace("−", "-"))
        elif m[3]:
            value *= _power(m, 3)
        if m["d"]:
            below = _float(m["d"]) * 10.0 ** int(m["de"] or 0)
            if below == 0:
                return None, None, s
            value /= below
        rest = s[m.end() :]
        if (p := _PURE_POWER.match(s)) and p.end() > m.end():
            value, power, rest = _power(p), 0, s[p.end() :]
    else:
        return None, None, s
    while m := _SCALE.match(rest):
        power += SCALES[m[1].lower()]
        rest = re.sub(r"^\s*of\s+", "", rest[m.end() :], flags=re.I)
    if abs(power) > 400:
        return None, None, s
    try:
        value = float(f"{value!r}e{power}") if "e" not in repr(value) else value * 10.0**power
    except OverflowError:
        return None, None, s
    rest = rest.strip()
    if not rest:
        return value, None, ""
    unit = scaled_unit(rest)
    if unit is None:
        return value, None, rest
    return value * unit[0], unit[1], ""


_ASKED_END = re.compile(r"[(\[]\s*(?:in\s+)?([^()\[\]]{1,60})[)\]]\W*$")
_ASKED_IN = re.compile(r"\b(?:give|express|state|report|write|provide|answer|round|quote|put|enter)\b[^.?!]{0,60}?\b(?:in|as)\s+([^.?!;:,]{1,60}?)\s*[^\w²³°]*$", re.I)
_ASKED_LAST = re.compile(r"\b(?:in|as)\s+((?:\S+\s+){0,4}\S+?)\s*[^\w²³°]*$", re.I)
_ASKED_FIRST = re.compile(r"(?:^|[.?!;:—…]\s*|\s)in\s+([^\W\d][^,;:?!—]{0,40}?|°[CFK])\s*[,;:—]?\s+(?:what|how|find|estimate)\b", re.I)
_HOW_MANY = re.compile(r"\bhow\s+many\s+((?:\S+\s+){0,4}\S+)", re.I)


def asked_unit(question: str | None) -> tuple[float, str] | None:
    """The unit a question asks for; units of other numbers in it don't count."""
    if not question:
        return None
    q = re.sub(r"\s+", " ", question).strip()
    for pattern in (_ASKED_END, _ASKED_IN, _ASKED_LAST):
        if (m := pattern.search(q)) and (u := scaled_unit(re.sub(r"^(?:the\s+)?(?:units?\s+of\s+)", "", m[1], flags=re.I))):
            return u
    # without sentence marks the unit may end the text after the last "in"
    words = q.rstrip(" .?!\"'”»)]").split(" ")
    for n in (1, 2, 3, 4):
        if len(words) > n and words[-n - 1].lower().strip("(,;:—") == "in" and (u := scaled_unit(" ".join(words[-n:]))):
            return u
    for m in _ASKED_FIRST.finditer(q):
        tail = m[1].split(" ")
        for n in range(len(tail)):
            if u := scaled_unit(" ".join(tail[n:])):
                return u
    for m in _HOW_MANY.finditer(q.casefold()):
        words = m[1].split(" ")
        for n in range(min(5, len(words)), 0, -1):
            if words[n : n + 1] != ["hand"] and (u := scaled_unit(" ".join(words[:n]).rstrip(",.;:?!)"))):
                return u
    return None


def ask_phrase(question: str | None) -> str:
    """How a question asks: its words from the last question word on, without names and numbers; short on purpose."""
    q = re.sub(r"[^\w\s]+", " ", (question or "").casefold())
    words = q.split()
    at = max((i for i, w in enumerate(words) if w in ("what", "how", "which")), default=None)
    return " ".join(words[at : at + 4]) if at is not None else ""


PARSED = "id long, value double, unit string, stated_in string, phrase string"


def parsed(records: DataFrame) -> DataFrame:
    """(id, value, unit, stated_in, phrase); ``records`` has (id, question, answer_value, answer_unit, specified_answer_unit)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, q, v, u, s in zip(b["id"], b["question"], b["answer_value"], b["answer_unit"], b["specified_answer_unit"]):
                value, unit, rest = read_value(v)
                where = "answer_value" if unit else None
                if value is not None and not unit and not rest:
                    for field, text in (("answer_unit", u), ("specified_answer_unit", s)):
                        if text and (found := scaled_unit(text)):
                            value, unit, where = value * found[0], found[1], field
                            break
                    else:
                        if found := asked_unit(q):
                            value, unit, where = value * found[0], found[1], "question"
                if rest and not unit:
                    value = None
                out.append((i, value, unit, where, ask_phrase(q)))
            yield pd.DataFrame(out, columns=["id", "value", "unit", "stated_in", "phrase"])

    return records.where("id is not null").select("id", "question", "answer_value", "answer_unit", "specified_answer_unit").mapInPandas(run, PARSED)


def common_logs(values: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each value in common units for each unit, and the logarithm of the density's change of scale; -inf where there is none."""
    common = values[:, None] * factors[None, :] + shifts[None, :]
    ok = common > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(ok, np.log10(np.where(ok, common, 1)), 0)
        scale = np.where(ok, np.log(np.abs(values[:, None] * factors[None, :]) / np.where(ok, common, 1)), -np.inf)
    return x, scale


def smoothed(hist: np.ndarray) -> np.ndarray:
    """A density over cells from their counts: a normal kernel of a width that shrinks with the counts, and a wide normal floor."""
    n, at = hist.sum(), np.arange(len(hist))
    mean = (hist * at).sum() / n
    sd = max(math.sqrt((hist * (at - mean) ** 2).sum() / n), 1.0)
    width = min(max(0.9 * sd * n**-0.2, 1.0), float(CELLS))
    kernel = np.exp(-0.5 * (np.arange(-math.ceil(4 * width), math.ceil(4 * width) + 1) / width) ** 2)
    body = np.convolve(hist, kernel / kernel.sum(), "same") if len(hist) >= len(kernel) else np.convolve(hist, kernel / kernel.sum())[len(kernel) // 2 :][: len(hist)]
    floor = np.exp(-0.5 * ((at - mean) / (2 * sd)) ** 2)
    return 0.99 * body / body.sum() + 0.01 * floor / floor.sum()


def fit_mixture(values: np.ndarray, counts: np.ndarray, factors: np.ndarray, shifts: np.ndarray, known: dict[int, float], stated: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, int, np.ndarray]:
    """Weights of the units, first cell and density of log10 of common values, by EM over a histogram of values.

    ``known`` has the cells of the values whose unit is stated, which anchor the density. ``stated`` counts the stated
    rows of each unit; they weigh as much as the rows without a unit, which alone hardly tell units apart where they spread far.
    """
    x, scale = common_logs(values, factors, shifts)
    usable = np.isfinite(scale).any(1)
    x, scale, counts = x[usable], np.exp(scale[usable]), counts[usable]
    cell = np.floor(x * CELLS).astype(np.int64)
    ends = [*known, *cell[scale > 0].tolist()] or [0]
    low, size = min(ends) - CELLS, max(ends) - min(ends) + 2 * CELLS + 1
    at = np.clip(cell - low, 0, size - 1)
    anchor = np.zeros(size)
    for c, n in known.items():
        anchor[c - low] += n
    pseudo = (stated + 1) / (stated + 1).sum() * max(len(factors), counts.sum())
    weight = pseudo / pseudo.sum()
    # without stated rows every unit is as likely at first
    first = np.bincount(at.ravel(), weights=((scale > 0) / np.maximum((scale > 0).sum(1, keepdims=True), 1) * counts[:, None]).ravel(), minlength=size) if len(x) else np.zeros(size)
    density = smoothed(anchor if anchor.any() else first if first.any() else np.ones(size))
    for _ in range(rounds if len(x) else 0):
        post = weight * scale * density[at]
        post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
        mass = post * counts[:, None]
        new = (mass.sum(0) + pseudo) / (mass.sum() + pseudo.sum())
        density = smoothed(anchor + np.bincount(at.ravel(), weights=mass.ravel(), minlength=size))
        done = np.abs(new - weight).max() < 1e-9
        weight = new
        if done:
            break
    return weight, low, density


def unit_table(spark: SparkSession, defs: dict) -> DataFrame:
    """(unit, dimension, common_unit, factor, shift) of the definitions, a checked number of rows."""
    rows = [(n, r["dimension"], r["common_unit"], float(r["factor"]), float(r["shift"])) for n, r in defs.items()]
    return F.broadcast(spark.createDataFrame(rows, "unit string, dimension string, common_unit string, factor double, shift double"))


def unit_rows(unit_defs: DataFrame) -> dict:
    """The definitions by unit; without a factor a unit is none, without a shift it has none."""
    rows = bounded_rows(unit_defs.where("unit_name is not null and factor is not null").withColumn("shift", F.coalesce("shift", F.lit(0.0))), 10_000, "units")
    return {r["unit_name"]: r for r in rows}


QUANTITY = "id long, dimension string, common_unit string, common_value double, unit string, stated_in string, status string, posterior double"


def converted(read: DataFrame, defs: dict) -> DataFrame:
    """``QUANTITY`` rows of those that state a unit; they need no model."""
    common = F.col("value") * F.col("factor") + F.col("shift")
    return read.join(unit_table(read.sparkSession, defs), "unit").select("id", "dimension", "common_unit", common.alias("common_value"), "unit", "stated_in", F.lit("stated").alias("status"), F.lit(1.0).alias("posterior"))


def common_quantities(records: DataFrame, unit_defs: DataFrame) -> DataFrame:
    """(id, dimension, common_unit, common_value double, unit, stated_in, status, posterior).

    status: ``stated``, ``assigned`` (posterior at least ``SURE``), ``uncertain``, ``no_unit``, ``no_value``.
    """
    defs = unit_rows(unit_defs)
    read = cut(parsed(records))
    return converted(read, defs).unionByName(assigned(read, defs))


def assigned(read: DataFrame, defs: dict) -> DataFrame:
    """``QUANTITY`` rows of those that state no unit, by the mixture of their dimension."""
    spark = read.sparkSession
    direct = read.join(unit_table(spark, defs), "unit")
    common = F.col("value") * F.col("factor") + F.col("shift")
    # how each dimension is asked for: the most frequent dimension of a phrase, if it is clear
    asked = direct.groupBy("phrase", "dimension").agg(F.count("*").alias("n"))
    asked = asked.groupBy("phrase").agg(F.max_by("dimension", F.struct("n", "dimension")).alias("guess"), F.max("n").alias("most"), F.sum("n").alias("all"))
    asked = asked.where("most >= 0.8 * all and most >= 5 and phrase <> ''").select("phrase", "guess")
    missing = cut(read.where("unit is null").join(asked, "phrase", "left"))
    usable = missing.where("value <> 0 and value <> 'NaN' and abs(value) <> 'Infinity' and guess is not null")
    cell = F.floor(F.log10(F.abs("value")) * CELLS)
    cells: dict[str, list[tuple[float, int]]] = {}
    for r in bounded_rows(usable.groupBy("guess", F.signum("value").alias("sign"), cell.alias("cell")).agg(F.count("*").alias("n")), 1_000_000, "cells of logarithms"):
        cells.setdefault(r["guess"], []).append((r["sign"] * 10 ** ((r["cell"] + 0.5) / CELLS), r["n"]))
    logged = direct.where(common > 0).groupBy("dimension", F.floor(F.log10(common) * CELLS).alias("cell")).agg(F.count("*").alias("n"))
    anchors: dict[str, dict[int, float]] = {}
    for r in bounded_rows(logged, 1_000_000, "cells of stated values"):
        anchors.setdefault(r["dimension"], {})[r["cell"]] = float(r["n"])
    often = {r["unit"]: r["n"] for r in bounded_rows(direct.groupBy("unit").agg(F.count("*").alias("n")), 10_000, "units")}
    models = []
    for dimension, rows in sorted(cells.items()):
        units = [(n, r) for n, r in sorted(defs.items()) if r["dimension"] == dimension]
        factors, shifts = (np.array([float(r[k]) for _, r in units]) for k in ("factor", "shift"))
        weight, low, density = fit_mixture(np.array([v for v, _ in rows]), np.array([n for _, n in rows], float), factors, shifts, anchors.get(dimension, {}), np.array([often.get(n, 0) for n, _ in units], float))
        models.append((dimension, [(n, r["common_unit"], float(r["factor"]), float(r["shift"]), float(w)) for (n, r), w in zip(units, weight)], low, density.tolist()))
    # a row per dimension, of at most 10,000 units in all and cells of the range of doubles
    model = spark.createDataFrame(models, "guess string, units array<struct<unit: string, common_unit: string, factor: double, shift: double, weight: double>>, low long, density array<double>")

    def scored_unit(u: F.Column) -> F.Column:
        c = F.col("value") * u["factor"] + u["shift"]
        at = (F.floor(F.log10(c) * CELLS) - F.col("low")).cast("int")
        density = u["weight"] * F.abs(F.col("value") * u["factor"]) / c * F.coalesce(F.get("density", at), F.lit(0.0))
        return F.struct(F.when(c > 0, density).otherwise(0.0).alias("d"), u["unit"].alias("unit"), u["common_unit"].alias("common_unit"), c.alias("common_value"))

    scored = usable.join(F.broadcast(model), "guess").withColumn("d", F.transform("units", scored_unit)).withColumn("best", F.array_max("d"))
    total = F.aggregate("d", F.lit(0.0), lambda a, p: a + p["d"])
    posterior = F.coalesce(F.try_divide(F.col("best.d"), total), F.lit(0.0))
    none = lambda t: F.lit(None).cast(t)
    fits = F.col("best.d") > 0  # else no unit gives the value a density, as of a negative one without a shifted unit
    given = scored.select("id", F.col("guess").alias("dimension"), F.when(fits, F.col("best.common_unit")).alias("common_unit"), F.when(fits, F.col("best.common_value")).alias("common_value"), F.when(fits, F.col("best.unit")).alias("unit"), none("string").alias("stated_in"), F.when(posterior >= SURE, "assigned").otherwise("uncertain").alias("status"), posterior.alias("posterior"))
    rest = missing.where("value is null or value = 0 or value = 'NaN' or abs(value) = 'Infinity' or guess is null")
    rest = rest.select("id", F.col("guess").alias("dimension"), none("string").alias("common_unit"), none("double").alias("common_value"), none("string").alias("unit"), none("string").alias("stated_in"), F.when(F.col("value").isNull(), "no_value").when(F.col("guess").isNull(), "no_unit").otherwise("uncertain").alias("status"), none("double").alias("posterior"))
    return given.unionByName(rest)


def problem_records(problems: DataFrame) -> DataFrame:
    return problems.select(F.col("problem_id").alias("id"), "question", "answer_value", "answer_unit", "specified_answer_unit")


def scientific(value: F.Column) -> F.Column:
    """Four significant digits, such as 1.609e+03 (``printf``'s form)."""
    return F.format_string("%.3e", value)


def stated_quantities(problems: DataFrame, unit_defs: DataFrame) -> DataFrame:
    """(problem_id, common_unit, common_value): rows whose unit is stated, as text of four digits."""
    rows = converted(parsed(problem_records(problems)), unit_rows(unit_defs))
    return rows.select(F.col("id").alias("problem_id"), "common_unit", scientific(F.col("common_value")).alias("common_value"))
