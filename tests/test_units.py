"""Values, units and the mixture for missing units."""

import random

import numpy as np
import pytest

from millrace.operators import units

RECORD = "problem_id long, question string, answer_value string, answer_unit string, specified_answer_unit string"
DEFS = [("length", "metre", "metre", 1.0, 0.0), ("length", "metre", "kilometre", 1000.0, 0.0), ("length", "metre", "foot", 0.3048, 0.0), ("temperature", "kelvin", "fahrenheit", 5 / 9, 255.372222), ("time", "second", "second", 1.0, 0.0), ("time", "second", "day", 86400.0, 0.0)]


@pytest.mark.parametrize(
    ("text", "value", "unit"),
    [
        ("1,234.5", 1234.5, None), ("1e-3", 1e-3, None), ("2.39*10^14", 2.39e14, None), ("1.5 x 10^-4 km", 1.5e-4, "kilometre"), ("≈ 30.9 kW h", 30.9, "kilowatt_hour"), ("1.27×10⁻⁴", 1.27e-4, None),
        ('"54 thousand"', 54e3, None), ("\t462\n", 462, None), ("3/7 days", 3 / 7, "day"), ("approx. 1.7 million kilobytes", 1.7e6, "kilobyte"), ("-9", -9, None), ("10^6", 1e6, None), ("about 391kelvin", 391, "kelvin"),
        ("5 m s^-1", 5, "metre_per_second"), ("1210 F", 1210, "fahrenheit"), ("4 10^3 feet", 4e3, "foot"), ("8.9 x 70^3", 8.9 * 70**3, None),
    ],
)
def test_values(text, value, unit):
    got = units.read_value(text)
    assert got[0] == pytest.approx(value, rel=1e-12) and got[1] == unit and got[2] == ""


def test_unreadable_values():
    assert units.read_value(None)[0] is None and units.read_value("many")[0] is None and units.read_value("3/0")[0] is None and units.read_value("5 blorps")[2] == "blorps"
    assert units.read_value("1e999")[0] is None


@pytest.mark.parametrize(
    ("question", "unit"),
    [
        ("How heavy is it? Give the result in pounds per square inch.", "psi"), ("In °F, what temperature does it reach?", "fahrenheit"), ("in mi., how long is it?", "mile"), ("HOW LONG IS IT? (INCHES)", "inch"), ("What volume fits, in cubic metres?»", "cubic_metre"),
        ("A cart runs at 3 km/h. How many square miles describe it?", "square_mile"), ("It weighs 3 kg. How many second-hand gears are there?", None), ("How many second hand ladders?", None), ("It lies 5 km from here. What is the ratio?", None), (None, None), ("", None),
    ],
)
def test_asked_units(question, unit):
    assert (units.asked_unit(question) or (1.0, None))[1] == unit


def test_stated_quantities(spark):
    rows = [(1, "How far?", "2 km", "ft", None), (2, "How far?", "2", "thousand ft", None), (3, "How far?", "2 thousand", None, "kilometres"), (4, "How hot? (°F)", "100", "", ""), (5, "How many gears?", "7", None, None), (6, "How far? (feet)", None, None, None), (7, None, "1 day", None, None), (None, "q", "1 day", None, None), (8, "x " * 200_000 + "in feet?", "1", None, None), (9, "q", "5 blorps", "m", None)]
    problems = spark.createDataFrame([(*r, 0, 0) for r in rows], RECORD + ", unit int, value int")
    defs = spark.createDataFrame(DEFS, "dimension string, common_unit string, unit_name string, factor double, shift double")
    got = {r["problem_id"]: (r["common_unit"], r["common_value"]) for r in units.stated_quantities(problems, defs).collect()}
    assert got == {1: ("metre", "2.000e+03"), 2: ("metre", "6.096e+02"), 3: ("metre", "2.000e+06"), 4: ("kelvin", "3.109e+02"), 7: ("second", "8.640e+04"), 8: ("metre", "3.048e-01")}
    assert units.stated_quantities(problems.limit(0), defs).count() == 0


def test_missing_units_are_assigned_on_the_log_scale(spark):
    rng = random.Random(1)
    rows, truth = [], {}
    for i in range(900):
        metres = rng.lognormvariate(0, 0.4)
        unit = rng.choice(["metre", "kilometre"])
        value = metres / (1000 if unit == "kilometre" else 1)
        stated = i % 3 == 0
        rows.append((i, "How long is it?", f"{value:.6g}", {"metre": "m", "kilometre": "km"}[unit] if stated else None, None))
        truth[i] = (unit, stated)
    rows.append((2000, "How long is it?", "-3", None, None))
    defs = spark.createDataFrame([d for d in DEFS if d[2] in ("metre", "kilometre")], "dimension string, common_unit string, unit_name string, factor double, shift double")
    out = units.common_quantities(units.problem_records(spark.createDataFrame(rows, RECORD)), defs).collect()
    mine = {r["id"]: r for r in out}
    assert len(out) == 901 and mine[2000]["status"] == "uncertain"
    free = [i for i, (_, stated) in truth.items() if not stated]
    assert all(mine[i]["status"] == "assigned" for i in free)
    assert np.mean([mine[i]["unit"] == truth[i][0] for i in free]) > 0.99


def test_every_unit_has_spellings(spark, sf):
    names = {r["unit_name"] for r in spark.read.parquet(f"{sf}/unit_defs.parquet").collect()}
    assert names == set(units.SPELLINGS)


def test_a_unit_with_a_shift_is_told_from_its_scale(spark):
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(900):
        kelvin = rng.uniform(230, 320)
        unit = rng.choice(["kelvin", "celsius"])
        value = kelvin - (273.15 if unit == "celsius" else 0)
        stated = i % 3 == 0
        rows.append((i, "How hot is it?", f"{value:.4f}", {"kelvin": "K", "celsius": "°C"}[unit] if stated else None, None))
        truth[i] = (unit, stated)
    rows.append((2000, "How hot is it?", "0", None, None))
    defs = spark.createDataFrame([("temperature", "kelvin", "kelvin", 1.0, 0.0), ("temperature", "kelvin", "celsius", 1.0, 273.15), ("temperature", "kelvin", "void", None, 0.0)], "dimension string, common_unit string, unit_name string, factor double, shift double")
    mine = {r["id"]: r for r in units.common_quantities(units.problem_records(spark.createDataFrame(rows, RECORD)), defs).collect()}
    free = [i for i, (_, stated) in truth.items() if not stated]
    assert np.mean([mine[i]["status"] == "assigned" and mine[i]["unit"] == truth[i][0] for i in free]) > 0.97
    assert all(230 < mine[i]["common_value"] < 320 for i in free if mine[i]["unit"] == truth[i][0]) and mine[2000]["status"] == "uncertain"


def test_hidden_units_of_the_tables(spark, sf):
    """Units of a fifth of the stated rows are hidden; the assigned ones must be right, and the uncertain ones flagged."""
    from pyspark.sql import functions as F

    folder = sf.replace("sf0.001", "sf0.1")
    problems, defs = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("problems", "unit_defs"))
    table = units.unit_rows(defs)
    read = units.parsed(units.problem_records(problems)).collect()
    shape = units.PARSED
    hidden = {r["id"]: table[r["unit"]] for r in read if r["unit"] and r["id"] % 5 == 0}
    masked = spark.createDataFrame([(r["id"], r["value"], None if r["id"] in hidden else r["unit"], r["stated_in"], r["phrase"]) for r in read], shape)
    out = [r for r in units.assigned(masked, table).where(F.col("id").isin(list(hidden))).collect()]
    sure = [r for r in out if r["status"] == "assigned" and r["dimension"] == hidden[r["id"]]["dimension"]]
    assert len(out) == len(hidden) and len(sure) < len(out) / 2
    assert sum(r["unit"] == hidden[r["id"]]["unit_name"] for r in sure) >= 0.9 * len(sure)


def test_audit_of_rows_against_the_published_one(spark, sf):
    import __spark_entry__ as entry

    folder = sf.replace("sf0.001", "sf0.01")
    published = {r["problem_id"]: r["unit_classification"] for r in spark.read.parquet(f"{folder}/problems.parquet").collect()}
    got = entry.queries()["k25_unit_audit"](spark, folder).collect()
    assert len(got) == len(published) and sum(r["row_classification"] == published[r["problem_id"]] for r in got) >= 0.98 * len(got)
    kinds = {"unit_not_needed", "unit_required_but_unspecified"}
    assert {r["row_classification"] for r in got} == {published[i] for i in published} and all(published[r["problem_id"]] == r["row_classification"] for r in got if r["classification"] == "unit_not_needed" and r["row_classification"] in kinds)
