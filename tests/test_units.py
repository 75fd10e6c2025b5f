"""Unit expressions as vectors and factors; ranges across units."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from metrolex import data
from metrolex.functions import units
from metrolex.plans.oracle import MEASURES


def _measures(spark, names):
    df = spark.createDataFrame([(u,) for u in names], "u string")
    return {r["u"]: r["m"] for r in df.select("u", units.measure(F.col("u")).alias("m")).collect()}


def test_every_known_unit_against_the_table(spark):
    """Same kind in the table written by hand, if and only if same vector; factors and zeros agree."""
    got = _measures(spark, [m[0] for m in MEASURES])
    assert {m[0] for m in MEASURES} >= set(data.distinct_terms("unit")) | {r[2] for r in data.PROPERTY_TABLE if r[2]}
    for a, b in itertools.combinations(MEASURES, 2):
        assert (a[1] == b[1]) == (got[a[0]]["dimension"] == got[b[0]]["dimension"]), (a, b)
    for name, _, k, zero in MEASURES:
        assert got[name]["factor"] == pytest.approx(k, rel=1e-8) and got[name]["zero"] == pytest.approx(zero, rel=1e-12), name


def test_products_of_powers_are_worked_out(spark):
    """Random products, written in several ways, against arithmetic."""
    r, atoms = random.Random(4), units.atoms()
    some = ["m", "cm", "kg", "s", "min", "mol", "K", "GPa", "kJ", "N", "mL", "Hz", "V", "S", "eV", "nm"]
    cases = {}
    for _ in range(150):
        up, down = ([(r.choice(some), r.choice([1, 1, 2, 3, 0.5])) for _ in range(r.randrange(n, 3))] for n in (1, 0))
        power = lambda p: "" if p == 1 else r.choice([f"^{p}", {2: "²", 3: "³", 0.5: "½"}[p]])
        text = "·".join(u + power(p) for u, p in up)
        if down:
            text += "/" + "·".join(u + power(p) for u, p in down) if r.random() < 0.5 else "".join(f" {u}^-{p}" if p != 0.5 else f" {u}^-0.5" for u, p in down)
        k, d = 1.0, [0.0] * len(units.DIMENSIONS)
        for u, p in up + [(u, -p) for u, p in down]:
            k *= atoms[u][0] ** p
            d = [x + p * y for x, y in zip(d, atoms[u][1])]
        cases[text] = (k, d)
    got = _measures(spark, list(cases))
    for text, (k, d) in cases.items():
        assert got[text] is not None and got[text]["factor"] == pytest.approx(k, rel=1e-9) and got[text]["dimension"] == pytest.approx(d), text


def test_what_is_no_unit(spark):
    got = _measures(spark, ["foo", "m/", "/s", "K^", "kJ//mol", "12", "m^x", "MPa MPa?", None, "", "  ", "1/s"])
    assert {u for u, m in got.items() if m is not None} == {None, "", "  ", "1/s"} and got[None]["factor"] == 1 and got["1/s"]["dimension"][2] == -1


def test_ranges_across_units(spark):
    rows = [(351.0, "K", 70.0, 80.0, "°C", True), (351.0, "°F", 70.0, 80.0, "°C", False), (0.5, "GPa", 200.0, 600.0, "MPa", True), (500.0, "GPa", 200.0, 600.0, "MPa", False), (1.0, "MPa", 0.0, 9e9, "K", None), (4.0, "GPa", 200.0, 4000.0, "MPa", True), (50.0, "%", 0.1, 0.5, None, True), (1.0, "foo", 0.0, 2.0, "foo", None), (1.0, "eV/atom", 96.0, 97.0, "kJ/mol", True), (-40.0, "°F", -40.0, -40.0, "°C", True)]
    df = spark.createDataFrame(rows, "v double, u string, lo double, hi double, own string, want boolean")
    got = df.select("want", units.within(F.col("v"), units.measure(F.col("u")), F.col("lo"), F.col("hi"), units.measure(F.col("own"))).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
