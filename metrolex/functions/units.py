"""Units: one spelling for written variants; what a unit expression measures, as a vector of base dimensions with a factor.

An expression is a product of powers of units: `W/m·K`, `J g^-1 K^-1`, `Jg^-1K^-1`, `N/mm^2`, `MPa·m^0.5`. All that follows a stroke is below it. A
unit's symbol may have a decimal prefix. What no reading as such a product uses up has no measure. Everything is a column expression over a
constant map, so units of any number are parsed where they stand.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import data
from ..tables import table
from .text import decode_codes


def spelled(unit: Column) -> Column:
    """Exponents as ^n, products as `·`, one micro sign; the empty unit is null."""
    u = F.nullif(F.trim(decode_codes(unit)), F.lit(""))
    u = F.replace(u, F.lit("µ"), F.lit("μ"))
    u = F.regexp_replace(u, "([⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺½]+)", "^$1")
    u = F.replace(F.translate(u, "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+"), F.lit("½"), F.lit("0.5"))
    return F.regexp_replace(F.regexp_replace(u, r"([a-zA-Z])([0-9])", "$1^$2"), r"([a-zA-Z0-9)]) ([a-zA-Z])", "$1·$2")


def normalise(df: DataFrame, unit_col: str, out: str = "canonical") -> DataFrame:
    """df with the canonical unit: a grouped variant's own, else the one spelling."""
    variants = table(df.sparkSession, data.UNIT_VARIANTS, "__variant string, __canonical string")
    decoded = decode_codes(F.col(unit_col))
    return df.join(variants, decoded == F.col("__variant"), "left").withColumn(out, F.coalesce("__canonical", spelled(F.col(unit_col)))).drop("__variant", "__canonical")


def dimensions(lexicon: DataFrame) -> DataFrame:
    """(unit, dimension), many to many: the sections that list a unit."""
    return lexicon.where("entity_type = 'unit' and term != ''").select(F.col("term").alias("unit"), F.col("section").alias("dimension")).distinct()


#: Base dimensions, in the order of a measure's vector. An atom is counted as a share of a mole.
DIMENSIONS = ["length", "mass", "time", "temperature", "amount", "current"]
_MOLE = 6.02214076e23
#: Units: symbol -> factor to SI and powers of the base dimensions. What takes prefixes and what doesn't.
_PREFIXED = {
    "m": (1.0, (1,)), "g": (1e-3, (0, 1)), "s": (1.0, (0, 0, 1)), "mol": (1.0, (0, 0, 0, 0, 1)), "A": (1.0, (0, 0, 0, 0, 0, 1)), "Pa": (1.0, (-1, 1, -2)), "J": (1.0, (2, 1, -2)), "N": (1.0, (1, 1, -2)), "W": (1.0, (2, 1, -3)),
    "V": (1.0, (2, 1, -3, 0, 0, -1)), "S": (1.0, (-2, -1, 3, 0, 0, 2)), "Hz": (1.0, (0, 0, -1)), "L": (1e-3, (3,)), "M": (1e3, (-3, 0, 0, 0, 1)), "Da": (1e-3, (0, 1, 0, 0, -1)), "eV": (1.602176634e-19, (2, 1, -2)), "Ω": (1.0, (2, 1, -3, 0, 0, -2)), "cal": (4.184, (2, 1, -2)), "bar": (1e5, (-1, 1, -2)),
}
_ALONE = {
    "K": (1.0, (0, 0, 0, 1)), "°C": (1.0, (0, 0, 0, 1)), "°F": (5 / 9, (0, 0, 0, 1)), "C": (1.0, (0, 0, 0, 1)), "min": (60.0, (0, 0, 1)), "h": (3600.0, (0, 0, 1)), "atm": (101325.0, (-1, 1, -2)), "torr": (101325 / 760, (-1, 1, -2)), "psi": (6894.757293168, (-1, 1, -2)),
    "atom": (1 / _MOLE, (0, 0, 0, 0, 1)), "%": (0.01, ()), "wt%": (0.01, ()), "ppm": (1e-6, ()), "barrer": (3.3464e-16, (0, -1, 1, 0, 1)),
}
_PREFIXES = {"": 1.0, "G": 1e9, "M": 1e6, "k": 1e3, "d": 1e-1, "c": 1e-2, "m": 1e-3, "μ": 1e-6, "n": 1e-9, "p": 1e-12}
#: Where zero lies, in kelvin: it counts only for a temperature that stands alone.
_ZERO = {"°C": 273.15, "C": 273.15, "°F": 459.67 * 5 / 9}


@lru_cache(1)
def atoms() -> dict[str, tuple[float, tuple[int, ...]]]:
    """Every symbol, with prefixes; a unit of its own goes before a prefix and another (min, not milli-inch)."""
    out = {p + u: (f * k, d) for u, (k, d) in _PREFIXED.items() for p, f in _PREFIXES.items()} | _ALONE
    return {u: (k, (*d, *[0] * (len(DIMENSIONS) - len(d)))) for u, (k, d) in out.items()}


@lru_cache(1)
def _grammar() -> tuple[str, str]:
    """Patterns of a factor (symbol and power), and of a whole expression."""
    symbol = "|".join(map(re.escape, sorted(atoms(), key=lambda u: (-len(u), u))))
    power = r"(?:\^([-+]?[0-9]+(?:\.[0-9]+)?))?"
    factor = rf"({symbol}){power}"
    return factor, rf"^(?:1/)?(?:{factor}[ ·*]?)+$"


def measure(unit: Column) -> Column:
    """struct<dimension array<double>, factor, zero>: a value v of the unit is v * factor + zero in SI; null where the text is no unit.

    dimension has the powers of DIMENSIONS. No unit at all (null or blank) is the plain number one.
    """
    factor, whole = _grammar()
    table = F.map_from_arrays(F.array(*map(F.lit, atoms())), F.array(*(F.struct(F.lit(k).alias("k"), F.array(*(F.lit(float(x)) for x in d)).alias("d")) for k, d in atoms().values())))
    u = F.coalesce(_variant(spelled(unit)), F.lit(""))
    above, below = F.substring_index(u, "/", 1), F.when(u.contains("/"), F.substring(u, F.length(F.substring_index(u, "/", 1)) + 2, 1 << 20)).otherwise("")
    halves = ~u.contains("/") | (above != "") & (below != "")
    above = F.when(above == "1", "").otherwise(above)
    one = F.struct(F.array(*[F.lit(0.0)] * len(DIMENSIONS)).alias("d"), F.lit(1.0).alias("k"))

    def product(text: Column, sign: int) -> Column:
        found = F.arrays_zip(F.regexp_extract_all(text, F.lit(factor), F.lit(1)).alias("u"), F.regexp_extract_all(text, F.lit(factor), F.lit(2)).alias("p"))

        def times(a: Column, x: Column) -> Column:
            own, p = F.element_at(table, x["u"]), F.coalesce(F.nullif(x["p"], F.lit("")).cast("double"), F.lit(1.0)) * sign
            return F.struct(F.zip_with(a["d"], own["d"], lambda m, n: m + n * p).alias("d"), (a["k"] * F.pow(own["k"], p)).alias("k"))

        return F.aggregate(found, one, times)

    good = lambda t: (t == "") | t.rlike(whole)
    known = good(above) & good(below) & halves
    up, down = product(above, 1), product(below, -1)
    zero = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in _ZERO.items() for x in kv)), u), F.lit(0.0))
    return F.when(known, F.struct(F.zip_with(up["d"], down["d"], lambda m, n: m + n).alias("dimension"), (up["k"] * down["k"]).alias("factor"), zero.alias("zero")))


def _variant(u: Column) -> Column:
    """The unit that a grouped variant stands for."""
    names = {a: b for a, b in data.UNIT_VARIANTS} | {a.replace(" ", "·"): b for a, b in data.UNIT_VARIANTS}
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), u), u)


def in_si(value: Column, m: Column) -> Column:
    """A value of a unit with measure m, in SI."""
    return value * m["factor"] + m["zero"]


def same_dimension(a: Column, b: Column) -> Column:
    """Whether two measures tell the same kind of quantity; false where one is unknown."""
    near = F.forall(F.arrays_zip(a["dimension"].alias("m"), b["dimension"].alias("n")), lambda x: F.abs(x["m"] - x["n"]) < 1e-9)
    return F.coalesce(near, F.lit(False))


def within(value: Column, unit: Column, lo: Column, hi: Column, own: Column) -> Column:
    """Whether a value of `unit` lies within [lo, hi] of `own` (measures); null where they tell different kinds of quantities. Bounds give way by a billionth, for what conversion rounds."""
    v, a, b = in_si(value, unit), in_si(lo, own), in_si(hi, own)
    give = F.greatest(F.abs(a), F.abs(b)) * 1e-9
    return F.when(same_dimension(unit, own), (v >= a - give) & (v <= b + give))
