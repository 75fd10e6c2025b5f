"""Numbers as they are written: plain, scientific, powers, uncertainties, inequalities, fractions, broken by text recognition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"-?[0-9.]+(?:[eE][+-]?[0-9]+)?"
#: mantissa, digits of uncertainty in parentheses, uncertainty, exponent of ten
_PRODUCT = rf"^\(?({_NUMBER})(?:\(([0-9]+)\))?(?: ?± ?({_NUMBER}))?\)?(?:\*10\^([+-]?[0-9]+))?$"
_POWER = r"^([0-9]+)\^([+-]?[0-9]+)$"
_FRACTION = r"^(-?[0-9.]+)/([0-9.]+)$"


def normalised(raw: Column) -> Column:
    """One spelling: `^` before exponents, `*` for products, no braces, broken spaces closed (a spaced comma is a decimal point)."""
    s = F.regexp_replace(raw, "([⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺]+)", "^$1")
    s = F.translate(s, "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺{}", "0123456789-+")
    s = F.regexp_replace(s, r" ?\^ ?", "^")
    s = F.regexp_replace(s, r" ?[×·∙x] ?", "*")
    s = F.regexp_replace(s, r"([0-9]) [.,] ([0-9])", "$1.$2")
    return F.regexp_replace(s, r"^([0-9]+)\+[eE]([0-9]+)$", "$1E+$2")


def parsed(raw: Column) -> Column:
    """struct<op, mantissa, exponent, error, denominator>: raw means op mantissa * 10^exponent / denominator, give or take error (before the power).

    op is =, <, > or ≈ (also for ~ and ≅); ± alone has no mantissa. What no form fits has a null mantissa and error.
    A power of another base is worked out. Zero has no sign.
    """
    s = normalised(raw)
    op = F.when(s.startswith("<"), "<").when(s.startswith(">"), ">").when(s.rlike("^[≈~≅]"), "≈").when(s.startswith("±"), "±").otherwise("=")
    bare = F.regexp_replace(s, "^[<>≈~≅±]", "")
    group = lambda p, i: F.nullif(F.regexp_extract(bare, p, i), F.lit(""))
    number = lambda c: c.try_cast("double") + F.lit(0.0)
    base, power = group(_POWER, 1), group(_POWER, 2)
    mantissa = F.when(base == "10", F.lit(1.0)).when(base.isNotNull(), F.pow(number(base), number(power))).when(group(_FRACTION, 1).isNotNull(), number(group(_FRACTION, 1))).otherwise(number(group(_PRODUCT, 1)))
    exponent = F.when(base == "10", power.cast("int")).otherwise(F.coalesce(group(_PRODUCT, 4).cast("int"), F.lit(0)))
    decimals = F.length(F.regexp_extract(group(_PRODUCT, 1), r"\.([0-9]+)", 1))
    digits = number(F.concat(group(_PRODUCT, 2), F.lit("e-"), decimals.cast("string")))
    error = F.when(op == "±", number(group(_PRODUCT, 1))).otherwise(F.coalesce(number(group(_PRODUCT, 3)), digits))
    return F.struct(op.alias("op"), F.when(op != "±", mantissa).alias("mantissa"), exponent.alias("exponent"), error.alias("error"), F.coalesce(number(group(_FRACTION, 2)), F.lit(1.0)).alias("denominator"))


def value(p: Column) -> Column:
    """The number that parsed() describes."""
    return p["mantissa"] * F.pow(F.lit(10.0), p["exponent"]) / p["denominator"]


def interval(data_range: Column) -> tuple[Column, Column]:
    """Bounds of `[lo, hi]`, whatever dash the signs are."""
    plain = F.translate(data_range, "−–", "--")
    return F.regexp_extract(plain, r"\[([^,]+),", 1).cast("double"), F.regexp_extract(plain, r", ?([^\]]+)\]", 1).cast("double")


_PLAIN = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_TEN = r"10 ?(?:\^ ?\{?[+-]?[0-9]+\}?|[⁺⁻]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)"
_TIMES = rf" ?[×·∙x] ?{_TEN}"
#: A number as it stands in a sentence, in any form that parsed() takes; the longest form at a place. Not inside a word, a code, a power or a longer number, and no sign that joins it to a word (`PA-66`).
IN_TEXT = (
    rf"(?<![\p{{L}}\p{{N}}.+^])(?<![\p{{L}}\p{{N}}]-)[<>≈~≅±]?"
    rf"(?:\({_PLAIN} ?± ?{_PLAIN}\)(?:{_TIMES})?|[0-9]+ [.,] [0-9]+|[0-9]+\+[eE][0-9]+|{_TEN}|[0-9]+\^[+-]?[0-9]+|[0-9]+/[0-9]+|{_PLAIN}(?:\([0-9]+\))?(?: ?± ?{_PLAIN})?(?:{_TIMES})?)"
    rf"(?![\p{{N}}])"
)


def found(text: Column) -> Column:
    """array<struct<raw, op, mantissa, exponent, error, denominator>> of the numbers in running text, in their order."""
    return F.transform(F.regexp_extract_all(text, F.lit(IN_TEXT), F.lit(0)), lambda r: F.struct(r.alias("raw"), *(parsed(r)[c].alias(c) for c in ("op", "mantissa", "exponent", "error", "denominator"))))
