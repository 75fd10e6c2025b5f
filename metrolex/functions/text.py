"""Column functions on text: measurements, slots, tokens, repair, cues."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import data

SLOT = r"\{(\w+)\}"
#: A token: a run of digits, a run of letters, or any other visible character. A choice of ours.
TOKEN = r"\p{N}+|\p{L}+|[^\s]"
#: Cue words of negated or conditional statements; the list is ours.
CUE = r"(?i)\b(no|not|without|absence|failed|unless|if)\b"


def measurements(text: Column, pattern: str) -> Column:
    """array<struct<found, number, unit>> of one of data.MEASUREMENT_PATTERNS, exactly as the pattern matches: signs are lost, no right boundary."""
    p = F.lit(pattern)
    return F.arrays_zip(*(F.regexp_extract_all(text, p, F.lit(i)).alias(n) for i, n in enumerate(("found", "number", "unit"))))


def slots(text: Column) -> Column:
    """Distinct slot names of a template, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(SLOT), F.lit(1)))


def render(template: Column, fills: dict[str, Column]) -> Column:
    """The template with every occurrence of each slot replaced; a slot with a null fill gives null."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), fills.items(), template)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def has_cue(text: Column) -> Column:
    """Whether a sentence negates or conditions its measurement."""
    return text.rlike(CUE)


def repair_spaced(text: Column) -> Column:
    """Symbols that text recognition spaced out: `T g`, `Δ H`, `• C`, `mol^-1`."""
    for pattern, to in ((r"\bT\s+([gmdc])\b", "T$1"), (r"Δ\s+([A-Z])\b", "Δ$1"), (r"[•·]\s*C\b", "°C"), (r"\bdegC\b", "°C"), (r"mol\^-1", "mol⁻¹")):
        text = F.regexp_replace(text, pattern, to)
    return text


def decode_codes(text: Column) -> Column:
    """Code points left as text (`u+00B0C`) to what they stand for; a whole unit only."""
    return reduce(lambda t, kv: F.when(text == kv[0], F.lit(kv[1])).otherwise(t), reversed(data.OCR_CODES), text)


#: A code point left as text: u+ and four hexadecimal digits; without the plus in capitals, with a digit first, at a word's beginning.
_CODE = r"[uU]\+[0-9A-Fa-f]{4}|(?<![\p{L}\p{N}])u[0-9][0-9A-F]{3}"


def _mapped(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), key)


def decode_text(text: Column) -> Column:
    """Running text with every code point that stands as text decoded, in one pass: what is decoded is not looked at again.

    The fixed codes come first, the longest at a place; any other code gives its character (half of a pair gives the replacement character).
    """
    fixed = dict(data.OCR_CODES)
    known = "|".join(("" if "+" in c else r"(?<![\p{L}\p{N}])") + re.escape(c) for c in sorted(fixed, key=lambda c: (-len(c), c)))
    parts = F.regexp_extract_all(text, F.lit(rf"(?s){known}|{_CODE}|[^uU]+|."), F.lit(0))

    def part(x: Column) -> Column:
        half = F.upper(F.substring(x, -4, 2)).between("D8", "DF")
        character = F.when(half, "\ufffd").otherwise(F.decode(F.unhex(F.substring(x, -4, 4)), "UTF-16BE"))
        return F.coalesce(_mapped(fixed, x), F.when(x.rlike(rf"^(?:[uU]\+[0-9A-Fa-f]{{4}}|u[0-9][0-9A-F]{{3}})$"), character), x)

    return F.when(text == "", text).otherwise(F.array_join(F.transform(parts, part), ""))


def greek_letters(text: Column) -> Column:
    """Running text with names of Greek letters as letters: whole runs of Latin letters only (`beta-form`, `alpha2`, not `betaine`), a capital name as a capital letter."""
    known = [x for x in zip(data.GREEK_NAMES, data.GREEK_LOWER, data.GREEK_UPPER) if x[0] not in data.GREEK_UNNAMED]
    names = {n: lo for n, lo, _ in known} | {f(n): up for n, _, up in known for f in (str.capitalize, str.upper)}
    runs = F.regexp_extract_all(text, F.lit(r"(?s)\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.coalesce(_mapped(names, x), x)), "")


def greek_names(text: Column) -> Column:
    """Running text with Greek letters as the names that are known for them; the micro sign is mu."""
    known = [x for x in zip(data.GREEK_NAMES, data.GREEK_LOWER, data.GREEK_UPPER) if x[0] not in data.GREEK_UNNAMED]
    pairs = {lo: n for n, lo, _ in known} | {up: n.capitalize() for n, _, up in known} | {"µ": "mu"}
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)[{''.join(pairs)}]|[^{''.join(pairs)}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.coalesce(_mapped(pairs, x), x)), "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def heading(text: Column) -> Column:
    return F.lower(F.trim(text))
