import pytest
from pyspark.sql import functions as F

from metrolex import data, tables
from metrolex.functions import text, units, values


@pytest.mark.parametrize(
    "given, kind, found",
    [
        ("Tg of PET was 78 °C and 351 K", "temperature", ["78 °C", "351 K"]),
        ("-40°C", "temperature", ["40°C"]),
        ("72 Cycles", "temperature", ["72 C"]),
        ("10°C/min", "temperature", ["10°C"]),
        ("78 deg C", "temperature", []),
        ("1.2e3 MPa", "modulus", ["3 MPa"]),
        ("5 Pa·s", "modulus", ["5 Pa"]),
        ("1200 ± 100 MPa", "modulus", ["100 MPa"]),
        ("50000 g/mol 50 kg/mol", "molar_mass", ["50000 g/mol", "50 kg/mol"]),
        ("12%", "percent", ["12%"]),
        ("50 wt%", "percent", []),
    ],
)
def test_measurement_patterns(spark, given, kind, found):
    pattern = dict(data.MEASUREMENT_PATTERNS)[kind]
    got = spark.range(1).select(text.measurements(F.lit(given), pattern).alias("m")).first()["m"]
    assert [m["found"] for m in got] == found


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("12.5", ("=", 12.5, 0, None, 1.0)),
        ("-0e0", ("=", 0.0, 0, None, 1.0)),
        ("10⁻³", ("=", 1.0, -3, None, 1.0)),
        ("1^2", ("=", 1.0, 0, None, 1.0)),
        ("2.1×10^{-3}", ("=", 2.1, -3, None, 1.0)),
        ("1 x 10 ^ 4", ("=", 1.0, 4, None, 1.0)),
        ("(1.2 ± 0.1) × 10³", ("=", 1.2, 3, 0.1, 1.0)),
        ("1.2(1) × 10³", ("=", 1.2, 3, 0.1, 1.0)),
        ("±0.05", ("±", None, 0, 0.05, 1.0)),
        ("<0.001", ("<", 0.001, 0, None, 1.0)),
        ("≅0.9", ("≈", 0.9, 0, None, 1.0)),
        ("5/1000", ("=", 5.0, 0, None, 1000.0)),
        ("1 , 23", ("=", 1.23, 0, None, 1.0)),
        ("1+E20", ("=", 1e20, 0, None, 1.0)),
        ("none", ("=", None, 0, None, 1.0)),
    ],
)
def test_value_forms(spark, raw, expected):
    p = spark.range(1).select(values.parsed(F.lit(raw)).alias("p")).first()["p"]
    assert (p["op"], p["mantissa"], p["exponent"], p["error"], p["denominator"]) == expected


def test_every_value_form_means_something(spark):
    df = tables.table(spark, [(v,) for v in data.VALUE_FORMS], "raw string").withColumn("p", values.parsed(F.col("raw")))
    assert df.where("p.mantissa is null and p.error is null").count() == 0


def test_render_leaves_no_slot(spark):
    fills = {s: F.lit("x") for s in ("polymer", "property", "symbol", "unit", "value")}
    assert tables.templates(spark).where(text.render(F.col("text"), fills).contains("{")).count() == 0


def test_units(spark):
    df = tables.table(spark, [("℃",), ("u+00B0C",), ("kJ·mol⁻¹",), ("g/cm³",), ("g/cm3",), ("µs",), ("",), (None,)], "u string")
    got = {r["u"]: r["canonical"] for r in units.normalise(df, "u").collect()}
    assert got["℃"] == got["u+00B0C"] == "°C" and got["g/cm³"] == got["g/cm3"] == "g/cm^3" and got["µs"] == "μs" and got[""] is None and got[None] is None


def test_repair_and_cues(spark):
    r = spark.range(1).select(text.repair_spaced(F.lit("T g  = 5 • C, Δ H 3 kJ mol^-1")).alias("a"), text.has_cue(F.lit("No Tg was seen")).alias("b"), text.has_cue(F.lit("notable Tg")).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == ("Tg  = 5 °C, ΔH 3 kJ mol⁻¹", True, False)


def test_property_table_adds_up():
    assert all(r[7] == r[5] + (r[6] or 0) for r in data.PROPERTY_TABLE) and len(data.PROPERTY_TABLE) == 29
    assert (sum(r[5] for r in data.PROPERTY_TABLE), sum(r[6] or 0 for r in data.PROPERTY_TABLE)) == (28071, 7456)
    assert len(set(data.LABELS)) == 13


def test_running_text_is_decoded_once(spark):
    cases = {
        "at 78 u+00B0C and u2103, u+33A1": "at 78 °C and °C, m²", "5 u00B7Pa": "5 ·Pa", "u2022C u+2022C": "°C •C", "menu+00B1": "men±", "u+u+00E9": "u+é", "u+005Cu+0041": "\\A", "u+D83D": "�", "plateau2103 u12G4 ubeef U2103 u+12": "plateau2103 u12G4 ubeef U2103 u+12",
        "u+0075+0041": "u+0041", "": "", "uU\nu": "uU\nu", "é u+0000": "é \x00",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", text.decode_text(F.col("t")).alias("d")).collect()} == {**cases, None: None}


def test_greek_in_running_text(spark):
    cases = {"alpha-helix, beta2 and Delta H; BETA": "α-helix, β2 and Δ H; Β", "betaine alphabet iota Omicron x_mu": "betaine alphabet iota Omicron x_μ", "eta theta zeta beta": "η θ ζ β", "éalpha alphaé": "éalpha alphaé", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", text.greek_letters(F.col("t")).alias("d")).collect()} == cases
    back = spark.createDataFrame([("σ_y = 5 µm, Δ",)], "t string").select(text.greek_names(F.col("t")).alias("d")).first()["d"]
    assert back == "sigma_y = 5 mum, Delta"


def test_numbers_in_running_text(spark):
    cases = {
        "Tg of PA66 and PA-66 is 78.5 °C, not 5.": ["78.5", "5"], "(1.2 ± 0.1) × 10³ MPa or 1.2(1) × 10³": ["(1.2 ± 0.1) × 10³", "1.2(1) × 10³"], "from -40 to <0.001 (±0.05)": ["-40", "<0.001", "±0.05"], "1 . 23 and 1 , 23; 3/4": ["1 . 23", "1 , 23", "3/4"],
        "10^{-2} 10⁻³ 1^2 1+E20 5·10⁴ 1 x 10 ^ 4": ["10^{-2}", "10⁻³", "1^2", "1+E20", "5·10⁴", "1 x 10 ^ 4"], "v1.2.3 O₂ x10 u+00B0C g/cm^3": [], "": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("f", values.found(F.col("t")))
    got = {r["t"]: r["f"] for r in df.collect()}
    assert {t: [x["raw"] for x in f] for t, f in got.items()} == cases
    all_ = spark.createDataFrame([(v,) for v in data.VALUE_FORMS], "raw string").select("raw", values.found(F.concat(F.lit("is "), "raw", F.lit(" MPa, as told"))).alias("f"), values.parsed(F.col("raw")).alias("p")).collect()
    for r in all_:
        assert [x["raw"] for x in r["f"]] == [r["raw"]] and all(r["f"][0][c] == r["p"][c] for c in ("op", "mantissa", "exponent", "error", "denominator")), r
