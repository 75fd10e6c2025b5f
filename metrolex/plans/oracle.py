"""The same results in DuckDB SQL, written on their own; only the vocabulary's rows are shared."""

from __future__ import annotations

from .. import data
from .corpus import OWN_TEMPLATES, WRONG_UNITS


def rows(name: str, columns: str, items: list[tuple]) -> str:
    """A CTE of literal rows."""
    lit = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in items) + ")"


def listed(name: str, items: list[str]) -> str:
    return rows(name, "n, v", list(enumerate(items)))


_kinds = ", ".join(listed({"polymer": "pol", "property": "prop", "symbol": "sym", "unit": "uni", "material": "mat"}[k], data.distinct_terms(k)) for k in ("polymer", "property", "symbol", "unit", "material"))
_n = {k: len(data.distinct_terms(k)) for k in ("polymer", "property", "symbol", "unit", "material")}
_tpl = rows("tpl", "tpl_id, family, text", data.templates())
_lex = rows("lex", "entity_type, ord, term, section", data.lexicon())
_corpus = f"""{_tpl}, {_kinds}, corpus as (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::bigint) as sid, tpl_id, family, pol.v as polymer, prop.v as property, sym.v as symbol, uni.v as unit,
    replace(replace(replace(replace(replace(text, '{{polymer}}', pol.v), '{{property}}', prop.v), '{{symbol}}', sym.v), '{{unit}}', uni.v), '{{value}}', l_quantity::bigint::varchar) as sentence
  from lineitem join tpl on tpl_id = l_orderkey % {len(data.templates())} join pol on pol.n = l_partkey % {_n["polymer"]} join prop on prop.n = (l_orderkey + l_linenumber) % {_n["property"]}
    join sym on sym.n = l_suppkey % {_n["symbol"]} join uni on uni.n = (l_suppkey + l_linenumber) % {_n["unit"]})"""
_patterns = " union all ".join(f"select polymer, '{name}' as pattern, unnest(regexp_extract_all(sentence, '{p}', 1)) as number, unnest(regexp_extract_all(sentence, '{p}', 2)) as found_unit from corpus" for name, p in data.MEASUREMENT_PATTERNS)
_token = r"[0-9]+|\p{N}+|\p{L}+|[^\s]"
_prio = "case entity " + " ".join(f"when '{k}' then {i + 1}" for i, k in enumerate(data.TYPE_PRIORITY)) + " end"
_matching = f"""toks as (select sid, regexp_extract_all(sentence, '\\p{{N}}+|\\p{{L}}+|[^\\s]') as t from corpus),
  terms as (select distinct upper(entity_type) as entity, term, regexp_extract_all(term, '\\p{{N}}+|\\p{{L}}+|[^\\s]') as w from lex where term <> ''),
  pos_ as (select sid, t, unnest(range(1, len(t) + 1)) as p from toks),
  hit as (select sid, t, p, entity, term, len(w) as n from pos_ join terms on t[p] = w[1] where t[p : p + len(w) - 1] = w),
  good as (select sid, p - 1 as st, p - 1 + n as en, entity, term from hit
    where case when entity = 'UNIT' then p > 1 and regexp_full_match(t[p - 1], '\\p{{N}}+') when length(term) = 1 then (p > 1 and (t[p - 1] = '=' or regexp_full_match(t[p - 1], '\\p{{N}}+'))) or (p + n <= len(t) and (t[p + n] = '=' or regexp_full_match(t[p + n], '\\p{{N}}+'))) else true end
    union all select sid, p - 1, p, 'VALUE', t[p] from pos_ where regexp_full_match(t[p], '\\p{{N}}+')),
  best as (select * from good qualify row_number() over (partition by sid, st order by en desc, {_prio}, term) = 1),
  lists as (select sid, list([struct_pack(st := st, en := en, entity := entity, term := term)] order by st) as l from best group by sid),
  kept as (select sid, unnest(list_reduce(l, lambda a, x: case when x[1].st >= a[-1].en then list_concat(a, x) else a end)) as m from lists),
  ment as (select sid, m.st as st, m.en as en, m.entity as entity, m.term as term from kept)"""
_mentions = f"{_corpus}, {_lex}, {_matching}"
_bio = f"""{_mentions}, cells as (select a.sid, a.p, a.t[a.p] as tok, coalesce(case when m.st = a.p - 1 then 'B-' else 'I-' end || m.entity, 'O') as label from pos_ a left join ment m on m.sid = a.sid and a.p - 1 >= m.st and a.p - 1 < m.en)"""
_own = f"""{rows("tpl", "tpl_id, family, text", OWN_TEMPLATES)}, {listed("prop", data.distinct_terms("property"))}, {listed("sym", data.distinct_terms("symbol"))}, {listed("uni", data.distinct_terms("unit"))}, {rows("lex0", "entity_type, ord, term, section", data.lexicon())},
  pol as (select row_number() over (order by p_partkey) - 1 as n, p_name || ' ' || p_partkey as v from part),
  lex as (select * from lex0 where entity_type <> 'polymer' union all select 'polymer', p_partkey::int, p_name || ' ' || p_partkey, p_brand from part),
  corpus as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::bigint) as sid, tpl_id, family, pol.v as polymer,
    replace(replace(replace(replace(replace(text, '{{polymer}}', pol.v), '{{property}}', prop.v), '{{symbol}}', sym.v), '{{unit}}', uni.v), '{{value}}', l_quantity::bigint::varchar) as sentence
  from lineitem join (select *, row_number() over (order by tpl_id) - 1 as n from tpl) t on t.n = l_orderkey % {len(OWN_TEMPLATES)} join pol on pol.n = l_partkey % (select count(*) from part) join prop on prop.n = (l_orderkey + l_linenumber) % {_n["property"]}
    join sym on sym.n = l_suppkey % {_n["symbol"]} join uni on uni.n = (l_suppkey + l_linenumber) % {_n["unit"]}), {_matching}"""
_ranged = rows("props", "n, symbol, own_unit, data_range", [(i, r[1], r[2], r[4]) for i, r in enumerate(data.PROPERTY_TABLE)])
_measured = f"{_ranged}, {listed('uni', data.distinct_terms('unit'))}, m as (select l_orderkey, l_linenumber, l_quantity, symbol, own_unit, translate(data_range, '−–', '--') as r, uni.v as unit from lineitem join props on props.n = l_partkey % {len(data.PROPERTY_TABLE)} join uni on uni.n = l_suppkey % {_n['unit']})"
_lo, _hi = r"regexp_extract(r, '\[([^,]+),', 1)::double", r"regexp_extract(r, ', ?([^\]]+)\]', 1)::double"
#: What a unit measures: kind, factor to the kind's own unit, where zero lies. Written by hand, for the default vocabulary and the property table.
MEASURES = [
    ("K", "temperature", 1.0, 0.0), ("Kelvin", "temperature", 1.0, 0.0), *((u, "temperature", 1.0, 273.15) for u in ("°C", "C", "deg C", "° C", "·C", "degC", "℃", "deg·C", "Celsius", "u+00B0C", "u00B0C", "u2103")), ("°F", "temperature", 5 / 9, 255.3722222222222),
    ("°C/min", "heating", 1 / 60, 0.0), ("K/min", "heating", 1 / 60, 0.0), ("kJ/mol", "molar energy", 1e3, 0.0), ("J/mol", "molar energy", 1.0, 0.0), ("kJ·mol⁻¹", "molar energy", 1e3, 0.0), ("kcal/mol", "molar energy", 4184.0, 0.0), ("eV/atom", "molar energy", 96485.33212, 0.0), ("eV atom⁻¹", "molar energy", 96485.33212, 0.0),
    ("eV", "energy", 1.602176634e-19, 0.0), ("N·m", "energy", 1.0, 0.0), ("J/g·K", "heat capacity", 1e3, 0.0), ("J·g⁻¹·K⁻¹", "heat capacity", 1e3, 0.0), ("Jg⁻¹K⁻¹", "heat capacity", 1e3, 0.0), ("J kg⁻¹ K⁻¹", "heat capacity", 1.0, 0.0),
    ("MPa", "pressure", 1e6, 0.0), ("GPa", "pressure", 1e9, 0.0), ("Pa", "pressure", 1.0, 0.0), ("kPa", "pressure", 1e3, 0.0), ("N/mm²", "pressure", 1e6, 0.0), ("psi", "pressure", 6894.757293168, 0.0), ("atm", "pressure", 101325.0, 0.0), ("bar", "pressure", 1e5, 0.0), ("torr", "pressure", 133.32236842105263, 0.0), ("cal cm⁻³", "pressure", 4.184e6, 0.0),
    *((u, "density", 1e3, 0.0) for u in ("g/cm³", "g·cm⁻³", "g/cm3", "g/cm^3", "g cm⁻³")), ("kg/m³", "density", 1.0, 0.0), ("s", "time", 1.0, 0.0), ("min", "time", 60.0, 0.0), ("h", "time", 3600.0, 0.0), ("ms", "time", 1e-3, 0.0), ("μs", "time", 1e-6, 0.0), ("µs", "time", 1e-6, 0.0), ("s⁻¹", "rate", 1.0, 0.0), ("Hz", "rate", 1.0, 0.0),
    ("barrer", "permeability", 3.3464e-16, 0.0), ("cm²/s", "diffusivity", 1e-4, 0.0), ("mol/L", "concentration", 1e3, 0.0), ("mol·L⁻¹", "concentration", 1e3, 0.0), ("M", "concentration", 1e3, 0.0), ("mM", "concentration", 1.0, 0.0), ("W/m·K", "conductivity", 1.0, 0.0), ("W·m⁻¹·K⁻¹", "conductivity", 1.0, 0.0),
    ("J/m²", "surface energy", 1.0, 0.0), ("MPa·m½", "toughness", 1e6, 0.0), ("%", "number", 0.01, 0.0), ("wt%", "number", 0.01, 0.0), ("ppm", "number", 1e-6, 0.0), ("", "number", 1.0, 0.0), ("g/mol", "molar mass", 1e-3, 0.0), ("kg/mol", "molar mass", 1.0, 0.0), ("kDa", "molar mass", 1.0, 0.0), ("nm", "length", 1e-9, 0.0), ("μm", "length", 1e-6, 0.0), ("µm", "length", 1e-6, 0.0), ("mm", "length", 1e-3, 0.0),
    ("kJ/m²", "surface energy", 1e3, 0.0), ("g/mL", "density", 1e3, 0.0), ("Pa·s", "viscosity", 1.0, 0.0), ("mPa·s", "viscosity", 1e-3, 0.0), ("V", "voltage", 1.0, 0.0), ("kV/mm", "field", 1e6, 0.0), ("S/cm", "electric conductivity", 100.0, 0.0), ("Ω·m", "resistivity", 1.0, 0.0),
]
#: Numbers in forms that no plain cast reads, with what they say: operator, mantissa, exponent of ten, error, denominator. Written by hand.
PARSED = [
    ("1^2", "=", 1.0, 0, None, 1.0), ("10^3", "=", 1.0, 3, None, 1.0), ("1+E20", "=", 1e20, 0, None, 1.0), ("1×10^6", "=", 1.0, 6, None, 1.0), ("2×10^5", "=", 2.0, 5, None, 1.0), ("10^-3", "=", 1.0, -3, None, 1.0), ("10⁻³", "=", 1.0, -3, None, 1.0), ("10⁶", "=", 1.0, 6, None, 1.0),
    ("10⁻⁶", "=", 1.0, -6, None, 1.0), ("1·10⁻¹", "=", 1.0, -1, None, 1.0), ("5·10⁻²", "=", 5.0, -2, None, 1.0), ("6·10³", "=", 6.0, 3, None, 1.0), ("(1.2 ± 0.1) × 10³", "=", 1.2, 3, 0.1, 1.0), ("1200 ± 100", "=", 1200.0, 0, 100.0, 1.0), ("1.2(1) × 10³", "=", 1.2, 3, 0.1, 1.0), ("1.20e3 ± 0.10e3", "=", 1200.0, 0, 100.0, 1.0),
    ("10^6", "=", 1.0, 6, None, 1.0), ("10^-1", "=", 1.0, -1, None, 1.0), ("10^{-2}", "=", 1.0, -2, None, 1.0), ("1.5×10^5", "=", 1.5, 5, None, 1.0), ("2.1×10^{-3}", "=", 2.1, -3, None, 1.0), ("4.5·10^2", "=", 4.5, 2, None, 1.0), ("7.89∙10⁻³", "=", 7.89, -3, None, 1.0), ("10⁻²", "=", 1.0, -2, None, 1.0),
    ("1.23×10⁻³", "=", 1.23, -3, None, 1.0), ("6.02×10²³", "=", 6.02, 23, None, 1.0), ("5·10⁴", "=", 5.0, 4, None, 1.0), ("8∙10⁻¹", "=", 8.0, -1, None, 1.0), ("1/2", "=", 1.0, 0, None, 2.0), ("3/4", "=", 3.0, 0, None, 4.0), ("5/1000", "=", 5.0, 0, None, 1000.0), ("±0.05", "±", None, 0, 0.05, 1.0), ("1.5±0.2", "=", 1.5, 0, 0.2, 1.0),
    ("<0.001", "<", 0.001, 0, None, 1.0), (">1000", ">", 1000.0, 0, None, 1.0), ("≈0.8", "≈", 0.8, 0, None, 1.0), ("~1.2", "≈", 1.2, 0, None, 1.0), ("≅0.9", "≈", 0.9, 0, None, 1.0), ("1 . 23", "=", 1.23, 0, None, 1.0), ("1 , 23", "=", 1.23, 0, None, 1.0), ("1 x10^4", "=", 1.0, 4, None, 1.0), ("1 x 10 ^ 4", "=", 1.0, 4, None, 1.0), ("10 × 10³", "=", 10.0, 3, None, 1.0),
]
#: One spelling for units that have others. Written by hand.
SPELLED = [
    *((u, "°C") for u in ("deg C", "° C", "·C", "degC", "℃", "deg·C", "Celsius", "u+00B0C", "u00B0C", "u2103")), ("Kelvin", "K"), ("kJ·mol⁻¹", "kJ·mol^-1"), ("J·g⁻¹·K⁻¹", "J·g^-1·K^-1"), ("J kg⁻¹ K⁻¹", "J·kg^-1·K^-1"), ("N/mm²", "N/mm^2"), ("g/cm³", "g/cm^3"), ("g·cm⁻³", "g·cm^-3"), ("g/cm3", "g/cm^3"), ("kg/m³", "kg/m^3"), ("µs", "μs"), ("s⁻¹", "s^-1"),
    ("cm²/s", "cm^2/s"), ("mol·L⁻¹", "mol·L^-1"), ("W·m⁻¹·K⁻¹", "W·m^-1·K^-1"), ("J/m²", "J/m^2"), ("kJ/m²", "kJ/m^2"), ("µm", "μm"), ("MPa·m½", "MPa·m^0.5"), ("Jg⁻¹K⁻¹", "Jg^-1K^-1"), ("eV atom⁻¹", "eV·atom^-1"), ("g cm⁻³", "g·cm^-3"), ("cal cm⁻³", "cal·cm^-3"),
]
_spelled = rows("spelled", "a, b", SPELLED)
_words = sorted({w for ws in data.SECTION_WORDS.values() for w in ws}) + ["appendix"]
_headings = f"{listed('hw', _words)}, h as (select p_partkey, case when p_size % 2 = 0 then upper(v) else '  ' || array_to_string(list_transform(string_split(v, ' '), lambda x: upper(x[1]) || x[2:]), ' ') || ' ' end as heading from part join hw on n = p_partkey % {len(_words)})"
_log = r"""base as (select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as at_, case when event_type = 'error' then 'ERROR' else 'INFO' end as level, case user_id % 4 when 0 then 'api' when 1 then 'user' else 'system' end as category,
    event_type || '.py' as file_name, (event_id % 100)::int as line_number, event_type, event_type = 'click' as user_action, props as context, 'event ' || event_id as message from events),
  lines as (select *, null as log_id, false as synced, 1 as write_ from base union all
    select *, sha256(concat_ws('|', at_, file_name, line_number, message)), event_id % 3 <> 0, 2 from base where event_id % 7 <> 0),
  last_ as (select * from lines qualify row_number() over (partition by event_id order by write_ desc) = 1)"""
_timed = """e as (select event_id, case when event_id % 2 = 0 then 0 else user_id end as user, ts from events),
  o as (select case when o_orderkey % 2 = 0 then 0 else o_custkey % 150 end as buyer, timestamp '2024-01-01' + to_days((date_diff('day', date '1995-01-01', o_orderdate::date) % 30)::int) + to_hours(o_orderkey % 24) as ordered, o_orderkey from orders)"""
_pt = rows("pt", "property, symbol, unit, source, data_range, hp, cp, all_, category", data.PROPERTY_TABLE)
_picks = [("polymer", "pol", "o_custkey"), ("polymer1", "pol", "o_custkey + 1"), ("polymer2", "pol", "o_custkey + 2"), ("property", "prop", "o_orderkey"), ("property1", "prop", "o_orderkey + 1"), ("property2", "prop", "o_orderkey + 2"), ("unit", "uni", "o_custkey"), ("unit1", "uni", "o_custkey + 1"), ("unit2", "uni", "o_custkey + 2"), ("material", "mat", "o_orderkey")]
_size = {"pol": _n["polymer"], "prop": _n["property"], "uni": _n["unit"], "mat": _n["material"]}
_complex_text = "c.v"
for _slot, _, _ in _picks:
    _complex_text = f"replace({_complex_text}, '{{{_slot}}}', x_{_slot}.v)"


def _canonical(kind: str, pairs: list[tuple[str, str]]) -> str:
    known = rows("m", "o, k, v", [(i, k, v) for i, (k, v) in enumerate(pairs)])
    return f"with {_corpus}, {known}, {listed('t', data.distinct_terms(kind))}, last_ as (select k, arg_max(v, o) as v from m group by k), used as (select {kind} as k, count(*) as n from corpus group by all) select s.k as surface, coalesce(used.n, 0) as n, coalesce(l.v, s.k) as canonical from (select v as k from t union select k from m) s left join last_ l using (k) left join used using (k)"


ORACLE = {
    "corpus_measurements": f"with {_corpus}, found as ({_patterns}) select polymer, pattern, found_unit, count(*) as n, sum(number::double::bigint)::bigint as total from found group by all",
    "template_slots": rf"with {_corpus}, s as (select tpl_id, regexp_extract_all(text, '\{{(\w+)\}}', 1) as a from tpl), u as (select tpl_id, unnest(a) as x, unnest(range(len(a))) as i from s), f as (select tpl_id, x, min(i) as i from u group by all) select tpl_id, coalesce((select string_agg(x, ',' order by i) from f where f.tpl_id = tpl.tpl_id), '') as slots, (select count(*) from f where f.tpl_id = tpl.tpl_id) as n_slots, (select count(*) from corpus where corpus.tpl_id = tpl.tpl_id) as n from tpl",
    "template_signatures": rf"with {_corpus}, used as (select tpl_id, count(*) as k from corpus group by all), t as (select tpl.*, coalesce(k, 0) as k from tpl left join used using (tpl_id)) select array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\{{(\w+)\}}', 1))), ',') as signature, count(*) as n, sum(k)::bigint as n_sentences from t group by 1",
    "template_family_counts": f"with {_corpus}, used as (select tpl_id, count(*) as k from corpus group by all), t as (select tpl.*, coalesce(k, 0) as k from tpl left join used using (tpl_id)) select family, count(*) as n, count(distinct text) as n_distinct, sum(k)::bigint as n_sentences from t group by family",
    "complex_render": f"with {_kinds}, {listed('c', data.COMPLEX_TEMPLATES)} select o_orderkey, replace(replace({_complex_text}, '{{value1}}', (o_orderkey % 97)::varchar), '{{value2}}', (o_custkey % 89)::varchar) as sentence from orders join c on c.n = o_orderkey % {len(data.COMPLEX_TEMPLATES)} "
    + " ".join(f"join {t} x_{s} on x_{s}.n = ({k}) % {_size[t]}" for s, t, k in _picks),
    "negatives_render": (_neg := f"with {_kinds}, {rows('g', 'n, kind, text', [(i, *t) for i, t in enumerate(data.NEGATIVE_TEMPLATES)])}, {listed('au', data.AUTHOR_NAMES)}, {listed('np', data.NON_PROPERTIES)}, {listed('wu', WRONG_UNITS)}, neg as (select o_orderkey, kind, replace(replace(replace(replace(replace(replace(text, '{{author_name}}', au.v), '{{non_property}}', np.v), '{{polymer}}', pol.v), '{{unit}}', uni.v), '{{wrong_unit}}', wu.v), '{{value}}', (o_orderkey % 97)::varchar) as sentence, case kind when 'author' then au.v when 'wrong_unit' then wu.v else np.v end as distractor from orders join g on g.n = o_orderkey % 3 join au on au.n = o_custkey % {len(data.AUTHOR_NAMES)} join np on np.n = o_custkey % {len(data.NON_PROPERTIES)} join pol on pol.n = o_custkey % {_n['polymer']} join uni on uni.n = o_orderkey % {_n['unit']} join wu on wu.n = (o_orderkey + o_custkey) % {len(WRONG_UNITS)})") + " select * from neg",
    "negatives_excluded": _neg + " select kind, distractor, count(*) as n from neg where distractor not in (select v from au union all select v from np) group by all",
    "value_parse": f"""with {rows("known", "raw, op, mantissa, exponent, error, denominator", PARSED)}, {listed("form", data.VALUE_FORMS)}, {listed("pol", data.distinct_terms("polymer"))},
  told as (select form.v as raw from lineitem join form on form.n = (l_orderkey + l_linenumber) % {len(data.VALUE_FORMS)} union all select regexp_extract(pol.v, ' ([0-9]+)$', 1) from lineitem join pol on pol.n = l_partkey % {_n["polymer"]} where regexp_matches(pol.v, ' [0-9]+$'))
  select told.raw, coalesce(op, '=') as op, case when op is null then told.raw::double + 0.0 else mantissa::double end as mantissa, coalesce(exponent, 0)::int as exponent, error::double as error, coalesce(denominator, 1)::double as denominator, count(*) as n from told left join known on known.raw = told.raw group by all""",
    "canonical_polymers": _canonical("polymer", data.CANONICAL_POLYMERS),
    "canonical_properties": _canonical("property", data.CANONICAL_PROPERTIES),
    "lexicon_dups": f"with {_corpus}, {_lex}, use_ as (select k as entity_type, v as term, count(*) as n_sentences from (select unnest(['polymer', 'property', 'symbol', 'unit']) as k, unnest([polymer, property, symbol, unit]) as v from corpus) group by all), d as (select entity_type, term, count(*) as n from lex group by all having count(*) > 1) select d.*, coalesce(n_sentences, 0) as n_sentences from d left join use_ using (entity_type, term)",
    "lexicon_sizes": f"with {_corpus}, {_lex}, use_ as (select k as entity_type, v as term, count(*) as n_sentences from (select unnest(['polymer', 'property', 'symbol', 'unit']) as k, unnest([polymer, property, symbol, unit]) as v from corpus) group by all), d as (select entity_type, count(*) as n, count(distinct term) as n_distinct from lex group by all), u as (select entity_type, count(*) as n_used, sum(n_sentences)::bigint as n_sentences from use_ group by all) select d.*, coalesce(n_used, 0) as n_used, coalesce(n_sentences, 0) as n_sentences from d left join u using (entity_type)",
    "lexicon_overlap": f"with {_corpus}, {_lex}, use_ as (select k as entity_type, v as term, count(*) as n_sentences from (select unnest(['polymer', 'property', 'symbol', 'unit']) as k, unnest([polymer, property, symbol, unit]) as v from corpus) group by all), d as (select distinct entity_type as k, term from lex where term <> ''), o as (select a.k || '&' || b.k as pair, a.k as k1, b.k as k2, term from d a join d b using (term) where (a.k, b.k) in (('property', 'symbol'), ('property', 'unit'), ('unit', 'symbol'), ('polymer', 'material'))) select pair, o.term, coalesce(sum(n_sentences), 0)::bigint as n_sentences from o left join use_ on use_.term = o.term and use_.entity_type in (k1, k2) group by all",
    "lexicon_mentions": f"with {_mentions} select sid, st::int as st, en::int as en, entity, term from ment",
    "own_vocabulary": f"with {_own} select family, entity, count(*) as n, count(distinct term) as n_terms from ment join corpus using (sid) group by all",
    "mention_counts": f"with {_mentions}, {rows('m', 'o, k, v', [(i, k, v) for i, (k, v) in enumerate(data.CANONICAL_POLYMERS + data.CANONICAL_PROPERTIES)])}, last_ as (select k, arg_max(v, o) as v from m group by k) select entity, coalesce(v, term) as canonical, count(*) as n from ment left join last_ on k = term group by all",
    "bio_labels": f"with {_bio} select sid, string_agg(tok, ' ' order by p) as tokens, string_agg(label, ' ' order by p) as labels from cells group by sid",
    "bio_decode": f"with {_mentions} select sid, st::int as st, en::int as en, entity from ment",
    "label_id_counts": f"with {_bio}, {rows('lab', 'id, label', list(enumerate(data.LABELS)))} select id, lab.label, count(cells.label) as n from lab left join cells on cells.label = lab.label group by all",
    "packed_windows": f"with {_bio} select label, count(*) as n from cells group by label union all select '(whole and full)', 1",
    "events_asof_orders": f'with {_timed}, last_ as (select buyer, ordered, max(o_orderkey) as o_orderkey from o group by all) select event_id, e.user as "user", o_orderkey, ordered from e asof left join last_ on e.user = last_.buyer and e.ts >= last_.ordered',
    "events_in_orders": f'with {_timed} select e.user as "user", count(*) as n, sum(event_id)::bigint as events, sum(o_orderkey)::bigint as orders from e join o on e.user = o.buyer and ts >= ordered and ts < ordered + interval 20 minutes group by e.user',
    "distinct_sketches": "select event_type, count(*) as n, count(distinct user_id) as n_users, true as near, true as united_near from events group by event_type",
    "label_ids": f"with {_bio}, {rows('lab', 'id, label', list(enumerate(data.LABELS)))} select id, lab.label as label, id as back, count(cells.label) as n from lab left join cells on cells.label = lab.label group by all",
    "property_ranges": f"with {_pt}, {_measured}, used as (select symbol, count(*) as n_items from m group by all), r as (select pt.*, translate(data_range, '−–', '--') as r, coalesce(n_items, 0) as n_items from pt left join used using (symbol)) select property, symbol, {_lo} as lo, {_hi} as hi, {_lo} = {_hi} as degenerate, all_ = hp + coalesce(cp, 0) as adds_up, n_items from r",
    "property_rollup": f"with {_pt}, {_measured}, used as (select symbol, count(*) as n_items from m group by all), r as (select pt.*, translate(data_range, '−–', '--') as r, coalesce(n_items, 0) as n_items from pt left join used using (symbol)) select category, source, sum(hp)::bigint as hp, coalesce(sum(cp), 0)::bigint as cp, sum(all_)::bigint as total, count(*) as n, sum(n_items)::bigint as n_items from r group by rollup (category, source)",
    "property_symbols": f"with {_corpus}, {_pt}, used as (select property as symbol, count(*) as n from corpus group by all) select pt.property, pt.symbol, pt.symbol in (select v from prop) as known, coalesce(n, 0) as n from pt left join used on used.symbol = pt.symbol",
    "range_check": f"""with {_measured}, {rows("u", "name, kind, k, zero", MEASURES)}, s as (select m.*, {_lo} as lo, {_hi} as hi, a.kind as kind, b.kind as own_kind, l_quantity * a.k + a.zero as v, {_lo} * b.k + b.zero as l, {_hi} * b.k + b.zero as h from m left join u a on a.name = m.unit left join u b on b.name = coalesce(m.own_unit, ''))
  select l_orderkey, l_linenumber, symbol, l_quantity, unit, coalesce(kind = own_kind, false) as comparable, coalesce(kind = own_kind and v >= l - greatest(abs(l), abs(h)) * 1e-9 and v <= h + greatest(abs(l), abs(h)) * 1e-9, false) as in_range from s""",
    "unit_check": f"with {_measured}, {_spelled} select symbol, unit, count(*) as n, bool_and(coalesce(a.b, unit) is not distinct from coalesce(c.b, own_unit)) as compatible from m left join spelled a on a.a = unit left join spelled c on c.a = own_unit group by all",
    "unit_normalise": f"with {_measured}, {_spelled} select unit, count(*) as n, coalesce(b, unit) as canonical from m left join spelled on a = unit group by all",
    "unit_dimensions": f"with {_measured}, {_lex}, u as (select unit, count(*) as n from m group by all), d as (select distinct term as unit, section as dimension from lex where entity_type = 'unit' and term <> '') select * from u join d using (unit)",
    "ocr_repair": f"""with {_corpus}, {rows("mended", "text, after_", [("page 3 of the scan: T m near {value} • C, {polymer}", "page 3 of the scan: Tm near {value} °C, {polymer}"), ("{polymer} shows Δ S of {value} J mol^-1", "{polymer} shows ΔS of {value} J mol⁻¹"), ("reads T  c {value}degC beside {polymer}", "reads Tc {value}degC beside {polymer}"), ("{polymer} | {symbol} about {value}{unit} (scanned)", "{polymer} | {symbol} about {value}{unit} (scanned)")])},
  u as (select sid, after_, polymer, symbol, value, case unit when '·C' then '°C' when 'deg·C' then 'deg°C' else unit end as unit from (select *, split_part(sid, '-', 5) as value from corpus) join tpl using (tpl_id) join mended using (text))
  select sid, replace(replace(replace(replace(after_, '{{polymer}}', polymer), '{{symbol}}', symbol), '{{value}}', value), '{{unit}}', unit) as repaired from u""",
    "scanned_decode": f"""with {rows("code", "n, v", list(enumerate(["°C", "°C", "°C", "m²", "°C", "·Pa", "α", "\u2126", "\u00b5", "\u2212", "σ", "²"])))}, {listed("name", [f(n) for n in data.GREEK_NAMES for f in (str.lower, str.capitalize)])},
  {listed("letter", [x for n, a, b in zip(data.GREEK_NAMES, data.GREEK_LOWER, data.GREEK_UPPER) for x in ((n, n.capitalize()) if n in ("iota", "omicron") else (a, b))])}, {listed("pol", data.distinct_terms("polymer"))}
  select l_orderkey, l_linenumber, concat('unused ', letter.v, '-form of ', pol.v, ' (', letter.v, '2, ', name.v, 'ine): ', l_linenumber, ' ', code.v, ' at u+') as decoded
  from lineitem join code on code.n = l_partkey % 12 join name on name.n = (l_orderkey + l_linenumber) % 48 join letter on letter.n = name.n join pol on pol.n = l_suppkey % {_n["polymer"]}""",
    "greek_letters": f"""with {rows('t', 'n, name, lower, upper, named', [(i, n, a, b, n not in ('iota', 'omicron')) for i, (n, a, b) in enumerate(zip(data.GREEK_NAMES, data.GREEK_LOWER, data.GREEK_UPPER))])}, u as (select (l_orderkey + l_linenumber) % 48 as k, count(*) as c from lineitem group by all)
  select name, lower, upper, named, coalesce(case when named then (select c from u where k = 2 * n) end, 0) as n_lower, coalesce(case when named then (select c from u where k = 2 * n + 1) end, 0) as n_upper from t""",
    "negation_flag": rf"with {_corpus} select family, regexp_matches(sentence, '(?i)\b(no|not|without|absence|failed|unless|if)\b') as flagged, count(*) as n from corpus group by all",
    "section_classify": f"with {_headings}, {rows('sw', 'section, w', sorted({(s, w) for s, ws in data.SECTION_WORDS.items() for w in ws}))} select p_partkey, heading, section from h left join sw on w = lower(trim(heading))",
    "content_markers": rf"with {_headings}, {listed('cm', data.CONTENT_MARKERS)}, l as (select p_partkey, list_distinct(regexp_extract_all(lower('Section 2. Part of the ' || heading || ', in bold'), '\p{{N}}+|\p{{L}}+|[^\s]')) as t from h), e as (select p_partkey, unnest(t) as w from l) select p_partkey, string_agg(w, ',' order by w) as markers from e where w in (select v from cm) group by p_partkey",
    "log_route": f"with {_log} select category, category || '.log' as local_log_file, level, event_type, user_action, count(*) as n from lines group by all",
    "log_latest": f"with {_log} select message, level, category, file_name, line_number, context, log_id, synced as synced_to_appwrite from last_",
    "log_last": f"with {_log} select message, level, file_name, line_number from lines order by at_ desc, file_name desc, line_number desc, message desc limit 1",
    "log_required": f"with {_log} select column_ as \"column\", case when column_ = 'log_id' then (select count(*) from lines where log_id is null) else 0 end as n_null from (select unnest(['timestamp', 'level', 'message', 'source', 'event_type', 'user_action', 'file_name', 'line_number', 'local_log_file', 'synced_to_appwrite', 'log_id']) as column_)",
    "export_json_roundtrip": f"with {_log} select level, event_type, count(*) as n, count(log_id) as n_ids, count(*) filter (where synced) as n_synced from last_ group by all",
    "export_read_back": f"with {rows('t', 'name, extension, mime_type', data.EXPORT_FORMATS)}, o as (select o_orderstatus, count(*) as n, sum(o_custkey)::bigint as keys, sum(round(o_totalprice * 100)::bigint)::bigint as cents, max(o_orderdate) as last_day from orders group by all) select * from t, o",
    "log_roundtrip": f"with {_log} select message, level, category, file_name, line_number, context, log_id, synced as synced_to_appwrite from last_",
    "log_unsent": f"with {_log} select message, level, category, line_number from base where event_id % 7 = 0",
    "log_inserted": f"with {_log} select level, event_type, count(*) as n, count(distinct log_id) as n_ids, count(*) filter (where synced) as n_synced from lines where write_ = 2 group by all",
    "log_context": """with c as (select event_id, props, case event_id % 6 when 0 then 'object' when 1 then 'object' when 2 then 'text' when 3 then 'none' when 4 then 'text' else 'none' end as context_kind, (props::json ->> 'k')::bigint as k from events)
  select context_kind, count(*) as n, count(*) filter (where context_kind = 'text') as n_text, count(k) filter (where context_kind = 'object') as n_k, (sum(k) filter (where context_kind = 'object'))::bigint as sum_k from c group by all""",
    "export_formats": f"with {rows('t', 'n, name, extension, mime_type', [(i, *f) for i, f in enumerate(data.EXPORT_FORMATS)])} select name, extension, mime_type, (select count(*) from orders where o_orderkey % {len(data.EXPORT_FORMATS)} = n) as n_orders from t",
    "env_missing": f"with {listed('r', data.REQUIRED_ENV)} select c_custkey, v as name from customer join r on (c_custkey + 3 * n) % 4 = 0",
}
