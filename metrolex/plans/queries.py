"""One query for each operator or group of operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import data, tables
from ..functions import text, units, values
from ..operators import lookup, mentions, packing, sketches, timejoin
from ..sources import exports, logs
from ..storage import fresh_path, stored
from ..streaming import logs as stream
from . import corpus


def corpus_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four measurement patterns over rendered sentences."""
    s = corpus.sentences(spark, sf_dir)

    def of(name: str, pattern: str):
        return F.transform(text.measurements(F.col("sentence"), pattern), lambda m: F.struct(F.lit(name).alias("pattern"), m["number"].alias("number"), m["unit"].alias("found_unit")))

    found = F.flatten(F.array(*(of(*p) for p in data.MEASUREMENT_PATTERNS)))
    rows = s.select("polymer", F.explode(found).alias("m")).select("polymer", "m.*")
    return rows.groupBy("polymer", "pattern", "found_unit").agg(F.count("*").alias("n"), F.sum(F.col("number").cast("double").cast("long")).alias("total"))


def _template_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tpl_id, family, text, n): templates with the number of sentences made of each."""
    used = corpus.sentences(spark, sf_dir).groupBy("tpl_id").agg(F.count("*").alias("n"))
    return tables.templates(spark).join(used, "tpl_id", "left").na.fill(0, ["n"])


def template_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = text.slots(F.col("text"))
    return _template_use(spark, sf_dir).select("tpl_id", F.array_join(slots, ",").alias("slots"), F.size(slots).cast("long").alias("n_slots"), "n")


def template_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    signature = F.array_join(F.array_sort(text.slots(F.col("text"))), ",").alias("signature")
    return _template_use(spark, sf_dir).groupBy(signature).agg(F.count("*").alias("n"), F.sum("n").alias("n_sentences"))


def template_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _template_use(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_distinct"), F.sum("n").alias("n_sentences"))


def complex_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.complex_sentences(spark, sf_dir)


def negatives_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.negatives(spark, sf_dir)


def negatives_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when author names and non-properties are excluded."""
    left = lookup.excluded(lookup.excluded(corpus.negatives(spark, sf_dir), "distractor", data.AUTHOR_NAMES), "distractor", data.NON_PROPERTIES)
    return left.groupBy("kind", "distractor").agg(F.count("*").alias("n"))


def value_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers found in sentences, parsed."""
    found = corpus.valued(spark, sf_dir).select(F.inline(values.found(F.col("told"))))
    return found.groupBy(*found.columns).agg(F.count("*").alias("n"))


def _canonical_use(spark: SparkSession, sf_dir: str, kind: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Canonical names of all surfaces, with the number of sentences that have each."""
    names = tables.terms(spark, kind, "surface").select("surface").union(tables.table(spark, [(k,) for k, _ in pairs], "surface string")).distinct()
    used = corpus.sentences(spark, sf_dir).groupBy(F.col(kind).alias("surface")).agg(F.count("*").alias("n"))
    return lookup.canonicalise(names.join(used, "surface", "left").na.fill(0, ["n"]), "surface", pairs)


def canonical_polymers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical_use(spark, sf_dir, "polymer", data.CANONICAL_POLYMERS)


def canonical_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical_use(spark, sf_dir, "property", data.CANONICAL_PROPERTIES)


def _term_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_type, term, n_sentences) of terms that stand in sentences by their type."""
    kinds = ("polymer", "property", "symbol", "unit")
    stand = F.array(*(F.struct(F.lit(k).alias("entity_type"), F.col(k).alias("term")) for k in kinds))
    return corpus.sentences(spark, sf_dir).select(F.inline(stand)).groupBy("entity_type", "term").agg(F.count("*").alias("n_sentences"))


def lexicon_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms listed more than once, with the sentences that have them."""
    dups = tables.lexicon(spark).groupBy("entity_type", "term").agg(F.count("*").alias("n")).where("n > 1")
    return dups.join(_term_use(spark, sf_dir), ["entity_type", "term"], "left").na.fill(0, ["n_sentences"])


def lexicon_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each type, listed, distinct and in use."""
    listed = tables.lexicon(spark).groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("term").alias("n_distinct"))
    used = _term_use(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("n_used"), F.sum("n_sentences").alias("n_sentences"))
    return listed.join(used, "entity_type", "left").na.fill(0, ["n_used", "n_sentences"])


def lexicon_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of two types, with the sentences that have them as either."""
    lex = tables.lexicon(spark)
    pairs = [("property", "symbol"), ("property", "unit"), ("unit", "symbol"), ("polymer", "material")]
    both = reduce(DataFrame.unionByName, [lookup.overlap(lex, a, b).select(F.lit(f"{a}&{b}").alias("pair"), F.array(F.lit(a), F.lit(b)).alias("types"), "term") for a, b in pairs])
    used = both.select("pair", "term", F.explode("types").alias("entity_type")).join(_term_use(spark, sf_dir), ["entity_type", "term"], "left")
    return used.groupBy("pair", "term").agg(F.coalesce(F.sum("n_sentences"), F.lit(0)).alias("n_sentences"))


def lexicon_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.mentions(corpus.sentences(spark, sf_dir), tables.lexicon(spark))


def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.canonicalise(lexicon_mentions(spark, sf_dir), "term", data.CANONICAL_POLYMERS + data.CANONICAL_PROPERTIES)
    return found.groupBy("entity", "canonical").agg(F.count("*").alias("n"))


def own_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions in a corpus rendered and matched with a vocabulary from files."""
    words = corpus.own_vocabulary(spark, sf_dir)
    found = mentions.counts(corpus.sentences(spark, sf_dir, words), words.lexicon, "family")
    return found.groupBy("family", "entity").agg(F.sum("n").alias("n"), F.countDistinct("term").alias("n_terms"))


def bio_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = mentions.bio(corpus.sentences(spark, sf_dir), tables.lexicon(spark))
    return b.select("sid", F.array_join("tokens", " ").alias("tokens"), F.array_join("labels", " ").alias("labels"))


def bio_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.decode_bio(mentions.bio(corpus.sentences(spark, sf_dir), tables.lexicon(spark)))


def label_id_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each label id."""
    b = mentions.bio(corpus.sentences(spark, sf_dir), tables.lexicon(spark)).select(F.explode("labels").alias("label"))
    return b.groupBy("label").agg(F.count("*").alias("n")).join(tables.labels(spark), "label", "right").select("id", "label", F.coalesce("n", F.lit(0)).alias("n"))


def packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled sentences packed into windows of 128 tokens: tokens of each label, and a row that says 1 if windows are whole, within size and over 95 % full."""
    p = packing.packed(mentions.bio(corpus.sentences(spark, sf_dir), tables.lexicon(spark)), 128)
    whole = (F.size("tokens") == F.size("labels")) & (F.size("tokens") == F.size("segments")) & (F.col("n_tokens") <= 128) & (F.array_max("segments") == F.size("sids"))
    p = stored(p.select("labels", "n_tokens", whole.alias("whole")))
    good = p.agg((F.bool_and("whole") & (F.sum("n_tokens") > 0.95 * 128 * F.count("*"))).cast("long").alias("n"))
    return p.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")).unionByName(good.select(F.lit("(whole and full)").alias("label"), "n"))


def _timed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events, and orders moved to their month; one user has half of either."""
    e, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "orders"))
    events = e.select("event_id", F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("user_id")).alias("user"), "ts")
    days = F.pmod(F.datediff("o_orderdate", F.lit("1995-01-01")), F.lit(30))
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(days, F.pmod("o_orderkey", F.lit(24)).cast("int"))
    return events, o.select(F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(F.pmod("o_custkey", F.lit(150))).alias("buyer"), at.alias("ordered"), "o_orderkey", (at + F.make_dt_interval(mins=F.lit(20))).alias("until"))


def events_asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last order before it."""
    events, orders = _timed(spark, sf_dir)
    return timejoin.asof_join(events, orders.drop("until"), "user", "buyer", "ts", "ordered").select("event_id", "user", "o_orderkey", "ordered")


def events_in_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within twenty minutes after an order of their user, by user."""
    events, orders = _timed(spark, sf_dir)
    found = timejoin.interval_join(events, orders, "user", "buyer", "ts", "ordered", "until", 1200)
    return found.groupBy("user").agg(F.count("*").alias("n"), F.sum("event_id").alias("events"), F.sum("o_orderkey").alias("orders"))


def distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by event type from sketches of each day: whether they are within 3 % of the exact number, and two halves of the days within 3 % of all at once."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))
    days = stored(sketches.sketched(e, "user_id", ["event_type", "day"]))
    half = F.dayofmonth("day") <= 15
    one = sketches.estimated(sketches.united(days, ["event_type"]))
    two = sketches.estimated(sketches.added(sketches.united(days.where(half), ["event_type"]), sketches.united(days.where(~half), ["event_type"]), ["event_type"]), "n_later")
    exact = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"))
    near = lambda c: F.abs(F.col(c) / F.col("n_users") - 1) < 0.03
    both = exact.join(one.select("event_type", "n", "n_distinct"), "event_type").join(two.select("event_type", "n_later"), "event_type")
    return both.select("event_type", "n", "n_users", near("n_distinct").alias("near"), near("n_later").alias("united_near"))


def label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all tokens as ids and back."""
    both = lookup.inverted(tables.labels(spark), "id", "label").select(F.map_entries("mapping").alias("ids"), "inverse")
    known = both.select(F.inline("ids").alias("id", "label"), "inverse").select("id", "label", F.element_at("inverse", F.col("label")).alias("back"))
    tokens = mentions.bio(corpus.sentences(spark, sf_dir), tables.lexicon(spark)).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return known.join(tokens, "label", "left").select("id", "label", "back", F.coalesce("n", F.lit(0)).alias("n"))


def _property_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The property table with the number of line items measured for each symbol."""
    used = _measured(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n_items"))
    return tables.property_table(spark).join(used, "symbol", "left").na.fill(0, ["n_items"])


def property_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = values.interval(F.col("data_range"))
    return _property_use(spark, sf_dir).select("property", "symbol", lo.alias("lo"), hi.alias("hi"), (lo == hi).alias("degenerate"), (F.col("all_") == F.col("hp") + F.coalesce("cp", F.lit(0))).alias("adds_up"), "n_items")


def property_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _property_use(spark, sf_dir).rollup("category", "source")
    return t.agg(F.sum("hp").alias("hp"), F.coalesce(F.sum("cp"), F.lit(0)).alias("cp"), F.sum("all_").alias("total"), F.count("*").alias("n"), F.sum("n_items").alias("n_items"))


def property_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a property's symbol is in the property vocabulary, and how many sentences have it as a property."""
    names = tables.terms(spark, "property", "symbol").select("symbol", F.lit(True).alias("known"))
    used = corpus.sentences(spark, sf_dir).groupBy(F.col("property").alias("symbol")).agg(F.count("*").alias("n"))
    return tables.property_table(spark).join(names, "symbol", "left").join(used, "symbol", "left").select("property", "symbol", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("n", F.lit(0)).alias("n"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantity in some unit for each line item, beside a property's unit and range; measures are worked out in the vocabulary, once a unit."""
    rows = [(i, r[1], r[2], r[4]) for i, r in enumerate(data.PROPERTY_TABLE)]
    lo, hi = values.interval(F.col("data_range"))
    properties = tables.table(spark, rows, "n int, symbol string, own_unit string, data_range string").withColumns({"lo": lo, "hi": hi, "own": units.measure(F.col("own_unit"))})
    vocabulary = tables.terms(spark, "unit", "unit").withColumn("measure", units.measure(F.col("unit")))
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    df = corpus.picked(df, properties, F.col("l_partkey"), len(rows))
    return corpus.picked(df, vocabulary, F.col("l_suppkey"), len(data.distinct_terms("unit")))


def range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag, not a filter: ranges carry one digit. A quantity is converted to its property's unit; one of another kind is in no range."""
    m = _measured(spark, sf_dir)
    inside = units.within(F.col("l_quantity"), F.col("measure"), F.col("lo"), F.col("hi"), F.col("own"))
    return m.select("l_orderkey", "l_linenumber", "symbol", "l_quantity", "unit", units.same_dimension(F.col("measure"), F.col("own")).alias("comparable"), F.coalesce(inside, F.lit(False)).alias("in_range"))


def unit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements by property and unit, and whether the unit is the property's."""
    m = units.normalise(units.normalise(_measured(spark, sf_dir), "unit", "is_unit"), "own_unit", "should")
    return m.groupBy("symbol", "unit").agg(F.count("*").alias("n"), F.bool_and(F.col("is_unit").eqNullSafe(F.col("should"))).alias("compatible"))


def _unit_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, n): units of line items with how many have each."""
    return _measured(spark, sf_dir).groupBy("unit").agg(F.count("*").alias("n"))


def unit_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.normalise(_unit_use(spark, sf_dir), "unit")


def unit_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of line items in each section that lists them."""
    return _unit_use(spark, sf_dir).join(units.dimensions(tables.lexicon(spark)), "unit")


def ocr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpus.sentences(spark, sf_dir).where("family = 'ocr'")
    return s.select("sid", text.repair_spaced(F.col("sentence")).alias("repaired"))


def scanned_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned sentences with code points decoded and Greek letters written as letters."""
    return corpus.scanned(spark, sf_dir).select("l_orderkey", "l_linenumber", text.greek_letters(text.decode_text(F.col("scanned"))).alias("decoded"))


def greek_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters with their names, and how many decoded sentences have each letter."""
    rows = [(n, lo, up, n not in data.GREEK_UNNAMED) for n, lo, up in zip(data.GREEK_NAMES, data.GREEK_LOWER, data.GREEK_UPPER)]
    decoded = corpus.scanned(spark, sf_dir).select(text.greek_letters(F.substring_index("scanned", "-form", 1)).alias("d"))
    letters = decoded.select(F.explode(F.array_distinct(F.split("d", ""))).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    known = tables.table(spark, rows, "name string, lower string, upper string, named boolean")
    one = lambda c: letters.select(F.col("letter").alias(c), F.col("n").alias(f"n_{c}"))
    return known.join(one("lower"), "lower", "left").join(one("upper"), "upper", "left").na.fill(0).select("name", "lower", "upper", "named", "n_lower", "n_upper")


def negation_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sentences(spark, sf_dir).groupBy("family", text.has_cue(F.col("sentence")).alias("flagged")).agg(F.count("*").alias("n"))


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = sorted({w for ws in data.SECTION_WORDS.values() for w in ws}) + ["appendix"]
    df = corpus.picked(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"), tables.numbered(spark, words, "w"), F.col("p_partkey"), len(words))
    return df.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.upper("w")).otherwise(F.concat(F.lit("  "), F.initcap("w"), F.lit(" "))).alias("heading"))


def section_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.classify_headings(_headings(spark, sf_dir), "heading")


def content_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _headings(spark, sf_dir).withColumn("line", F.concat(F.lit("Section 2. Part of the "), F.col("heading"), F.lit(", in bold")))
    return df.select("p_partkey", F.array_join(lookup.content_markers("line"), ",").alias("markers"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes an event: sent or refused; every seventh event has no second line."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    kind = F.when(F.col("user_id") % 4 == 0, "api").when(F.col("user_id") % 4 == 1, "user").when(F.col("user_id") % 4 == 2, "unknown")
    message = F.concat(F.lit("event "), F.col("event_id").cast("string"))
    first = logs.records(e, level, message, F.lit("events"), at=F.col("ts"), file=F.concat(F.lit("/srv/app/"), F.col("event_type"), F.lit(".py")), line=F.col("event_id") % 100, category_col=kind, event_type=F.col("event_type"), user_action=F.col("event_type") == "click", context=F.col("props"))
    number = F.substring_index("message", " ", -1).cast("long")
    return first.unionByName(logs.sent(first, number % 3 != 0).where(number % 7 != 0))


def log_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(spark, sf_dir).groupBy("category", "local_log_file", "level", "event_type", "user_action").agg(F.count("*").alias("n"))


def log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.latest(log_lines(spark, sf_dir)).select("message", "level", "category", "file_name", "line_number", "context", "log_id", "synced_to_appwrite")


def log_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.last_line(log_lines(spark, sf_dir)).select("message", "level", "file_name", "line_number")


def log_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that lack a required column, by column."""
    lines = log_lines(spark, sf_dir)
    return lines.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).isNull().cast("long").alias("null_")) for c in logs.REQUIRED)))).groupBy("column").agg(F.sum("null_").alias("n_null"))


def export_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON text and read again."""
    latest = logs.latest(log_lines(spark, sf_dir)).drop("category")
    again = latest.select(F.from_json(F.to_json(F.struct(*latest.columns), {"ignoreNullFields": "false"}), logs.SCHEMA).alias("r")).select("r.*")
    return again.groupBy("level", "event_type").agg(F.count("*").alias("n"), F.count("log_id").alias("n_ids"), F.count(F.when(F.col("synced_to_appwrite"), 1)).alias("n_synced"))


def export_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written in every registered format and read again: rows and sums of each."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = []
    for name, extension, mime_type in data.EXPORT_FORMATS:
        path = fresh_path(spark, f"export-{name}")
        exports.export(orders.select(F.concat_ws("|", *orders.columns).alias("value")) if name == "txt" else orders, path, name)
        if name == "txt":
            parts = F.split("value", "[|]")
            again = exports.read_export(spark, path, name).select(*(parts[i].cast(f.dataType).alias(f.name) for i, f in enumerate(orders.schema)))
        else:
            again = exports.read_export(spark, path, name, orders.schema)
        sums = again.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.max("o_orderdate").alias("last_day"))
        found.append(sums.select(F.lit(name).alias("name"), F.lit(extension).alias("extension"), F.lit(mime_type).alias("mime_type"), "o_orderstatus", "n", "keys", "cents", "last_day"))
    return reduce(DataFrame.unionByName, found)


def log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both writes of each event as JSON lines by category, read again; the last write wins."""
    folder = fresh_path(spark, "log")
    lines = log_lines(spark, sf_dir)
    logs.create(spark, folder)
    logs.append(lines.where("log_id is null"), folder)
    logs.append(lines.where("log_id is not null"), folder)
    return logs.latest(logs.read(spark, folder)).select("message", "level", "category", "file_name", "line_number", "context", "log_id", "synced_to_appwrite")


def log_unsent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose second line never came, found by the stream over the log's files."""
    folder, out = fresh_path(spark, "log"), fresh_path(spark, "unsent")
    lines = log_lines(spark, sf_dir)
    logs.append(lines, folder)
    logs.append(stream.closing_lines(lines).withColumn("category", F.lit("system")), folder)
    files = 1_000_000  # a finite log is one batch: its files are in no order of time
    first, second = stream.read_stream(spark, folder, files), stream.read_stream(spark, folder, files)
    stream.run_available(stream.unsent_stream(first, second), out, fresh_path(spark, "checkpoint"))
    return spark.read.schema("message string, level string, category string, line_number int, source string").parquet(out).where("source != 'closing'").drop("source")


def log_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second lines streamed into a table, its last batch played twice."""
    folder, path = fresh_path(spark, "log"), fresh_path(spark, "inserted")
    logs.append(log_lines(spark, sf_dir).where("log_id is not null"), folder)
    stream.insert_stream(stream.read_stream(spark, folder), path, fresh_path(spark, "checkpoint"))
    stream.insert_batch(logs.read(spark, folder), 0, path)
    return stream.read_inserted(spark, path).groupBy("level", "event_type").agg(F.count("*").alias("n"), F.countDistinct("log_id").alias("n_ids"), F.count(F.when(F.col("synced_to_appwrite"), 1)).alias("n_synced"))


def log_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts written as object, as text, broken, blank or not at all, read as variants: what they are, with a typed field."""
    folder = fresh_path(spark, "log")
    i, props = F.col("event_id"), F.col("props")
    kind = F.pmod(i, F.lit(6))
    odd = F.when(kind == 1, props).when(kind == 2, F.substring(props, 1, 4)).when(kind == 3, F.lit(" ")).when(kind == 4, F.concat(F.lit("event "), i.cast("string")))
    context = F.when(kind == 0, F.parse_json(props)).when(kind < 5, odd.cast("variant"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.select(F.concat(F.lit("event "), i.cast("string")).alias("message"), context.alias("context")).write.json(folder)
    found = logs.context_fields(logs.structured(logs.read_contexts(spark, folder)), {"$.k": "long"})
    return found.groupBy("context_kind").agg(F.count("*").alias("n"), F.count("context_text").alias("n_text"), F.count("k").alias("n_k"), F.sum("k").alias("sum_k"))


def export_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered formats with the orders that would go out in each, dealt by key."""
    formats = exports.formats(spark)
    dealt = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    named = corpus.picked(dealt, tables.numbered(spark, [f[0] for f in data.EXPORT_FORMATS], "name"), F.col("o_orderkey"), len(data.EXPORT_FORMATS))
    return formats.join(named.groupBy("name").agg(F.count("*").alias("n_orders")), "name", "left").na.fill(0)


def env_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required keys that customers' environments lack; every customer has set some."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    keys = tables.numbered(spark, data.REQUIRED_ENV, "name")
    given = customers.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(len(data.REQUIRED_ENV) - 1))).alias("n")).where((F.col("c_custkey") + 3 * F.col("n")) % 4 != 0)
    return lookup.missing_by(customers, given.join(keys, "n").drop("n"), "c_custkey")


QUERIES = {f.__name__: f for f in (
    corpus_measurements, template_slots, template_signatures, template_family_counts, complex_render, negatives_render, negatives_excluded, value_parse, canonical_polymers, canonical_properties,
    lexicon_dups, lexicon_sizes, lexicon_overlap, lexicon_mentions, mention_counts, own_vocabulary, bio_labels, bio_decode, label_id_counts, packed_windows, events_asof_orders, events_in_orders, distinct_sketches, label_ids, property_ranges, property_rollup, property_symbols, range_check, unit_check,
    unit_normalise, unit_dimensions, ocr_repair, scanned_decode, greek_letters, negation_flag, section_classify, content_markers, log_route, log_latest, log_last, log_required, log_roundtrip, log_unsent, log_inserted, log_context, export_json_roundtrip, export_read_back, export_formats, env_missing,
)}
