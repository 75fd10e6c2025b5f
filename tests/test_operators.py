import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metrolex import data, tables
from metrolex.operators import automaton, lookup, mentions
from metrolex.plans import corpus, queries
from metrolex.plans.oracle import ORACLE
from metrolex.sources import vocabulary


def _sentences(spark, *texts):
    return tables.table(spark, list(enumerate(texts)), "sid int, sentence string")


def test_longest_leftmost_and_units(spark):
    s = _sentences(spark, "The glass transition temperature (Tg) of poly(methyl methacrylate) was 78°C.", "E = 5 MPa", "nothing here", "")
    got = {(r["sid"], r["entity"], r["term"].replace("° C", "°C")) for r in mentions.mentions(s, tables.lexicon(spark)).collect()}  # both spellings have the same tokens
    assert got == {(0, "PROPERTY", "glass transition temperature"), (0, "PROPERTY", "Tg"), (0, "POLYMER", "poly(methyl methacrylate)"), (0, "VALUE", "78"), (0, "UNIT", "°C"), (1, "PROPERTY", "E"), (1, "VALUE", "5"), (1, "UNIT", "MPa")}


def test_bio_round_trip_and_scores(spark):
    s = _sentences(spark, "polyvinylidene fluoride showed Tg = 40 kJ/mol", "PE PP")
    b = mentions.bio(s, tables.lexicon(spark))
    rows = {r["sid"]: (list(r["tokens"]), list(r["labels"])) for r in b.collect()}
    assert rows[1] == (["PE", "PP"], ["B-POLYMER", "B-POLYMER"]) and rows[0][1][:2] == ["B-POLYMER", "I-POLYMER"]
    truth, again = mentions.mentions(s, tables.lexicon(spark)), mentions.decode_bio(b)
    assert sorted(map(tuple, truth.select("sid", "st", "en", "entity").collect())) == sorted(map(tuple, again.collect()))
    assert all(r["fp"] == r["fn"] == 0 and r["tp"] for r in mentions.span_scores(truth, again).collect())
    assert mentions.token_windows(b, 4, 2).where("sid = 0").count() == 4


def test_decode_without_a_beginning(spark):
    df = spark.createDataFrame([(1, ["I-UNIT", "I-UNIT", "O", "B-VALUE", "I-UNIT"])], "sid int, labels array<string>")
    assert sorted(tuple(r) for r in mentions.decode_bio(df).collect()) == [(1, 0, 2, "UNIT"), (1, 3, 4, "VALUE"), (1, 4, 5, "UNIT")]


def test_canonical_names_last_wins_one_hop(spark):
    df = tables.table(spark, [("Tg",), ("tensile strength",), ("glass transition temperature",), ("other",), (None,)], "s string")
    got = {r["s"]: r["canonical"] for r in lookup.canonicalise(df, "s", data.CANONICAL_PROPERTIES).collect()}
    assert got == {"Tg": "glass transition temperature", "tensile strength": "tensile strength", "glass transition temperature": "Tg", "other": "other", None: None}


def test_inverse_and_missing(spark):
    r = lookup.inverted(tables.labels(spark), "id", "label").first()
    assert all(r["inverse"][v] == k for k, v in r["mapping"].items()) and len(r["mapping"]) == 13
    assert lookup.missing_keys(spark, data.REQUIRED_ENV).count() == 0
    os.environ["METROLEX_SET"] = "x"
    assert sorted(map(tuple, lookup.environment(spark, ["METROLEX_SET", "METROLEX_UNSET"]).collect())) == [("METROLEX_SET", True), ("METROLEX_UNSET", False)]


def test_matching_is_not_a_nested_loop(spark):
    s = _sentences(spark, "PE")
    plan = mentions.mentions(s, tables.lexicon(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_large_vocabularies_are_joined_alike(spark, tmp_path):
    """Terms of up to 21 tokens from a file, a third of them behind one first token: in one part, in parts that are sent, in parts that tasks read from the folder, and in joins."""
    r = random.Random(3)
    words = [f"w{chr(97 + i)}" for i in range(20)]
    terms = sorted({" ".join((["wa"] if r.random() < 0.3 else []) + [r.choice(words) for _ in range(r.randint(1, 20))]) for _ in range(3000)}) + ["5", "=", "wa / wb", "wa/wb", "é", "12 wa"]
    with open(tmp_path / "lexicon.tsv", "w") as f:
        f.write("entity_type\tord\tterm\tsection\n" + "".join(f"{r.choice(['polymer', 'unit', 'material', 'symbol'])}\t{i}\t{t}\ts\n" for i, t in enumerate(terms)) + "material\t9\twa / wb\ts\n")
    lexicon = vocabulary.read_lexicon(spark, str(tmp_path / "lexicon.tsv"))
    texts = [" ".join(r.choice([r.choice(terms), r.choice(words), "12", "="]) for _ in range(12)) for _ in range(60)]
    s = _sentences(spark, *texts, "", " ", "5", "= é 5", None, *texts[:2])
    want = sorted(map(tuple, mentions.joined(s, lexicon).select("sid", F.inline("spans")).collect()))
    for sizes in ({}, {"part_terms": 150}, {"part_terms": 150, "sent_bytes": 0}, {"part_terms": 40, "sent_bytes": 0}):
        assert sorted(map(tuple, mentions.mentions(s, lexicon, **sizes).collect())) == want, sizes
    assert any(en - st > 15 for _, st, en, *_ in want)
    b = {x["sid"]: x for x in mentions.bio(s, lexicon, part_terms=150, sent_bytes=0).collect()}
    assert list(b[60]["tokens"]) == [] and list(b[62]["labels"]) in (["B-VALUE"], ["B-SYMBOL"], ["B-POLYMER"], ["B-MATERIAL"])
    assert mentions.mentions(s, lexicon.limit(0)).where("entity != 'VALUE'").count() == 0 and mentions.mentions(s.limit(0), lexicon).count() == 0


def test_no_shuffle_of_sentences(spark):
    s = _sentences(spark, "PE").repartition(3)
    plan = mentions.mentions(s, tables.lexicon(spark), sent_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "sid" not in "".join(x for x in plan.split("\n") if "Exchange hash" in x)


def test_automaton_by_brute_force():
    """Random automata and batches against every sentence's own search, text by text."""
    r = random.Random(11)
    for _ in range(60):
        vocab = {(tuple(r.choice("abc5=é") for _ in range(r.randint(1, 4))), r.choice(["UNIT", "POLYMER", "MATERIAL"])) for _ in range(r.randrange(12))}
        rows = [(list(t), data.TYPE_PRIORITY.index(e) + 1, e, " ".join(t)) for t, e in sorted(vocab)]
        cut = r.randrange(len(rows) + 1)
        parts = [automaton.Part.of(*map(list, zip(*x))) if x else automaton.Part.of([], [], [], []) for x in (rows[:cut], rows[cut:])]
        batch = [[r.choice("abc5=é") for _ in range(r.randrange(9))] for _ in range(7)]
        got = automaton.spans(pa.array(batch, pa.list_(pa.string())).slice(2), automaton.Automaton([], parts)).to_pylist()
        for t, found in zip(batch[2:], got):
            want, i = [], 0
            num = lambda j: 0 <= j < len(t) and t[j] == "5"
            while i < len(t):
                at = [(-len(x), p, e, s) for x, p, e, s in rows if t[i : i + len(x)] == x and (num(i - 1) if e == "UNIT" else len(s) != 1 or num(i - 1) or num(i + 1) or "=" in (t[i - 1] if i else "", t[i + 1] if i + 1 < len(t) else ""))]
                at += [(-1, automaton.VALUE, "VALUE", "5")] if num(i) else []
                if at:
                    n, _, e, s = min(at)
                    want.append({"st": i, "en": i - n, "entity": e, "term": s})
                    i -= n
                else:
                    i += 1
            assert found == want


def test_own_vocabulary_is_numbered_and_rendered(spark, tmp_path):
    rows = [("polymer", 3, "b", "s"), ("polymer", 1, "c \\ \"x\"", "s"), ("polymer", 2, "b", "t"), ("polymer", 9, "", "s"), ("unit", 0, "K", "s"), ("property", 5, "é", None)]
    vocabulary.write_lexicon(spark.createDataFrame(rows, "entity_type string, ord int, term string, section string").repartition(3), str(tmp_path / "l"))
    vocabulary.write_templates(spark.createDataFrame([(5, "f", "{polymer}/{symbol} {unit}"), (2, "g", "{value}")], "tpl_id int, family string, text string"), str(tmp_path / "t"))
    own = vocabulary.read_vocabulary(spark, str(tmp_path / "l"), str(tmp_path / "t"))
    assert sorted(map(tuple, own.lexicon.collect()), key=str) == sorted(((k, o, t or None, s) for k, o, t, s in rows), key=str)  # no term is as good as an empty one
    terms, n = own.terms("polymer", "p")
    assert n == 2 and sorted(map(tuple, terms.collect())) == [(0, rows[1][2]), (1, "b")]
    assert own.terms("symbol", "s")[1] == 0 and sorted((r["n"], r["tpl_id"]) for r in own.sentences()[0].collect()) == [(0, 2), (1, 5)]
    s = corpus.sentences(spark, "/root/testdata/sf0.001", own)
    assert {r["sentence"] for r in s.where("tpl_id = 5").select("sentence").distinct().collect()} == {"b/{symbol} K", rows[1][2] + "/{symbol} K"}
    many, n = tables.ranked_rows(spark.range(1000).select(F.xxhash64("id").alias("h")), "h")
    assert n == 1000 and [r["n"] for r in many.orderBy("h").collect()] == list(range(1000))
    with pytest.raises(Exception, match="tab"):
        vocabulary.write_templates(spark.createDataFrame([(1, "f", "a\tb")], "tpl_id int, family string, text string"), str(tmp_path / "bad"))


def test_labels_and_back_are_no_row_by_row_folds(spark):
    df = spark.createDataFrame([(1, ["I-A", None, "B-A", "B-A", "I-B", "I-B", "O", "I-B"]), (2, ["I-B"]), (3, []), (4, None), (None, ["B-A", "I-A"])], "sid long, labels array<string>")
    got = mentions.decode_bio(df)
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, 0, 1, "A"), (1, 2, 3, "A"), (1, 3, 4, "A"), (1, 4, 6, "B"), (1, 7, 8, "B"), (2, 0, 1, "B"), (None, 0, 2, "A")]))


def test_batches_do_not_read_the_vocabulary_again(spark, monkeypatch):
    """A vocabulary in slots that no task may hold, met by many batches: as in joins, and its table is read once a worker."""
    r = random.Random(5)
    terms = [f"{r.choice(['old', 'new', 'hot'])} {r.choice(['ring', 'bolt'])} {i}" for i in range(3000)]
    lexicon = tables.table(spark, [("polymer", i, t, "s") for i, t in enumerate([*terms, "old", "new ring", *terms[:50]])] + [("unit", 0, "m / s", "s"), ("unit", 1, "m/s", "s"), ("symbol", 0, "E", "s")], "entity_type string, ord int, term string, section string")
    texts = [f"{r.choice(terms)} beside {r.choice(terms)} new ring {i}: E = 5 m/s, old" for i in range(300)]
    want = {(x["sid"], *span) for x in mentions.joined(_sentences(spark, *texts), lexicon).collect() for span in x["spans"]}
    given = automaton.built(mentions.compiled(lexicon).select("toks", mentions._priority(F.col("entity")).cast("int").alias("prio"), "entity", "term"), part_terms=100, sent_bytes=0)
    toks = [x["t"] for x in _sentences(spark, *texts).orderBy("sid").select(mentions.tokens(F.col("sentence")).alias("t")).collect()]
    reads, dataset = [], automaton.ds.dataset
    monkeypatch.setattr(automaton, "HELD_BYTES", 0)
    monkeypatch.setattr(automaton.ds, "dataset", lambda *a, **k: (reads.append(a), dataset(*a, **k))[1])
    got = [automaton.spans(pa.array(toks[i : i + 30], pa.list_(pa.string())), given()).to_pylist() for i in range(0, 300, 30)]
    assert {(30 * b + i, *m.values()) for b, rows in enumerate(got) for i, row in enumerate(rows) for m in row} == want
    assert len(reads) <= 1


def test_hashes_that_agree_by_chance(spark, monkeypatch):
    """With hashes of two bits, terms are still told apart by their tokens."""
    monkeypatch.setattr(automaton, "token_hashes", lambda words: np.array([len(w) % 4 for w in words], np.uint64))
    prefixes = automaton.Hashed.__new__(automaton.Hashed)
    words = [["aa", "b"], ["cc", "d"], ["aa"], ["e"], ["ff", "g", "hh"]]
    hashes = [np.zeros(1, np.uint64)] * len(words)
    for i, t in enumerate(words):
        for h in automaton.token_hashes(t):
            hashes[i] = automaton.moved(hashes[i], np.array([h]))
    between = automaton.moved(automaton.moved(np.zeros(1, np.uint64), automaton.token_hashes(["ff"])), automaton.token_hashes(["g"]))
    states = sorted({int(h[0]) for h in [*hashes, between]})
    ends = [[{"prio": 1, "term": " ".join(t), "key": None} for i, t in enumerate(words) if int(hashes[i][0]) == x] for x in states]
    prefixes.slots, prefixes.touched = 1, 0
    prefixes.rows = {0: pa.record_batch([pa.array(states, pa.uint64()), pa.array(ends, pa.list_(automaton._ENDED))], names=["state", "ends"])}
    prefixes.states = {0: prefixes.rows[0].column(0).to_numpy()}
    batch = [["aa", "d", "cc", "d"], ["ii", "b", "aa"], ["ff", "g", "hh"], ["ff", "g", "kk"]]
    monkeypatch.setattr(automaton.Automaton, "visited", lambda self: [prefixes])
    got = automaton.spans(pa.array(batch, pa.list_(pa.string())), automaton.Automaton([], None)).to_pylist()
    assert [[m["term"] for m in row] for row in got] == [["aa", "cc d"], ["aa"], ["ff g hh"], []]


def test_counts_of_own_vocabulary(spark, tmp_path):
    """Line items alike in all keys count as often as they are there, as in SQL; sentences are not joined again by their ids."""
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        (df.union(df.limit(40)).union(df.limit(7)) if name == "lineitem" else df).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries.own_vocabulary(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLE["own_vocabulary"]).fetchall())
    assert "= sid#" not in got._jdf.queryExecution().optimizedPlan().toString()
