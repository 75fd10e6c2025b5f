"""Source divergence, LM scoring and phrases against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metrolex.llm import attention, blocks, divergence, phrases, shared

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, item string, value int, block int"


def _docs(spark, rows):
    """(id, text, lang, source) rows, with extra columns of clashing names."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def _made(n=160, seed=3, langs=("en", "de", None), sources=("a", "b", "c", "", None)):
    r = random.Random(seed)
    common, rare = [f"w{chr(97 + i)}" for i in range(8)], [f"{a}{b}é" for a in "abcdefgh" for b in "xyz"]
    rows = [(i, " ".join(r.choice(common) if r.random() < 0.6 else r.choice(rare) for _ in range(r.randrange(40))), r.choice(langs), r.choice(sources)) for i in range(n)]
    return rows + [(1000, None, "en", "d"), (1001, "", None, "d"), (1002, "12 34, 56!", "fr", "only"), (None, "Wa wA wb wb, Wb", "en", "a"), (5, "WA wa\x00wa", "en", "a"), (5, "WA wa\x00wa", "en", "a"), (1003, "wa" * 5000, "en", "e")]


def _divergence(rows, least, top):
    lower = lambda t: (t or "").translate(LOWER)
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t)), lang or "", source or "") for _, t, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        df = collections.Counter(w for d in own for w in set(d[0]))
        kept = sorted(w for w, n in df.items() if n >= least)
        counts = {s: collections.Counter(w for d in own if d[2] == s for w in d[0] if df[w] >= least) for s in {d[2] for d in own}}
        total = sum(counts.values(), collections.Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        q, ps = p(total), {s: p(c) for s, c in counts.items()}
        for s, mine in ps.items():
            pairs = [(-sum(f(mine[w], other[w]) for w in kept), o.encode(), o) for o, other in ps.items() if o != s]
            terms = [(-f(mine[w], q[w]), w.encode(), w) for w in kept if counts[s][w] and mine[w] > q[w]]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", w, -v, i) for i, (v, _, w) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("tile, block, light", [(divergence.TILE, divergence.BLOCK, 8), (3, 2, 8), (5, 1, 1), (4, 3, 0)])
def test_divergence(spark, tile, block, light):
    """Small tiles and blocks bring pairs of blocks; from all terms light to all heavy."""
    rows = _made()
    got = divergence.audit(_docs(spark, rows), 3, 4, tile, block, light)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == _divergence(rows, 3, 4)


def test_divergence_empty_and_share(spark):
    assert divergence.audit(_docs(spark, [])).count() == 0
    r = random.Random(1)
    cases = [(r.randrange(10**k), r.randrange(10**k, 10 ** (k + 1)), r.randrange(1, 10**9)) for k in (1, 5, 9, 12) for _ in range(50)] + [(0, 0, 0), (0, 0, 5)]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    got = df.select(divergence.share(df.c, df.n, df.v).alias("p")).collect()
    assert [x["p"] for x in got] == [1 + 10**9 * (c + 2) // max(n + 2 * v, 1) for c, n, v in cases]


def _phrases(rows, least, words, top, inside=50):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in range(1, words + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= inside * c[p[i:j]]}
        best = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), " ".join(p), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p, -a, l, r, n[lang], -s) for i, (s, a, _, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("words, sizes", [(3, {}), (3, {"block": 1, "block_words": 7}), (5, {"block": 300}), (2, {})])
def test_phrases(spark, words, sizes):
    """Small blocks cut texts between pieces; phrases of up to five words follow their parents."""
    r = random.Random(8)
    odd = ["a b c d e f", "A\tb C. d e\nf", "x" * 9000, " , ;; ", "b c d", "é ü é ü é"]
    rows = [(i, " ".join(r.choice(odd + ["c d e", "b", "e."]) for _ in range(r.randrange(9))), r.choice(("en", "de", None, "")), "s") for i in range(150)] + _made(40)
    got = phrases.collocations(_docs(spark, rows).repartition(3), 4, words, top=30, **sizes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _phrases(rows, 4, words, 30)


def test_phrases_empty_and_large_counts(spark):
    assert phrases.collocations(_docs(spark, [])).count() == 0
    big = 3_000_000_000_000
    df = spark.createDataFrame([(1, "en", ["a", "b"], big - 1, [big], [big + 7], 1, 2)], "id long, lang string, words array<string>, total long, heads array<long>, tails array<long>, left long, right long")
    assert phrases.scored(df).first()["score"] == 10**6 * (big - 1) ** 2 // (big * (big + 7))


def test_blocks_spans():
    r = random.Random(2)
    for _ in range(200):
        some = ["".join(r.choice("ab é\n.") for _ in range(r.randrange(12))) for _ in range(r.randrange(5))]
        data, offsets = np.frombuffer("".join(some).encode(), np.uint8), np.r_[0, np.cumsum([len(t.encode()) for t in some])].astype(np.int64)
        starts, ends = blocks.spans(data, offsets, blocks.WHITE)
        assert blocks.strings(data, blocks.WHITE, starts, ends).to_pylist() == [w for t in some for w in re.findall(r"[^\x20\x09-\x0D]+", t)]


@pytest.mark.parametrize("codes", [[], [-1], [-1, 0, 70000, -1, 2**31 - 1]])
def test_packed_codes(codes):
    assert blocks.unpacked(blocks.packed(np.array(codes, np.int32))).tolist() == codes


@pytest.fixture(scope="module")
def ranks():
    return attention.read_vocabulary()


def _windows_by_hand(ids):
    """(context, id) of each place: what stands in its window up to it, an end first."""
    before = [None, *ids[:-1]]
    return [(before[max(0, i // attention.S * attention.S - attention.S) : i + 1], ids[i]) for i in range(len(ids))]


def test_attention_is_a_distribution_over_its_window():
    """Against plain loops: windows, masks, softmax, Huffman paths; all ids together have probability one."""
    r = np.random.default_rng(5)
    n = 30
    m = attention.Model.fresh(r.integers(0, 50, n), keys=3, width=4)
    m.p["nodes"] = r.standard_normal(m.p["nodes"].shape).astype(np.float32)
    m.p["place"] = r.standard_normal(2 * attention.S).astype(np.float32)
    texts = [r.integers(0, n, k).astype(np.int32) for k in (1, 5, 16, 17, 32, 33, 70)]
    t = m.tree

    def p_all(context):
        e = m.p["ids"][[n - 1 if c is None else c for c in context]].astype(float)
        q = e[-1] @ m.p["query"] / math.sqrt(3)
        a = np.exp([(x @ m.p["key"]) @ q + m.p["place"][len(context) - 1 - j] for j, x in enumerate(e)])
        h = np.tanh((a / a.sum()) @ (e @ m.p["value"]) + e[-1] @ m.p["own"])
        out = []
        for i in range(n):
            path = slice(t.begins[i], t.begins[i] + t.sizes[i])
            z = (m.p["nodes"][t.nodes[path]] @ h + t.bias[t.nodes[path]]) * t.turns[path]
            out.append(-np.log1p(np.exp(-z)).sum())
        return np.array(out)

    want = []
    for ids in texts:
        each = [(p_all(c), y) for c, y in _windows_by_hand(list(ids))]
        assert all(abs(np.exp(p).sum() - 1) < 1e-5 for p, _ in each)
        want.append(sum(p[y] for p, y in each) / math.log(10))
    got = m.score(np.concatenate(texts), np.array([len(x) for x in texts]), m.tables())
    assert np.allclose(got, want, rtol=1e-4)


def test_attention_gradients():
    """The gradient steps' directions against finite differences of the summed log probability."""
    r = np.random.default_rng(7)
    n = 12
    m = attention.Model.fresh(r.integers(1, 9, n), keys=2, width=3)
    m.p = {k: r.standard_normal(v.shape) * 0.5 for k, v in m.p.items()}  # float64
    texts = (r.integers(0, n, 45).astype(np.int32), np.array([20, 1, 24]))
    value = lambda: m.score(*texts, m.tables()).sum() * math.log(10)
    old = {k: v.copy() for k, v in m.p.items()}
    grown = {k: np.zeros_like(v) for k, v in m.p.items()}
    m.train(*texts, grown, rate=1e-9)
    step = {k: np.sign(m.p[k] - old[k]) * np.sqrt(grown[k]) for k in old}  # the gradient: one batch, clipped at 8
    m.p = old
    for k, v in m.p.items():
        for at in [tuple(int(r.integers(0, s)) for s in v.shape) for _ in range(6)]:
            x = v[at]
            v[at] = x + 1e-4
            up = value()
            v[at] = x - 1e-4
            down = value()
            v[at] = x
            assert abs(np.clip((up - down) / 2e-4, -8, 8) - step[k][at]) < 2e-2 * max(1, abs(step[k][at])), (k, at)


def test_subwords_expand(ranks):
    words, sizes = ["alpha", "beta", "x" * 3000, "é"], np.array([2, 0, 3])
    ids, at = attention.subwords(words, ranks)
    inverse = {i: b for b, i in ranks.items()}
    assert ["".join(inverse[x].decode() for x in ids[at[i] : at[i + 1]]) for i in range(3)] == [" " + w for w in words[:3]]
    got, n = attention._expanded(np.array([1, 0, 3, 2, 1]), sizes, ids, at, 99999)
    want = [[1, 0], [], [3, 2, 1]]
    flat = [[*(x for w in text for x in ids[at[w] : at[w + 1]]), 99999] for text in want]
    assert got.tolist() == [x for f in flat for x in f] and n.tolist() == [len(f) for f in flat]


def test_subwords_of_many_words_in_one_call(ranks, monkeypatch):
    """Thousands of words a call, each cut as if it stood alone."""
    import tiktoken

    r, calls, cut = random.Random(4), [], tiktoken.Encoding.encode_ordinary
    words = ["x" * 3000, "\u00a0", "a\u2003b", "\x00", "\x1f", "a\x85", "<|endoftext|>", *("".join(chr(r.choice([r.randrange(33, 127), r.randrange(0xA0, 0x2FF), r.randrange(0x1F600, 0x1F640)])) for _ in range(r.randrange(1, 9))) for _ in range(2000))]
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: calls.append(text) or cut(self, text))
    got, at = attention.subwords(words, ranks)
    assert len(calls) == 1
    alone = tiktoken.Encoding("alone", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == [alone.encode_ordinary(" " + w) for w in words]


def test_places_without_an_id_add_nothing():
    """Windows go whole through the steps: places behind a text's end (-1) have no slope and no cost, and the others' don't depend on them."""
    r = np.random.default_rng(9)
    m = attention.Model.fresh(r.integers(0, 500, 300), keys=2, width=4)
    m.p["nodes"] = r.standard_normal(m.p["nodes"].shape).astype(np.float32)
    h, y = r.standard_normal((50, 4)).astype(np.float32), r.integers(0, 300, 50)
    y[::3] = -1
    some = y >= 0
    assert 0 < m.tree.upper.min() and (m.tree.sizes > m.tree.upper).any()
    assert not m.surprise(h, y)[~some].any() and np.allclose(m.surprise(h, y)[some], m.surprise(h[some], y[some]))
    (dh, above, below), (dh_, above_, below_) = m.slopes(h, y), m.slopes(h[some], y[some])
    assert not dh[~some].any() and np.allclose(dh[some], dh_, atol=1e-5) and np.allclose(above[1], above_[1], atol=1e-5)
    assert np.array_equal(below[0], below_[0]) and np.allclose(below[1], below_[1], atol=1e-5)


def _base(rows):
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    part = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7
    c = collections.Counter(w for i, t in rows if part(i) not in (None, 2) for w in token(t))
    n, v = sum(c.values()), len(c)
    return sorted((str(i), part(i) == 2, len(token(t)), sum(c[w] > 0 for w in token(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in token(t)), 6)) for i, t in rows)


@pytest.mark.parametrize("block", [attention.BLOCK, 200])
def test_lm_scores(spark, frame, odd, block):
    rows = odd + [(100 + i, f"Some words {i} of many words") for i in range(40)]
    got = attention.scores(frame(rows, extra=True).repartition(3), share=3, block=block).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == _base(rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add(round(r["score"], 3))
    assert len(by_id[4]) == 1 and by_id[6] == by_id[7]  # a text's score doesn't depend on its neighbours


@pytest.mark.parametrize("shelves", [1, 5, 70_000])
def test_word_counts_by_shelves(spark, frame, odd, ranks, shelves):
    """Every word of every block has its count over all training texts; rows are shelves, not words."""
    rows = odd + [(100 + i, f"Some words {i % 5} of {'many' * (i % 3)} words") for i in range(40)]
    table = attention.text_blocks(frame(rows).repartition(3), spark.sparkContext.broadcast(ranks), block=3000, shelves=shelves).localCheckpoint()
    want = collections.Counter(w for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)))
    words = {}
    for r in table.where("code >= 0").collect():
        at = np.append(0, np.cumsum(np.frombuffer(r["ends"], np.int32)))
        words |= {(r["block"], c): bytes(r["words"][a:b]).decode() for c, a, b in zip(np.frombuffer(r["codes"], np.int32).tolist(), at, at[1:])}
    counts = attention.word_counts(table).collect()
    got = {(r["block"], c): n for r in counts for c, n in zip(np.frombuffer(r["codes"], np.int32).tolist(), np.frombuffer(r["c"], np.int64).tolist())}
    assert got == {k: want[w] for k, w in words.items()} and len({b for b, _ in words}) > 1 and set(want) <= set(words.values())
    assert sum(r["v"] for r in counts) == len(want) and table.agg(F.sum("n")).first()[0] == sum(want.values())
    assert shelves > 5 or len(counts) <= shelves * len({b for b, _ in words})


def test_lm_empty_and_nothing_to_learn(spark, frame):
    assert attention.scores(frame([])).count() == 0
    got = attention.scores(frame([(None, "only a null id"), (None, None)])).collect()
    assert [r["train_tokens"] for r in got] == [0, 0] and {r["n_known"] for r in got} == {0}


def test_lm_learns_from_context(spark):
    """On held-out texts the trained model is well above its own unigram start, and above the base on words that training texts lack."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    start, got = ({r["doc_id"]: r for r in attention.scores(docs, share=s, rounds=1).collect() if r["held_out"]} for s in (10**9, 2))
    assert len(start) > 100 and sum(r["score"] for r in got.values()) > 0.9 * sum(r["score"] for r in start.values())


def test_lm_trains_on_every_training_text(spark, frame, ranks):
    """By default all training texts, dealt to all rounds, and no others; so a model learns from texts that a share of one in 40 leaves out."""
    rest, picked = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(7)), F.pmod(F.xxhash64("id", F.lit(12)), F.lit(40))
    ids = [r["id"] for r in spark.range(1, 60).where((rest == 2) | (picked != 0)).collect()]
    docs = frame([(i, "one two three four five six seven eight " * 20) for i in ids] + [(None, "no id")])
    turns = {}
    for r in attention.text_blocks(docs, spark.sparkContext.broadcast(ranks)).where("code < 0").collect():
        turns |= dict(zip(r["ids"], np.frombuffer(r["turns"], np.int32).tolist()))
    held = {i for i in ids if zlib.crc32(str(i).encode()) % 7 == 2}
    assert {i for i, t in turns.items() if t < 0} == held | {None} and held
    assert {t for t in turns.values() if t >= 0} == set(range(attention.ROUNDS))
    start, got = (attention.scores(docs, **given).where("doc_id is not null").agg(F.sum("score")).first()[0] for given in ({"share": 10**9}, {}))
    assert got > 0.9 * start


def test_average_does_not_depend_on_order(spark, ranks):
    sample = spark.createDataFrame([(f"word {i % 7} and {i % 3}", 0) for i in range(300)], "text string, round int")
    sent, fresh = spark.sparkContext.broadcast(ranks), lambda: attention.Model.fresh(np.ones(max(ranks.values()) + 2, np.int64))
    a, b = (attention.trained(fresh(), sample.repartition(3, "text"), sent, 1) for _ in range(2))
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p) and not np.array_equal(a.p["ids"], fresh().p["ids"])


def test_discarded_tables_are_gone(spark):
    df = shared.stored(spark.range(3))
    assert df.count() == 3
    shared.discard(df)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        df.count()
