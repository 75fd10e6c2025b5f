"""Near-dedup, substring dedup, decontamination, SentencePiece and the pipeline, against brute force."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrolex.llm import decontaminate, neardup, pieces, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(t, k):
    w = WORD.findall((t or "").translate(FOLD))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def _near(rows, k, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(_set(t, k))
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}
    linked = lambda a, b: any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if linked(a, b)]
    for _ in ids:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return sorted(((i is None, i or 0, len(_set(t, k)), None if i is None else root[i], i is None or root[i] == i) for i, t in rows), key=str)


def _copies(seed, n=60, groups=4):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)]
    rows = []
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(120)]
        for _ in range(n // groups):
            w = list(base)
            for _ in range(r.randrange(9)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows), r.choice([" ", "\n", "\t "]).join(w)))
    r.shuffle(rows)
    return [(1000 + i, t) for i, (_, t) in enumerate(rows)]


def _found(df):
    return sorted(((r[0] is None, r[0] or 0, r[1], r[2], r[3]) for r in df.collect()), key=str)


@pytest.mark.parametrize("limits", [(2048, 1 << 22), (8, 1 << 22), (4, 300)])
def test_near_duplicates(frame, odd, limits):
    """Small limits send nodes down all levels and into pairs of blocks."""
    rows = odd + _copies(7)
    rows.append(rows[-1])
    got = neardup.near_duplicates(frame(rows, extra=True).select("doc_id", "text", "n_words", "component_id", "id"), 3, 85, leaf_rows=limits[0], leaf_shingles=limits[1])
    want = _near(rows, 3, 85)
    if limits[0] > 100:
        assert _found(got) == want
    else:  # deep trees keep a link with a lower chance; nothing false, nearly all found
        a, b = _found(got), want
        assert len(a) == len(b) and sum(x == y for x, y in zip(a, b)) >= 0.9 * len(b)


def test_near_duplicates_empty_and_stage(frame):
    assert neardup.near_duplicates(frame([])).count() == 0
    t = " ".join(f"w{i}" for i in range(50))
    kept = neardup.drop_near_duplicates(frame([(5, t), (3, t + " more"), (9, None), (8, "")], extra=True))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 8, 9] and "component_id" in kept.columns


def test_components_of_long_paths(spark):
    r = random.Random(4)
    n = 300
    edges = [(i, i - 1) for i in range(1, n)] + [(n + i, n) for i in range(1, 50)]
    edges += [(max(a, b), min(a, b)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(40)) if a != b]
    got = {x["id"]: x["root"] for x in neardup.components(spark.createDataFrame(edges, "c long, p long")).collect()}
    assert got == {**{i: 0 for i in range(1, n)}, **{n + i: n for i in range(1, 50)}}
    assert neardup.components(spark.createDataFrame([], "c long, p long")).count() == 0


def _removed(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            seen[g] = seen.get(g, 0) + 1
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone.update(range(j, j + window))
        out.append((i is None, i or 0, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("group, bits", [(substrings.GROUP, substrings.BLOOM_BITS), (100, 0), (1, substrings.BLOOM_BITS)])
def test_substring_dedup(frame, odd, group, bits):
    """A small group lengthens prefixes up to whole windows; no bits for filters means joins."""
    r = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = list(odd)
    for i in range(40):
        w = [f"u{r.randrange(5000)}" for _ in range(r.randrange(5, 80))]
        at, lo = r.randrange(len(w)), r.randrange(20)
        rows.append((100 + i, " ".join(w[:at] + passage[lo : lo + r.randrange(30, 40)] + w[at:])))
    rows += [(200, "same " * 300), (201, "ab cd " * 40), (202, " ".join(passage)), (203, "\n".join(passage[:34]))]
    got = substrings.remove_repeats(frame(rows, extra=True), group=group, bloom_bits=bits)
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["n_words"], x["n_removed"], x["text"]) for x in got.collect()) == _removed(rows, 35)
    assert substrings.remove_repeats(frame([]), group=group, bloom_bits=bits).count() == 0


def test_many_equal_rows_take_linear_time(frame):
    r = random.Random(2)
    text, began = " ".join(f"w{r.randrange(9999)}" for _ in range(400)), time.monotonic()
    out = substrings.remove_repeats(frame([(7, text)] * 5000 + [(8, text.replace("w", "v", 1))])).collect()
    assert len(out) == 5001 and {x["n_removed"] for x in out if x["doc_id"] == 7} == {400}
    assert time.monotonic() - began < 40


def test_suffix_tree_nodes():
    """Against counting: leaves of equal beginning, weighed."""
    r = random.Random(3)
    for most in (1, 2):
        s, w = [tuple(r.choice((1, 2)) for _ in range(8)) for _ in range(80)], [r.randint(1, most) for _ in range(80)]
        s += [tuple(range(k, k + 8)) for k in range(10, 20)]
        w += [1 + k % 2 for k in range(10)]
        got = {frozenset(x) for x in substrings.deep_nodes(s, w, 6)}
        want = {frozenset(i for i, x in enumerate(s) if x[:6] == p) for p in {x[:6] for x in s}}
        assert got == {x for x in want if sum(w[i] for i in x) > 1}


def test_decontamination(frame, spark):
    r = random.Random(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(r.choice((5, 12, 30, 60))))) for i in range(40)] + [(40, "tiny item"), (41, None), (42, ""), (None, "no id at all in this item")]
    rows = [(1, None), (2, ""), (3, "Tiny\tITEM"), (None, items[0][1])]
    for i in range(60):
        w, item = some(r.choice((3, 50, 2000))), items[r.randrange(40)][1].upper().split()
        at = r.randrange(len(w))
        if r.random() < 0.4:
            item[r.randrange(len(item))] = "changed"
        rows.append((10 + i, " ".join(w[:at] + (item if i % 3 else []) + w[at:])))
    rows.append(rows[-1])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in rows:
        for i, q in items:
            if i is not None and (x := _set(q, 5)) and len(x & _set(t, 5)) >= 0.8 * len(x) - 1e-9:
                want.add((d, i, len(x & _set(t, 5)), len(x)))
    for chars in (decontaminate.BLOCK_CHARS, 900):
        assert {tuple(x) for x in decontaminate.contained_items(frame(rows, extra=True), benchmark, block_chars=chars).collect()} == want
        kept = decontaminate.clean(frame(rows, extra=True), benchmark, block_chars=chars)
        hit = {d for d, *_ in want}
        assert sorted(map(str, (x["doc_id"] for x in kept.collect()))) == sorted(str(d) for d, _ in rows if d not in hit)
    assert decontaminate.contained_items(frame([]), benchmark).count() == 0
    assert decontaminate.contained_items(frame(rows), benchmark.limit(0)).count() == 0


def test_clashing_names(frame, spark):
    """Columns named as the operators name their own."""
    from metrolex.llm import rules

    text = "some words of a text that is long enough for a few shingles to be made of it"
    names = "ids decoded row own_ids gone words lines triples __q __kept __base_failed n_words text_ id spans lead k1 i block a b m shape".split()
    docs = frame([(1, text), (2, text + " more"), (3, "x y " * 300), (4, None)]).selectExpr("*", *(f"{i} as {n}" for i, n in enumerate(names)))
    rest = [c for c in docs.columns if c not in ("ids", "decoded")]
    for chunk in (pieces.CHUNK, 40):
        out = pieces.decode(pieces.encode(docs, chunk=chunk))
        assert sorted(out.columns) == sorted([*rest, "ids", "decoded"]) and all(r["decoded"] == (r["text"] or "") for r in out.collect())
    assert neardup.drop_near_duplicates(docs).columns == docs.columns
    assert rules.judged(docs, rules.DecisionList()).count() == 4
    assert substrings.remove_repeats(docs).count() == 4
    assert decontaminate.clean(docs, spark.createDataFrame([(1, text)], "item_id long, text string")).columns == docs.columns


def test_bins_keep_their_promise():
    for n in (16, 1000, 100_000):
        for shared in (1, 9, 40):
            bits = decontaminate.bins_for(n, shared)
            p = 1 if bits == 64 else 2**bits / n * (1 - np.exp(-n / 2**bits))
            assert p > 0.999 or (1 - p) ** shared <= decontaminate.MISS


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


def test_encoding_is_the_librarys(spark, frame, odd, library):
    rows = odd[:9] + [(100 + i, t) for i, t in enumerate(["  a  b\n c \tx", "🙂🙂 日本語テキスト  ", " ", "a" * 300, "ab" * 200 + " c d" * 30])]
    rows = [(i, t[:30_000] if t else t) for i, t in rows if not (t and t.startswith("xxx"))]
    rows += [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id % 40 = 3").collect()]
    for chunk in (pieces.CHUNK, 500):
        got = pieces.decode(pieces.encode(frame(rows, extra=True), chunk=chunk)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert list(r["ids"]) == library.encode(r["text"] or "")
            assert r["decoded"] == (r["text"] or "").replace("▁", " ")
    assert pieces.encode(frame([])).count() == 0


@pytest.mark.parametrize("chunk", [1, 2, 5, 40])
def test_chunks_of_any_size(library, chunk):
    m = pieces.Pieces.load(pieces.DEFAULT_MODEL)
    for t in ("the transformation of unbrokenlongwordswithoutblanks  and  blanks", "ab" * 60, "x🙂y\n\nz ", "▁ ▁▁a"):
        assert pieces.encode_chunked(m, t, chunk) == library.encode(t)


def _best(m, text):
    """Highest sum of scores over all segmentations."""
    s = "▁" + text.replace(" ", "▁")
    best = [0.0] + [-np.inf] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - m.longest), e):
            if s[b:e] in m.ids or b == e - 1:
                best[e] = max(best[e], best[b] + m.scores.get(s[b:e], m.floor))
    return best[-1]


@pytest.mark.parametrize("seed", range(5))
def test_unigram_model(seed):
    r = random.Random(seed)
    names = sorted({"▁", *"abc"} | {"".join(r.choice("abc▁") for _ in range(r.randrange(2, 5))) for _ in range(25)})
    m = pieces.Pieces.of([(p, i, -r.random() * 5) for i, p in enumerate(names)], {}, 999, [], True)
    by_id = {i: p for p, i in m.ids.items()}
    for _ in range(20):
        t = "".join(r.choice("abc z") for _ in range(r.randrange(1, 40)))
        whole = pieces.encode_text(m, t)
        for ids in (whole, *(pieces.encode_chunked(m, t, c) for c in (1, 3, 10))):
            if "z" not in t:
                assert "".join(by_id[i] for i in ids) == "▁" + t.replace(" ", "▁")
                assert abs(sum(m.scores[by_id[i]] for i in ids) - _best(m, t)) < 1e-9
            else:
                assert ids == whole or len(ids) > 0


def test_max_plus_product_is_associative():
    r = np.random.default_rng(1)
    a, b, c = (np.where(r.random(s) < 0.3, -np.inf, r.integers(-9, 9, s).astype(float)) for s in ((3, 4), (4, 5), (5, 2)))
    assert np.array_equal(pieces.product(pieces.product(a, b), c), pieces.product(a, pieces.product(b, c)))


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == columns, name
    out = corpus_pipeline.run(spark, sf)
    ids = {r["doc_id"] for r in out.collect()}
    items = {r["item_id"]: _set(r["text"], 5) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = kept.collect()
    assert ids == {r["doc_id"] for r in rows} and len(ids) > 0.4 * docs.count()
    assert not any(len(q & _set(r["text"], 5)) >= 0.8 * len(q) for r in rows for q in items.values())
    sets = [_set(r["text"], 5) for r in rows]
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) if a for b in sets[i + 1 :])


def test_sketches_are_short_and_lose_no_links():
    """A sketch goes into every tree, so it is short; what it may lose at the threshold is below one in a million, by the binomial and by trial."""
    n, s = neardup.SLOTS, 0.85
    most = math.ceil((s - neardup.SLACK) * n) - 1
    assert n <= 64 and sum(math.comb(n, i) * s**i * (1 - s) ** (n - i) for i in range(most + 1)) < 1e-6
    r = np.random.default_rng(3)
    for size in (7, 40, 300, 3000):
        for _ in range(50):
            own = r.integers(0, 2**63, size).astype(np.uint64)
            other = own.copy()
            k = int(size * 0.15 / 1.85)  # the similarity is 0.85 or just above
            other[:k] = r.integers(0, 2**63, k).astype(np.uint64)
            far = r.integers(0, 2**63, size).astype(np.uint64)
            got = neardup._hopeful(np.stack([neardup._sketch(x) for x in (own, other, far)]), np.full(3, size), 85)
            assert got.tolist() == [True, True, False]
