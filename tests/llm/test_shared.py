import re

import numpy as np
import pyarrow as pa
import pytest

from metrolex.llm import shared

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_words_match_the_pattern(monkeypatch, piece, odd):
    monkeypatch.setattr(shared, "STEP_BYTES", piece)
    shared._powers.clear()
    column = shared.texts(pa.array([t for _, t in odd[:6]] + ["a b", "b\ta", "ab", "ba ab"]))
    seen: dict[bytes, int] = {}
    for lo, hi, data, offsets in shared.steps(column, 10):
        s, e, h = shared.words(data, offsets[:-1])
        own = [m for i in range(hi - lo) for m in ((a.start() + offsets[i], a.end() + offsets[i]) for a in WORD.finditer(data[offsets[i] : offsets[i + 1]].tobytes()))]
        assert list(zip(s, e)) == own
        for a, b, x in zip(s, e, h):
            assert seen.setdefault(data[a:b].tobytes(), int(x)) == int(x)
    assert len(set(seen.values())) == len(seen)
    shared._powers.clear()


def test_bloom_has_no_misses(spark):
    keys = np.arange(5000, dtype=np.int64) * 7919
    f = shared.bloom(spark.createDataFrame([(int(k),) for k in keys], "k long"), len(keys))
    assert shared.bloom_has(f, keys.view(np.uint64)).all()
    assert shared.bloom_has(f, (keys + 1).view(np.uint64)).mean() < 0.05
    assert not shared.bloom_has(shared.bloom(spark.createDataFrame([], "k long"), 0), keys.view(np.uint64)).any()


def test_runs_join_across_batches():
    t = pa.table({"k": pa.array([1, 1, 2, 2, 2, 3], pa.int64()), "v": pa.array(list(range(6)))})
    assert [(r.column(0)[0].as_py(), r.num_rows) for r in shared.runs(t.to_batches(2))] == [(1, 2), (2, 3), (3, 1)]


def test_whole_groups_stay_together():
    t = pa.table({"k": pa.array([1, 1, 2, 2, 2, 3, 4, 4, 5], pa.int64()), "v": pa.array(list(range(9)))})
    for size in range(1, 10):
        got = [r.column(0).to_pylist() for r in shared.whole(t.to_batches(size))]
        assert sum(got, []) == t.column("k").to_pylist() and all(a[-1] != b[0] for a, b in zip(got, got[1:]))
