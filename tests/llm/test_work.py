import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lattis.llm import op6_suffix, work
from lattis.sources.scratch import drop_scratch


def test_stash_and_drop(spark):
    df = work.stash(spark.range(10), "t")
    path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    import os

    assert df.count() == 10 and os.path.isdir(path)
    drop_scratch(spark)
    assert not os.path.exists(path)


@given(st.lists(st.lists(st.integers(0, 3), max_size=6), max_size=6))
@settings(max_examples=50, deadline=None)
def test_groups_of(parts):
    keys = sorted(k for p in parts for k in p)
    cuts, at, batches = [len(p) for p in parts], 0, []
    for n in cuts:
        batches.append(pa.RecordBatch.from_pydict({"k": pa.array(keys[at : at + n], pa.int64()), "v": pa.array(range(at, at + n), pa.int64())}))
        at += n
    got = [(k, t.column("v").to_pylist()) for k, t in work.groups_of(batches, "k")]
    assert got == [(k, [i for i, x in enumerate(keys) if x == k]) for k in sorted(set(keys))]


def test_mix64_is_a_bijection_on_a_sample():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(work.mix64(x))) == len(x)


@given(st.lists(st.binary(max_size=60), max_size=8))
@settings(max_examples=100, deadline=None)
def test_windows_with_one_content_have_one_anchor(texts):
    data, lengths = np.frombuffer(b"".join(texts * 4), np.uint8), np.array([len(t) for t in texts * 4], np.int64)
    long = np.concatenate([data] * 5) if len(data) else data
    lengths = np.array([len(long)], np.int64) if len(long) else lengths
    first, size, place, keys = op6_suffix.window_runs(long, lengths, chunk=64)
    seen = {}
    raw = long.tobytes()
    for f, n, p, k in zip(first.tolist(), size.tolist(), place.tolist(), keys.tolist(), strict=True):
        for w in range(f, f + n):
            assert w <= p <= w + op6_suffix.SPAN - 1
            assert seen.setdefault(raw[w : w + 200], (p - w, k)) == (p - w, k)
    assert int(size.sum()) == max(0, len(long) - 199)
