"""Numeric helpers that run inside tasks, against plain Python."""

from hashlib import md5

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from snipquarry.functions.text import WHITE_SPACE
from snipquarry.operators.cache import misses_of
from snipquarry.operators.inference import _token_counts
from snipquarry.operators.search import BLOCK_BYTES, _best, _block_rows, _first_copies


@settings(deadline=None, max_examples=150)
@given(st.data())
def test_nearest_in_a_block(data):
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    n, m, dim = data.draw(st.integers(1, 60)), data.draw(st.integers(1, 12)), data.draw(st.integers(1, 5))
    # Few distinct values, so that distances tie and vectors repeat.
    vectors = rng.integers(0, data.draw(st.integers(1, 4)), (n, dim)).astype(float)
    queries = rng.integers(0, 3, (m, dim)) + rng.choice([0.0, 0.25], (m, dim))
    k = rng.integers(1, 8, m)
    order = rng.permutation(n)
    q, v, d = _best(queries, k, vectors, order, slice_cells=data.draw(st.sampled_from([1, 50, 10**6])))
    got = {i: [] for i in range(m)}
    for a, b, c in zip(q, v, d):
        got[a].append((c, b))
    for i in range(m):
        near = sorted((((queries[i] - vectors[j]) ** 2).sum(), order[j], j) for j in range(n))
        want = near[:k[i]]
        assert [b for _, b in got[i]] == [j for _, _, j in want]
        assert np.allclose([c for c, _ in got[i]], [x for x, _, _ in want])


@given(st.lists(st.integers(0, 2), min_size=1, max_size=30), st.integers(1, 3))
def test_first_copies(values, keep):
    order = np.array([(i * 7) % 31 for i in range(len(values))])
    kept = set(_first_copies(np.array(values, float)[:, None], order, keep))
    for i, value in enumerate(values):
        before = sum(values[j] == value and order[j] < order[i] for j in range(len(values)))
        assert (i in kept) == (before < keep)


@given(st.lists(st.integers(0, 60), max_size=40), st.integers(1, 20), st.none() | st.integers(-20, 0))
def test_misses(times, ttl, anchor):
    times = sorted(times)
    want, last = [], anchor
    for i, t in enumerate(times):
        if last is None or t >= last + ttl:
            want.append(i)
            last = t
    got, end = misses_of(np.array(times, int), ttl, anchor)
    assert list(got) == want and end == last


@settings(deadline=None)
@given(
    st.lists(st.text(st.sampled_from("abé\u4e2d" + WHITE_SPACE), max_size=30) | st.text(max_size=10), max_size=12),
    st.none() | st.integers(1, 4), st.sampled_from([1, 16, 10**6]),
)
def test_token_counts(texts, limit, slice_cells):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = _token_counts(8, limit, memory=5, slice_cells=slice_cells)(pa.array(texts, pa.string()))
    want = np.zeros((len(texts), 8))
    for i, text in enumerate(texts):
        for token in text.split()[:limit]:
            want[i, int(md5(token.encode()).hexdigest()[:7], 16) % 8] += 1
    assert (got == want).all()


def test_block_sizes():
    # Few rows: enough blocks for the tasks.  Many rows: as large as memory allows.
    assert _block_rows(100, 400_000, 64, 32) == (12_500, 100)
    vectors, asks = _block_rows(10**6, 25 * 10**9, 1024, 32_000)
    assert vectors == asks == BLOCK_BYTES // 4096
    assert _block_rows(0, 0, 1, 8) == (1024, 1)
