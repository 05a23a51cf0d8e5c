"""What the search for the nearest examples reads and holds."""

from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import toxicity

from test_against_brute_force import example


@pytest.mark.parametrize("long", [0, 60, 5000])
def test_few_blocks_are_read_and_neighbours_are_exact(monkeypatch, long):
    """Texts share rare words with their nearest examples: whatever is long, these are found, and most blocks are left alone."""
    for name, value in (("HEAD", 20), ("LONG", long), ("BLOCK", 16), ("FIRST", 16), ("PIECE_POSTINGS", 700)):
        monkeypatch.setattr(toxicity, name, value, raising=False)
    rng = np.random.default_rng(5)
    subjects = [rng.integers(1000, 9000, 40) for _ in range(100)]
    usual = lambda n: np.minimum(rng.zipf(1.3, n), 999)
    draw = lambda k: Counter(int(t) for t in [*rng.choice(subjects[k % 100], 14), *usual(30)])
    rows = [example(k, int(k % 9 == 0), draw(k)) for k in range(3000)]
    keys = np.unique(np.concatenate([np.frombuffer(r["terms"], np.uint64) for r in rows]))
    df, bad = np.zeros(len(keys), int), np.zeros(len(keys), int)
    for r in rows:
        own = np.searchsorted(keys, np.frombuffer(r["terms"], np.uint64))
        df[own] += 1
        bad[own] += r["label"]
    index = toxicity.build(rows, int(df.sum()), keys, df, bad, len(rows), int(sum(r["label"] for r in rows)))
    dense = np.zeros((len(index.norm), len(keys)))
    for t in range(len(keys)):
        own = slice(index.start[t], index.start[t + 1])
        dense[index.entry[own], t] = index.tf[index.times[own]] * index.weight[t] / index.norm[index.entry[own]]
    queries = [index.known(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)])) for c in (draw(k) for k in range(60))]
    for (terms, w), (sims, entries) in zip(queries, index.nearest(queries), strict=True):
        want = dense[:, terms] @ w
        least = np.sort(want)[-toxicity.NEIGHBOURS]
        assert np.allclose(sims, want[entries], atol=1e-5) and set(np.flatnonzero(want > least + 1e-5)) <= set(entries.tolist()) and sims.min() >= least - 1e-5
    if long == 60:
        assert index.looked[0] < 0.25 * index.looked[1]


def test_prepared_lists_are_small():
    """A worker holds no copy of the postings, but for what is made of long lists."""
    rng = np.random.default_rng(6)
    rows = [example(k, k % 2, {int(t): 1 for t in rng.integers(0, 1 << 40, 400)}) for k in range(1000)]
    keys = np.unique(np.concatenate([np.frombuffer(r["terms"], np.uint64) for r in rows]))
    index = toxicity.build(rows, 400_000, keys, np.ones(len(keys), int), np.ones(len(keys), int), 1000, 500)
    index.ready()
    made = sum(index.__dict__[name].nbytes for name in index.MADE if isinstance(index.__dict__.get(name), np.ndarray))
    # the dense matrix, the place of every term, and block maxima
    assert made < 4 * (toxicity.HEAD * 1024 + len(keys) + 4096 * 32) + 1_000_000
