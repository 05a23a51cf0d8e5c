"""Short texts that share a few common lines hang together in one large cluster, which must not be compared block by block."""

import numpy as np
from pyspark.sql import functions as F
from test_minhash_centroids_divergence import components

from corpusmill.llm import minhash, near_join


def short_texts(seed=3, n=500):
    """A common line or two of twelve, and a line of each text's own; near copies of the first 40, and a group of near copies in a chain."""
    draw = np.random.default_rng(seed)
    lines = [" ".join(f"l{k}x{j}" for j in range(12)) for k in range(12)]
    texts = []
    for d in range(n):
        own = " ".join(f"w{d}x{j}" for j in range(draw.integers(5, 9)))
        texts.append("\n".join([*(lines[k] for k in draw.choice(12, draw.integers(1, 3), replace=False)), own]))
    texts += [f"{t} copied" for t in texts[:40]]
    base = [f"g{j}" for j in range(30)]
    for d in range(60):
        base[d % 30] = f"g{d}e{d}"
        texts.append(" ".join(base))
    return texts


def test_hardly_similar_short_texts_form_no_large_cluster(spark, monkeypatch):
    seen = []

    def counted(members, percent, links=near_join._cluster_links):
        seen.append(members.groupBy("cluster").count().agg(F.max("count")).first()[0] or 0)
        return links(members, percent)

    monkeypatch.setattr(near_join, "_cluster_links", counted)
    rows = list(enumerate(short_texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_groups(df, 2, 80).collect()}
    assert got == components(rows, 2, 80)
    assert len(seen) == 1 and seen[0] <= near_join.BLOCK


def test_blocks_in_waves_find_the_same(spark, monkeypatch):
    for name, value in (("SMALL", 2), ("BLOCK", 8), ("TURNS", 0), ("WAVE_BYTES", 100_000)):
        monkeypatch.setattr(near_join, name, value)
    seen = []

    def told(members, sizes, percent, wave=0, waves=1, blocks=near_join._in_blocks):
        seen.append((wave, waves))
        return blocks(members, sizes, percent, wave, waves)

    monkeypatch.setattr(near_join, "_in_blocks", told)
    rows = list(enumerate(short_texts(n=120)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_groups(df, 2, 80).collect()}
    assert got == components(rows, 2, 80)
    assert len(seen) > 1 and seen == [(k, len(seen)) for k in range(len(seen))]
