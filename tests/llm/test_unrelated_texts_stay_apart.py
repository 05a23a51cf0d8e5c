"""Texts that share common phrases only must not be compared with each other, however coarse the sketch is for the corpus."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import minhash, near_join


@pytest.mark.parametrize(("module", "words", "percent"), [(near_join, 4, 85), (minhash, 2, 80)])
def test_common_phrases_form_no_cluster(spark, monkeypatch, module, words, percent):
    rng = np.random.default_rng(5)
    phrases = [" ".join(f"p{k}x{j}" for j in range(4)) for k in range(150)]
    texts = []
    for d in range(400):
        parts = [phrases[k] for k in rng.choice(150, 60, replace=False)]
        texts.append(" ".join(f"{p} w{d}a{i} w{d}b{i} w{d}c{i} w{d}d{i}" for i, p in enumerate(parts)))
    texts += [f"{t} copied" for t in texts[:30]]  # near copies of the first ones
    monkeypatch.setattr(near_join, "SKETCH_BITS", (8, 8))  # as coarse for these texts as 2^24 counters for many GB
    monkeypatch.setattr(minhash, "SKETCH_BITS", (8, 8))
    seen = []

    def counted(members, percent, links=near_join._cluster_links):
        seen.append(members.groupBy("cluster").count().agg(F.max("count")).first()[0] or 0)
        return links(members, percent)

    monkeypatch.setattr(near_join, "_cluster_links", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in module.near_groups(df, words, percent).collect()}
    assert got == {k: k if k < 400 else k - 400 for k in range(430)}
    assert seen[0] <= 40
