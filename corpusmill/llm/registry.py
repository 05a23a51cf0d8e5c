"""Queries of this subpackage and the SQL that expresses them."""

from __future__ import annotations

from . import centroids, divergence, exact_dedup, langid, minhash, mixing, near_join, pii, quality, sentencepieces, sharding, toxicity, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_mixing": mixing.op2_mixing,
    "op3_warc": warc.op3_warc,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_ngram_jaccard": near_join.op5_ngram_jaccard,
    "op6_language_id": langid.op6_language_id,
    "op7_hilbert_sharding": sharding.op7_hilbert_sharding,
    "op8_sentencepiece": sentencepieces.op8_sentencepiece,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_minhash_near_dedup": minhash.op11_minhash_near_dedup,
    "op12_centroid_clustering": centroids.op12_centroid_clustering,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLES = {
    "op2_mixing": mixing.SQL,
    "op3_warc": warc.SQL,
    "op4_quality_rules": quality.SQL,
    "op5_ngram_jaccard": near_join.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op11_minhash_near_dedup": minhash.SQL,
    "op12_centroid_clustering": centroids.SQL,
    "op13_source_divergence": divergence.SQL,
}
