"""Vector search over cells finds what the plain search finds, and looks at less."""

import numpy as np
import pytest

from corpusmill.operators import cells, vector
from corpusmill.params import Params

ROW = "user_id string, chunk_id long, embedding array<float>"


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["distance"], 8)) for r in df.collect())


def both(spark, path, rows, asked, k=5, threshold=0, **more):
    v = spark.createDataFrame(rows, ROW).repartition(4)
    q = spark.createDataFrame(asked, "query_id long, user_id string, embedding array<float>")
    cells.write_cells(v, path, **more)
    told, p = {}, Params(vector_k=k)
    got = ranked(cells.cells_topk(spark, path, q, p, threshold, told))
    assert got == ranked(vector.vector_topk(v.where("embedding is not null"), q.where("embedding is not null"), p, threshold))
    return got, told


@pytest.mark.parametrize("ranges", [20_000, 37])
def test_clustered_vectors_are_mostly_skipped(spark, tmp_path, monkeypatch, ranges):
    monkeypatch.setattr(cells, "RANGE_ROWS", ranges)
    draw = np.random.default_rng(1)
    middle = draw.normal(size=(12, 16))
    of = lambda k: (middle[k % 12] + draw.normal(scale=0.05, size=16)).tolist()
    rows = [("ab"[k % 5 == 0], k, of(k)) for k in range(600)]
    got, told = both(spark, str(tmp_path / "c"), rows, [(k, "ab"[k % 2], of(k)) for k in range(10)] + [(50, "z", of(1))], pivots=24)
    assert len(got) == 50
    assert 0 < 2 * told["compared"] < told["pairs"]


def test_no_neighbour_is_lost_where_nothing_can_be_skipped(spark, tmp_path):
    draw = np.random.default_rng(2)
    rows = [("a", k, draw.normal(size=8).tolist()) for k in range(200)]
    both(spark, str(tmp_path / "c"), rows, [(k, "a", draw.normal(size=8).tolist()) for k in range(8)], threshold=0.4)


def test_ties_nulls_zeros_and_few_vectors(spark, tmp_path):
    one, zero = [1.0, 0.0], [0.0, 0.0]
    rows = [("a", k, one) for k in range(9)] + [("a", 20, zero), ("a", 21, None), ("b", 22, zero), ("b", 23, [-1.0, 0.0])]
    got, _ = both(spark, str(tmp_path / "c"), rows, [(1, "a", one), (2, "b", one), (3, "a", zero), (4, "c", one), (5, "a", None)], k=4)
    assert [r[2] for r in got if r[0] == 1] == [0, 1, 2, 3] and [r[2] for r in got if r[0] == 2] == [22, 23]
    both(spark, str(tmp_path / "empty"), [], [(1, "a", one)])
