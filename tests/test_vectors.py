"""Exact and approximate nearest vectors against plain products."""

import numpy as np
import pytest

from docloom.operators import retrieval as R
from docloom.operators import vectors as V


def frames(spark, q, v):
    make = lambda m, c: spark.createDataFrame([(i, None if x is None else [float(y) for y in x]) for i, x in enumerate(m)], f"{c} long, vector array<double>")
    return make(q, "query_id"), make(v, "chunk_id")


def plain(q, v, k):
    out = set()
    for i, a in enumerate(q):
        if a is not None:
            scores = [(-round(float(np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-300)), 9), j) for j, b in enumerate(v) if b is not None]
            out |= {(i, j) for _, j in sorted(scores)[:k]}
    return out


def pairs(df):
    return {(r["query_id"], r["chunk_id"]) for r in df.collect()}


@pytest.mark.parametrize("block", [1 << 11, 7])
def test_exact_search_in_blocks_with_nulls_ties_and_zeros(spark, monkeypatch, block):
    monkeypatch.setattr(V, "QUERY_BLOCK", block)
    monkeypatch.setattr(V, "VECTOR_BLOCK", block * 3)
    rng = np.random.default_rng(1)
    v = [*rng.normal(size=(90, 6)), np.ones(6), np.ones(6) * 2, np.ones(6), None, np.zeros(6)]
    q = [*rng.normal(size=(20, 6)), np.ones(6), None]
    assert pairs(R.dense_topk(*frames(spark, q, v), 5)) == plain(q, v, 5)
    assert pairs(R.dense_topk(*frames(spark, q, []), 5)) == set()
    assert R.dense_scores(*frames(spark, q, v)).count() == 21 * 94


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16)) * 3
    v = np.concatenate([c + rng.normal(size=(60, 16)) for c in centres])
    return v[rng.permutation(len(v))[:60]] + 0.01, v


def test_cells_of_clustered_vectors(spark, clustered):
    """Few cells are looked into, few vectors scored, and nine tenths of the hits found."""
    q, v = clustered
    queries, vectors = frames(spark, q, v)
    index = V.cell_index(vectors, 10)
    assert index.codes.probes <= len(index.codes.centres) / 3
    assert sum(len(r["ids"]) for r in index.cells.collect()) == len(v)
    want = plain(q, v, 10)
    assert len(pairs(R.ann_topk(queries, vectors, 10, index)) & want) >= 0.9 * len(want)
    assert V.candidates(queries, index, 30).count() == 30 * len(q)


def test_all_cells_and_all_candidates_are_exact(spark, clustered):
    q, v = clustered
    queries, vectors = frames(spark, q[:10], v[:400])
    assert pairs(R.ann_topk(queries, vectors, 10, probes=1 << 20, rescored=400)) == plain(q[:10], v[:400], 10)


def test_crowded_cells_are_split(spark, monkeypatch):
    """A third of all vectors are copies of one."""
    monkeypatch.setattr(V, "CELL_BLOCK", 50)
    rng = np.random.default_rng(3)
    v = np.concatenate([np.tile(rng.normal(size=8), (300, 1)), rng.normal(size=(600, 8))])
    queries, vectors = frames(spark, v[295:310], v)
    index = V.cell_index(vectors, 5)
    assert max(len(r["ids"]) for r in index.cells.collect()) < 120
    got = pairs(R.ann_topk(queries, vectors, 5, index))
    assert len(got & plain(v[295:310], v, 5)) >= 0.9 * len(got) and all(j < 5 for i, j in got if i < 5)


def test_index_of_few_or_no_vectors(spark):
    queries, vectors = frames(spark, [[1.0, 0.0], [0.0, 0.0]], [[1.0, 2.0], None])
    assert pairs(R.ann_topk(queries, vectors, 3)) == {(0, 0), (1, 0)}
    assert V.cell_index(vectors.where("chunk_id < 0"), 3) is None
    assert R.ann_topk(queries, vectors.where("chunk_id < 0"), 3).count() == 0
