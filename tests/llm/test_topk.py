"""Top-k search against all inner products; ties, unusable vectors and many blocks."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import topk


def plain(rows, k):
    """Ranks by score, then id."""
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {i: q for i, q in reversed(good) if i % 10 == 0}.items():
        found = sorted(((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in good if j != i))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=10, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, q string, score int").repartition(3)
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, k, **more).collect())


def vectors(n, dims, seed, sparse=0.0):
    rng = random.Random(seed)
    return [(i, [0.0 if rng.random() < sparse else round(rng.gauss(0, 1) * 64) / 64 for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("sparse,blocks", [(0.0, {}), (0.7, {}), (0.5, {"query_block": 3, "row_block": 17})])
def test_blocks(spark, sparse, blocks):
    rows = vectors(150, 7, 5, sparse)
    assert run(spark, rows, **blocks) == plain(rows, 10)


def test_queries_in_slices(spark, monkeypatch):
    rows = vectors(120, 5, 8, 0.3)
    monkeypatch.setattr(topk, "AT_ONCE", 3)
    pairs = topk._search(4)(*(topk.pd.DataFrame({"vec_id": [i for i, _ in x], "q": [[math.floor(1024 * c) for c in v] for _, v in x]}) for x in (rows[::10], rows)))
    want = [(q, v, s) for q, _, v, s in plain(rows, 4)]
    assert sorted(map(tuple, pairs.to_numpy().tolist())) == sorted(want)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.5]) for i in range(40)]
    assert run(spark, rows, 5, query_block=2, row_block=6) == plain(rows, 5)


def test_unusable_vectors(spark):
    rows = [(0, [1.0, 2.0]), (10, None), (20, [1.0, None]), (30, [float("nan"), 1.0]), (40, [float("inf"), 1.0]), (50, [-0.0001, 1.0]), (None, [1.0, 1.0]), (1, []), (2, [3.0]), (3, [1.0, 1.0, 9.0]), (60, [])]
    assert run(spark, rows) == plain(rows, 10)


def test_few_candidates(spark):
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (7, [2.0])]) == [(0, 1, 7, 1024 * 2048)]
    assert run(spark, []) == []


def test_repeated_ids(spark):
    rows = [(0, [1.0]), (0, [1.0]), (5, [2.0]), (5, [3.0])]
    assert [(q, r, v) for q, r, v, _ in run(spark, rows)] == [(0, 1, 5), (0, 2, 5)]


def test_large_components(spark):
    """Scores that fit 64 bits count, even if a product or a partial sum doesn't; others are errors."""
    rows = [(0, [300000.0, -2.0]), (10, [1.0, 70000.0]), (1, [200000.5, 1.0]), (2, [-370000.0, 4.0]), (3, [5.0, 9.0]), (20, [4e6, 4e6]), (4, [4e6, -4e6])]
    assert run(spark, rows) == plain(rows, 10)
    for beyond in ([(0, [4e6]), (1, [4e6])], [(0, [1e17]), (1, [0.0])]):
        with pytest.raises(Exception, match="64 bits"):
            run(spark, beyond)
