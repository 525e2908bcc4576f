"""Exact search with components of any size: scores beside Python's own integers."""

import random

import pytest
from pyspark.sql import functions as F

from fathomline.llm import mtree


def brute(rows, k, every):
    """query_id, rank, vec_id, score with integers of any size."""
    whole = {i: [int(x * 1024 // 1) for x in v] for i, v in rows}
    out = []
    for i, q in whole.items():
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in whole.items() if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def found(spark, rows, k, every):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return sorted(tuple(r) for r in mtree.top_k(vectors, F.col("vec_id") % every == 0, k).select("query_id", "rank", "vec_id", "score").collect())


def test_components_beyond_the_usual(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 16)
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 10 ** rng.choice((0, 1, 4, 5))) for _ in range(4)]) for k in range(300)]
    rows += [(1000 + k, [rng.choice((0.0, 70_000.5, -65_537.25)) for _ in range(4)]) for k in range(40)]
    assert found(spark, rows, 5, 10) == brute(rows, 5, 10)


def test_one_huge_row_leaves_the_others_whole(spark):
    rng = random.Random(6)
    rows = [(k, [0.0, *(rng.gauss(0, 1) for _ in range(3))]) for k in range(1, 60)] + [(61, [-1e30, 1.0, 2.0, 3.0])]
    assert found(spark, rows, 10, 20) == brute(rows, 10, 20)


def test_a_score_that_does_not_fit_is_refused(spark):
    with pytest.raises(Exception, match="does not fit"):
        found(spark, [(0, [1e15, 0.0]), (1, [1e15, 1.0]), (2, [-1e15, 1.0])], 1, 2)
