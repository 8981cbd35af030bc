from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import topk as K
from sentrylake.llm.queries import QUERIES

from .helpers import read


def brute(rows, k=20):
    """(query row, rank, id, score) by sorting all scores."""
    ok = [(i, [math.floor(64.0 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if i is None or i % 20:
            continue
        all_ = sorted((-sum(a * b for a, b in zip(q, v)), c is not None, c or 0) for m, (c, v) in enumerate(ok) if m != n and len(v) == len(q))
        out += [(i, r, c if some else None, -s) for r, (s, some, c) in enumerate(all_[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, k=20):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"row": F.lit("x"), "v": F.lit(1), "q": F.lit(2)})
    got = K.top_k(K.quantised(df), F.col("vec_id") % 20 == 0, k)
    return sorted((tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(K, "CANDIDATES", 37)
    monkeypatch.setattr(K, "QUERIES", 3)


def test_given_vectors(spark, sf, small_chunks):
    e = read(sf, "embeddings")
    got = sorted((tuple(r) for r in QUERIES["op6_topk"](spark, sf).select("query_id", "rank", "vec_id", "score").collect()), key=str)
    assert got == brute([(i, v.tolist()) for i, v in zip(e.vec_id, e.embedding)])


@pytest.mark.parametrize("k", [1, 5, 20])
def test_ties_copies_and_bad_vectors(spark, small_chunks, k):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(120)]
    rows += [(i, [1.0, 0.0, 1.0, 0.0, 1.0, 0.5]) for i in range(120, 180)]
    rows += [(200, None), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (240, [float("nan")] * 6), (260, [float("inf")] * 6)]
    rows += [(280, [0.0] * 6), (300, [-1.0] * 6), (320, [1.0, 2.0]), (321, [1.0, -2.0]), (340, []), (341, [])]
    rows += [(0, [1.0] * 6), (0, [1.0] * 6), (None, [2.0] * 6), (None, [2.0] * 6)]
    assert run(spark, rows, k) == brute(rows, k)


def test_few_and_none(spark):
    assert run(spark, [(20, [1.0, 2.0])]) == []
    assert run(spark, [(20, [1.0, 2.0]), (21, [1.0, -0.01])]) == [(20, 1, 21, 64 * 64 - 128)]
    assert run(spark, [(1, [1.0])]) == [] and run(spark, []) == []


def test_finite_numbers_of_any_size(spark):
    rows = [(0, [1e30, 1.0]), (20, [2.0**20, 3.0]), (1, [1e30, -1.0]), (2, [2.0**20, 1.0]), (3, [-1e30, 0.0]), (4, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = K.top_k(K.quantised(df), F.col("vec_id") % 20 == 0, 5).collect()
    order = lambda q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
    # parts beyond 2^61 are held there, so the other part decides
    assert order(0) == [20, 2, 4, 1, 3] and order(20) == [0, 1, 2, 4, 3]
    assert {r.vec_id: r.score for r in got if r.query_id == 20}[2] == 2**52 + 3 * 64 * 64


def test_products_stay_exact():
    big = np.array([[2**30, 3], [-(2**30), 1]], np.int64)
    assert (K.product(big, big) == np.array([[2**60 + 9, -(2**60) + 3], [-(2**60) + 3, 2**60 + 1]])).all()
    assert (K.product(big * 8, big * 8) == np.array([[K.HELD, -K.HELD], [-K.HELD, K.HELD]])).all()
