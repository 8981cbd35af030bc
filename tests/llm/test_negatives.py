from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import negatives as X

SCHEMA = "vec_id bigint, embedding array<double>, label int, row int, score string, cell int"


def brute(rows, anchor=lambda i: i is not None and i % 50 == 0, scale=256):
    ok = lambda v, c: c is not None and v and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(scale * x) for x in v], c) for i, v, c in rows if ok(v, c)]
    clip = lambda s: max(min(s, X.HIGHEST), X.LOWEST)
    out = []
    for a, (i, v, c) in enumerate(rows):
        if not anchor(i):
            continue
        met = sorted(
            (-clip(sum(x * y for x, y in zip(v, w))), j is None, j or 0, b, d) for b, (j, w, d) in enumerate(rows) if b != a and len(w) == len(v))
        for s, none, j, _, d in [m for m in met if m[4] == c][:5]:
            fit = [m for m in met if m[4] != c and 50 * -s <= 100 * -m[0] <= 95 * -s][:3]
            out += [(i, None if none else j, n + 1, None if m[1] else m[2], -s, -m[0]) for n, m in enumerate(fit)]
    return sorted(out, key=str)


def run(spark, rows, **params):
    df = spark.createDataFrame([(i, v, c, 1, "s", 9) for i, v, c in rows], SCHEMA)
    found = X.hard_negatives(df, F.col("vec_id") % 50 == 0, X.Params(**params))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("shelf,members", [(8192, 64), (37, 3)])
def test_clusters_copies_and_ties(spark, shelf, members):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(6):
        centre = rng.normal(size=12)
        for _ in range(70):
            noise = rng.choice([0.1, 0.6])
            rows.append((5 * len(rows), ((centre + noise * rng.normal(size=12)) * rng.choice([0.5, 1, 3])).tolist(), int(rng.integers(0, 4))))
    hot = rng.normal(size=12)
    rows += [(5 * len(rows), hot.tolist(), i % 3) for i in range(200)]
    rows += [rows[10], rows[10], (None, hot.tolist(), 1)]
    want = brute(rows)
    assert len(want) > 300 and run(spark, rows, shelf_rows=shelf, members=members) == want


def test_walk_stops_early(monkeypatch):
    rng = np.random.default_rng(6)
    centre = np.zeros(16)
    centre[0] = 1000.0
    near = np.floor(centre + rng.normal(size=(200, 16)) * 20)
    far = np.floor(rng.normal(size=(20_000, 16)) * 100)
    v = np.concatenate([near, far])
    shelf = X.Shelf(v, X.lengths(v), np.zeros(len(v), np.int64), np.arange(len(v)), np.arange(len(v)), np.zeros(len(v), bool))
    shelf.listed(0, centre / 1000, 0.3)
    seen, product = [], X.product
    monkeypatch.setattr(X, "product", lambda a, b: (seen.append(len(b)), product(a, b))[1])
    least, most = np.full(4, X.LOWEST), np.full(4, X.HIGHEST)
    i, j, score = shelf.walk(near[:4], X.lengths(near[:4]), np.zeros(4, np.int64), np.arange(4), least, most, True, 5)
    assert sum(seen) <= 1536 and len(i) == 20  # of 20,200 rows
    exact = near[:4] @ v.T
    exact[np.arange(4), np.arange(4)] = -np.inf
    assert (np.sort(score.reshape(4, 5)) == np.sort(exact, axis=1)[:, -5:]).all()


def test_bad_rows_widths_and_large_numbers(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.1], 0), (2, [0.9, 0.0], 1), (3, [0.7, 0.2], 1), (4, [0.6, -5.0], 2), (5, None, 0), (6, [], 1)]
    rows += [(7, [1.0, None], 0), (50, [float("nan"), 1.0], 1), (9, [float("inf"), 0.0], 1), (10, [0.8, 0.0], None), (None, [0.75, 0.0], 3)]
    rows += [(100, [0.0, 0.0], 0), (150, [1.0, 2.0, 3.0], 0), (11, [1.0, 2.0, 3.0], 0), (12, [1.0, 2.0, 2.0], 1), (200, [1.0, 2.0, 3.0, 4.0], 7)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, sample_rows=1) == brute(rows)
    large = [(0, [1e30, 1.0], 0), (1, [1e30, -1.0], 0), (2, [2.0**40, 0.0], 1), (3, [1e-5, 7.0], 1), (50, [2.0**30, 3.0], 1), (51, [2.0**31, 5.0], 1),
             (52, [2.0**30, 1.0], 0), (53, [2.0**29 + 1, 1.0], 0)]
    assert run(spark, large) == brute(large)
    assert run(spark, []) == []


def test_labels_of_other_types(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist(), i % 3) for i in range(150)]
    df = spark.createDataFrame([(i, v, f"class {c}") for i, v, c in rows], "vec_id bigint, embedding array<double>, label string")
    assert sorted(map(tuple, X.hard_negatives(df, F.col("vec_id") % 50 == 0).collect()), key=str) == brute(rows)
