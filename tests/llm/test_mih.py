from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import mih as X

from .helpers import read

SCHEMA = "vec_id bigint, embedding array<float>, label int, row int, shelf string, norm int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "s", 2) for i, v in rows], SCHEMA)


def brute(rows, k, is_query=lambda i: i is not None and i % 20 == 0):
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if ok(v)]
    out = []
    for a, (q, v) in enumerate(rows):
        if is_query(q):
            near = [(-(v * w).sum(), i is None, i or 0, b) for b, (i, w) in enumerate(rows) if b != a and len(w) == len(v)]
            out += [(q, n + 1, None if t[1] else t[2], float(-t[0])) for n, t in enumerate(sorted(near)[:k])]
    return sorted(out, key=str)


def run(spark, rows, k=20, **params):
    found = X.neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0, k, X.Params(**params))
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()), key=str)


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 1 << 16, (3000, 8), dtype=np.uint16)
    query = code[:40].copy()
    for _ in range(30):  # some bits differ
        query[np.arange(40), rng.integers(0, 8, 40)] ^= np.uint16(1) << rng.integers(0, 16, 40).astype(np.uint16)
    index = X.Index(code)
    far = np.bitwise_count(query[:, None, :] ^ code[None, :, :]).sum(axis=2)
    for low in (0, 9, 17, 26, 40, 57, 70):
        radius = np.full(40, low) + np.arange(40) % 5
        i, j = index.within(query, radius)
        assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(far <= radius[:, None])))


@pytest.mark.parametrize("shelf", [8192, 100])
def test_recall_against_brute_force(spark, shelf):
    e = read("/root/testdata/sf0.1", "embeddings")
    want = {(q, i) for q, _, i, _ in brute(list(zip(e.vec_id, e.embedding.map(list))), 20)}
    found = X.neighbours(
        spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20,
        X.Params(sample_rows=200, shelf_rows=shelf)).collect()
    assert len(found) == len(want) and len({(r.query_id, r.vec_id) for r in found} & want) >= 0.95 * len(want)


def test_clusters_copies_norms_and_ties(spark):
    rng = np.random.default_rng(3)
    rows, hot = [], rng.normal(size=24)
    for c in range(8):
        centre = rng.normal(size=24)
        rows += [(len(rows) + i, ((centre + 0.2 * rng.normal(size=24)) * 4.0 ** (i % 3)).tolist()) for i in range(40)]
    rows += [(1000 + i, hot.tolist()) for i in range(150)]
    rows += [rows[20], rows[20], (None, hot.tolist()), (None, hot.tolist())]
    want = brute(rows, 7)
    got = run(spark, rows, 7, sample_rows=60, shelf_rows=50, margin=6.0)
    assert [(*r[:3], round(r[3], 9)) for r in got] == [(*r[:3], round(r[3], 9)) for r in want]


def test_bad_rows_widths_and_few_candidates(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [-1.0, 0.0]), (20, [1.0, 0.0, 0.0]), (3, [0.0, 3.0, 4.0]), (40, None), (60, [0.0, 0.0])]
    rows += [(80, []), (100, [1.0, None]), (120, [float("nan"), 1.0]), (140, [float("inf"), 1.0]), (160, [3e38, 3e38]), (180, [1e-30, 1e-30])]
    rows += [(200, [1.0] * 5), (None, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, rows, sample_rows=1) == brute(rows, 20)
    assert run(spark, []) == [] and run(spark, [(1, [1.0, 2.0])]) == []


def test_reruns_agree(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    a, b = (sorted(map(tuple, X.neighbours(d, F.col("vec_id") % 20 == 0, 5, X.Params(sample_rows=50, margin=0.0)).collect()))
            for d in (e, e.repartition(7)))
    assert a == b
