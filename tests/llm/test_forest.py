from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import forest as X

from .helpers import groups


def brute(rows, cosine=0.98):
    """(vec_id, n_links, component_id, kept) per row, and the number of linked pairs."""
    ok = lambda v, l: l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links = []
    for a, (_, v, lv) in enumerate(rows):
        for b, (_, w, lw) in enumerate(rows[:a]):
            if lv == lw and ok(v, lv) and ok(w, lw) and len(v) == len(w):
                x, y = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                    links.append((a, b))
    root = groups(range(len(rows)), links)
    members: dict = {}
    for n, r in root.items():
        members.setdefault(r, []).append(rows[n][0])
    out = []
    for n, (i, _, _) in enumerate(rows):
        c = min((x for x in members[root[n]] if x is not None), default=None)
        out.append((i, sum(n in e for e in links), c, i == c))
    return out, len(links)


def cluster(rng, centre, n, noise):
    return [(centre + rng.normal(size=len(centre)) * noise).tolist() for _ in range(n)]


def run(spark, rows, **params):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns(
        {"node": F.lit("x"), "root": F.lit(1), "leaf": F.lit(2), "good": F.lit(3)}
    )
    return sorted((tuple(r) for r in X.near_duplicates(df, X.Params(**params)).collect()), key=str)


@pytest.mark.parametrize("leaf,block", [(512, 1024), (40, 13)])
def test_clusters_copies_and_labels(spark, leaf, block):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for v in cluster(rng, centre, 14, 0.1):
            rows.append((len(rows), v, c % 3))
    dense = rng.normal(size=16)
    rows += [(len(rows) + i, v, 1) for i, v in enumerate(cluster(rng, dense, 60, 0.02))]
    rows += [(len(rows) + i, dense.tolist(), [1, 2, None][i % 3]) for i in range(30)]
    want, pairs = brute(rows)
    got = run(spark, rows, leaf_rows=leaf, block_rows=block)
    assert pairs > 1500 and got == sorted(want, key=str)


def test_recall_on_given_vectors(spark):
    """The given vectors hold no pair this near, so one in five gets three neighbours of 0.98 to 1."""
    import pandas as pd

    e = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    rng = np.random.default_rng(21)
    rows = [(int(i), v, int(c)) for i, v, c in zip(e.vec_id, e.embedding, e.label)]
    for i, v, c in rows[::5]:
        for k in range(1, 4):
            near = v + rng.normal(size=len(v)) * rng.uniform(0.0, 0.19) / math.sqrt(len(v))
            rows.append((i + k * 1_000_000, near.astype(np.float32), c))
    table = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"])
    got = X.near_duplicates(spark.createDataFrame(
        [(i, [float(x) for x in v], c) for i, v, c in rows], "vec_id bigint, embedding array<float>, label int")).toPandas()
    assert sorted(got.vec_id) == sorted(table.vec_id)
    want, close = 0, 0
    for _, part in table.groupby("label"):
        x = X.unit(np.stack(part.embedding.to_numpy()))
        cosine = x @ x.T
        want += int((cosine >= 0.98).sum()) - len(x)
        close += int(((cosine >= 0.98) & (cosine < 0.99)).sum())
    assert want > 2000 and close > 400  # near the limit, too
    assert want * 0.99 <= got.n_links.sum() <= want
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_bad_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [2.0, 0.0], None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [], 0)]
    rows += [(7, [1.0, None], 0), (8, [float("nan"), 1.0], 0), (9, [float("inf"), 1.0], 0), (9, [1.0, 0.0], 0)]
    rows += [(None, [1.0, 0.0], 0), (None, [0.0, 1.0], 0), (12, [1e-30, 0.0], 0), (13, [3e38, 1e30], 0)]
    assert run(spark, rows) == sorted(brute(rows[:-2] + [(12, [1.0, 0.0], 0), (13, [1.0, 0.0], 0)])[0], key=str)
    assert run(spark, []) == []


@pytest.mark.parametrize("kind,labels", [("double", (1.2, 1.7)), ("string", ("a", "b"))])
def test_labels_of_other_types(spark, kind, labels):
    rows = [(i, [1.0, 0.01 * i], labels[i % 2]) for i in range(6)]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<float>, label {kind}")
    got = sorted(map(tuple, X.near_duplicates(df).collect()))
    assert got == [(i, 2, i % 2, i < 2) for i in range(6)]


@pytest.mark.parametrize("sample", [20_000, 3])
def test_each_width_has_its_near_duplicates(spark, sample):
    rng = np.random.default_rng(4)
    rows = []
    for width in (8, 16, 5):
        for c in range(1 if width == 5 else 10):
            rows += [(len(rows) + i, v, c % 2) for i, v in enumerate(cluster(rng, rng.normal(size=width), 8, 0.05))]
    want, pairs = brute(rows)
    assert pairs > 300 and run(spark, rows, leaf_rows=40, sample_rows=sample) == sorted(want, key=str)
