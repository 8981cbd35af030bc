from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from sentrylake.llm import toxicity as X

from .helpers import documents, read

SF = "/root/testdata/sf0.01"
NAMES = list(X.FEATURES)


def of(text, lexicon, most=100):
    return dict(zip(NAMES, X.features(text.encode(), X.Words(lexicon, most)).tolist()))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = X.toxicity_scores(docs, labels).toPandas()
    assert len(got) == len(read(SF, "documents")) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    both = got.merge(read(SF, "labels"), on="doc_id")
    assert (both.predicted == both.toxic).mean() > 0.94


def test_features_by_hand():
    lexicon = {b"scum": 3.0, b"^moro": 2.0}
    f = of("YOU are Scum! clean words here and more m0r0n?", lexicon)
    assert f["hits_log"] == np.log1p(2) and f["strongest"] == 3.0 and f["second_strongest"] == 2.0
    assert f["near_second_person"] == 1 and abs(f["second_person_rate"] - 1 / 9) < 1e-12
    assert f["obfuscated_hits"] == 1 and abs(f["capital_rate"] - 4 / 46) < 1e-12 and f["capital_words"] == 1 / 9
    assert not any(of("", lexicon).values()) and not any(of(" \n ", lexicon)[n] for n in NAMES)


def test_small_cache_and_pieces_change_nothing(monkeypatch):
    lexicon = {b"scum": 3.0, b"^moro": 2.0}
    text = " ".join(f"w{i % 50} scum you{i % 7} x!" for i in range(300))
    whole = of(text, lexicon, 10_000)
    assert of(text, lexicon, 3) == whole
    small = X.pieces
    monkeypatch.setattr(X, "pieces", lambda t: small(t, 64))
    cut = of(text, lexicon)
    assert all(abs(cut[n] - whole[n]) < 1e-9 for n in NAMES if n != "near_second_person")


def test_isotonic_matches_brute_force():
    rng = np.random.default_rng(5)
    m = np.round(rng.normal(size=60), 1)
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * m))).astype(int)
    at, value = X.isotonic(m, y, np.ones(60))
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all()
    levels = sorted(set(m))
    mean = lambda i, j: y[(m >= levels[i]) & (m <= levels[j])].mean()
    for k, v in enumerate(levels):  # min-max formula
        best = max(min(mean(i, j) for j in range(k, len(levels))) for i in range(k + 1))
        assert abs(np.interp(v, at, value) - best) < 0.02


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    trees = X.boost(x[:600], y[:600], np.ones(600), X.Params())
    assert ((trees.margin(x[600:]) > 0) == y[600:]).mean() > 0.93


def test_odd_rows_and_labels(spark):
    rows = [(1, "good words here"), (2, None), (3, ""), (4, "you scum"), (4, "you scum"), (None, "good words")]
    docs = documents(spark, rows).withColumns({"score": F.lit("own"), "predicted": F.lit(1), "y": F.lit(1), "x": F.lit(2)})
    for pairs in ([], [(1, 0)], [(4, 1)], [(1, 0), (4, 1), (4, 0), (None, 1), (77, None)]):
        labels = spark.createDataFrame([(d, 1, t) for d, t in pairs], "doc_id bigint, quality int, toxic int")
        got = X.toxicity_scores(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = X.drop_toxic(docs, spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int"))
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert X.toxicity_scores(documents(spark, []), labels).count() == 0
