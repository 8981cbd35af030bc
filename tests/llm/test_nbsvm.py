from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sentrylake.llm import nbsvm

from .helpers import documents, read

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = nbsvm.quality_scores(docs, labels).toPandas()
    assert len(got) == len(read(SF, "documents")) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)).all()
    both = got.merge(read(SF, "labels"), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert (held[held.quality == 0].predicted == 0).mean() > 0.85


def plain_indicators(text: bytes) -> set[int]:
    """The same indicators, one at a time."""
    out = set()
    mask = (1 << 64) - 1

    def slot(x, kind):
        x = ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & mask
        return (x >> (64 - nbsvm.BITS)) + kind * nbsvm.SLOTS

    def word_hash(w):
        return sum((b + 1) * pow(0x100000001B3, i, 1 << 64) for i, b in enumerate(w)) & mask

    for i in range(len(text) - 3):
        out.add(slot(int.from_bytes(text[i : i + 4], "little"), 2))
    for i in range(len(text) - nbsvm.GRAM + 1):
        code = 0
        for b in text[i : i + nbsvm.GRAM]:
            code = code * nbsvm.CLASSES + int(nbsvm.BYTE_CLASS[b])
        out.add(3 * nbsvm.SLOTS + code)
    words = text.split()
    out |= {slot(word_hash(w), 0) for w in words}
    out |= {slot((word_hash(a) * 3 + word_hash(b) * 0x9E3779B97F4A7C15) & mask, 1) for a, b in zip(words, words[1:])}
    for k in range(1, 4):
        if any(len(set(words[i : i + k + 1])) == 1 for i in range(len(words) - k)):
            out.add(3 * nbsvm.SLOTS + nbsvm.SHAPES + k - 1)
    return out


def test_indicators_match_the_plain_form():
    rows = ["Ab cd cd cd ef", "", "x", "   ", "no space", "éé ÉÉ!! 12", "tail ", " head", "a a a a", None]
    batch = pa.RecordBatch.from_pydict({"text": rows})
    got: dict[int, set] = {i: set() for i in range(len(rows))}
    for i, f in nbsvm.indicators(batch, nbsvm.Params(block_bytes=9)):
        got[i] |= set(f.tolist())
        assert len(set(f.tolist())) == len(f)
    assert got == {i: plain_indicators((t or "").encode()) for i, t in enumerate(rows)}


def test_windows_cover_long_texts():
    text = " ".join(f"word{i}" for i in range(500)).encode()
    data = np.frombuffer(text + b"short" + text, np.uint8)
    at = np.array([0, len(text), len(text) + 5, len(data)])
    cuts, owner = nbsvm.window_cuts(data, at, 100)
    assert set(owner.tolist()) == {0, 1, 2} and (np.diff(cuts) > 0).all() and (np.diff(cuts) < 170).all()
    assert set(at.tolist()) <= set(cuts.tolist())
    assert all(data[c] == 32 or c in at for c in cuts[:-1].tolist())


def test_dual_coordinate_descent_separates():
    rows = [(np.array([i % 2, nbsvm.WIDTH]), np.array([1.0, 1.0])) for i in range(20)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(20)])
    w = nbsvm.dual_coordinate_descent(rows, y, np.ones(20), 50)
    assert all(c * float(w[a] @ v) > 0.99 for (a, v), c in zip(rows, y))


def test_odd_rows_and_labels(spark):
    rows = [(1, "good words here"), (2, None), (3, ""), (4, "BAD!! BAD!! BAD!!"), (4, "BAD!! BAD!! BAD!!"), (None, "good words")]
    docs = documents(spark, rows).withColumns({"score": F.lit("own"), "predicted": F.lit(1), "y": F.lit(1), "n": F.lit(2)})
    for pairs in ([], [(1, 1)], [(4, 0)], [(1, 1), (4, 0), (4, 1), (None, 0), (77, None)]):
        labels = spark.createDataFrame([(d, q, 0) for d, q in pairs], "doc_id bigint, quality int, toxic int")
        got = nbsvm.quality_scores(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = nbsvm.keep_good(docs, spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int"))
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {"own"}
    assert nbsvm.quality_scores(documents(spark, []), labels).count() == 0
