from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from sentrylake.llm import mixing, nbsvm, packing, simhash, toxicity

from .test_simhash import expected

SF = "/root/testdata/sf0.01"


def test_each_stage_on_its_own_input(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        got = simhash.stored(stage(spark, docs, SF))
        rows = {r.doc_id: r for r in docs.collect()}
        ids = [r.doc_id for r in got.select("doc_id").collect()]
        if name != "packing":
            assert got.columns == columns and all(r == rows[r.doc_id] for r in got.collect())
        if name in ("toxicity", "quality"):
            score = toxicity.toxicity_scores(docs, labels) if name == "toxicity" else nbsvm.quality_scores(docs, labels)
            keep = score.filter(f"predicted = {int(name == 'quality')}")
            assert sorted(ids) == sorted(r.doc_id for r in keep.collect()) and 0 < len(ids) < len(rows)
        if name == "near_dedup":
            want = expected([(i, r.text) for i, r in rows.items()])
            assert sorted(ids) == sorted({c for _, c in want.values()}) and len(ids) < len(rows)
        if name == "mixing":
            want = {r.doc_id: r for r in mixing.mix(docs).collect()}
            took, goal = Counter(), {r.source: r.target for r in want.values()}
            for i in ids:
                took[rows[i].source] += want[i].size
            assert max(Counter(ids).values()) <= 3
            assert all(abs(took[s] - t) <= max(r.size for r in want.values() if r.source == s) for s, t in goal.items())
        if name == "packing":
            t = Tokenizer.from_file(packing.default_tokenizer())
            mixed = docs.collect()
            tokens = [np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in mixed]
            left = Counter(
                (r.doc_id, a, zlib.crc32(x[a : a + 2048].tobytes())) for r, x in zip(mixed, tokens) for a in range(0, len(x), 2048)
            )
            assert left == Counter((r.doc_id, r.start, r.ids_crc32) for r in got.collect())
            packs = defaultdict(int)
            for r in got.collect():
                packs[r.sequence_id] += r.length
            assert max(packs.values()) <= 2048
        out[name] = len(ids)
        docs = got
    assert corpus_pipeline.ORACLE_SQL is None and len(out) == 5


def test_registered_and_repeatable(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").select(
        "doc_id", "start", "ids_crc32").collect())) for _ in range(2))
    assert a == b and a


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
