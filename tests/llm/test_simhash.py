from __future__ import annotations

import numpy as np
import pytest
import xxhash

from sentrylake.llm import graph, simhash

from .helpers import documents, groups, read


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    fp = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(fp)
    links = [(a, b) for a in ids for b in ids if a < b and bin(fp[a] ^ fp[b]).count("1") <= 4]
    return {i: (f"{fp[i]:016x}", c) for i, c in groups(ids, links).items()}


def test_all_words_within_two_bits_share_a_key():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 22, 400)
    for i, j in ((0, 0), (3, 3), (0, 21), (5, 17), (20, 21)):
        y = x ^ (1 << i) if i == j else x ^ (1 << i) ^ (1 << j)
        a, b = simhash.segment_keys(x), simhash.segment_keys(y)
        assert ((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).any(axis=(1, 2)).all()


def test_fingerprint_of_long_text_in_pieces(monkeypatch):
    text = " ".join(f"Word{i % 97} x{i}" for i in range(3000))
    whole = simhash.fingerprint(text.encode())
    assert whole == plain_fingerprint(text)
    small = simhash.pieces
    monkeypatch.setattr(simhash, "pieces", lambda t: small(t, 100))
    assert simhash.fingerprint(text.encode()) == whole


def test_components_on_the_given_documents(spark, sf):
    docs = read(sf, "documents")
    want = expected(list(zip(docs.doc_id, docs.text)))
    got = simhash.near_duplicate_groups(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(docs)


def test_empty_null_short_and_repeated(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (4, "one two"), (8, "One TWO"), (7, "unlike the others here now")]
    got = simhash.near_duplicate_groups(documents(spark, rows)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == expected(rows)
    twice = documents(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None)])
    assert sorted(str(r.doc_id) for r in simhash.keep_first(twice).collect()) == ["1", "None"]
    assert simhash.near_duplicate_groups(documents(spark, [])).count() == 0


def test_clashing_and_extra_columns(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, [(1, "a b c d e"), (2, "a b c d e")]).withColumns({"fp": F.lit("x"), "a": F.lit(1), "root": F.lit(2), "node": F.lit(3)})
    kept = simhash.keep_first(docs)
    assert [r.doc_id for r in kept.collect()] == [1] and set(kept.columns) == set(docs.columns)


@pytest.mark.parametrize("cap,block", [(4096, 2048), (8, 5), (20, 7)])
def test_links_connect_what_brute_force_connects(spark, cap, block):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:6].tolist():
        for _ in range(40):
            x = b
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    links = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 4]
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    got = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_links(df, bucket_rows=cap, block_rows=block).collect()]
    assert groups(fps, got) == groups(fps, links)


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)]
    links += [(int(a), int(b)) for a, b in rng.integers(2000, 2100, (60, 2))]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    nodes = sorted({x for e in links for x in e if e[0] != e[1]})
    got = {r.node: r.root for r in graph.components(df).collect()}
    assert got == {n: r for n, r in groups(nodes, [e for e in links if e[0] != e[1]]).items()}
