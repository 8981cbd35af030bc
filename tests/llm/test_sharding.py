from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sentrylake.llm import sharding as S

from .helpers import documents, read


def test_given_documents(spark, sf):
    docs = read(sf, "documents").set_index("doc_id")
    got = S.shard_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs.index)
    held = defaultdict(list)
    for r in got:
        data = docs.text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        held[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in held.values())


def test_shares_follow_weights_and_growth_takes_only_into_the_new_shard(spark):
    keys = spark.range(40_000).select(F.col("id").cast("string").alias("key"))
    for n in (1, 3, 15, 16, 17, 20):
        count = Counter(r.shard for r in keys.select(S.shard_of(F.col("key"), S.tree_of(n)).alias("shard")).collect())
        assert len(count) == n and all(abs(c * n / 40_000 - 1) < 0.12 for c in count.values())
    for n in (1, 16, 17, 18):
        gone = S.moved(S.tree_of(n), S.tree_of(n + 1), keys).collect()
        if n >= S.CORE:
            assert {r.other_shard for r in gone} == {n} and abs(len(gone) * (n + 1) / 40_000 - 1) < 0.12
    uneven = [("a", "x", 0, 3.0), ("a", "y", 1, 1.0), ("b", "z", 2, 4.0)]
    count = Counter(r.s for r in keys.select(S.shard_of(F.col("key"), uneven).alias("s")).collect())
    assert abs(count[0] / 15_000 - 1) < 0.05 and abs(count[1] / 5_000 - 1) < 0.08 and abs(count[2] / 20_000 - 1) < 0.05


def test_a_weight_change_moves_rows_only_into_its_subtree(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    tree = S.tree_of(16)
    more = [(r, k, s, w + 1.0 if s == 5 else w) for r, k, s, w in tree]
    for r in S.moved(tree, more, keys).collect():
        old, new = tree[r.shard], tree[r.other_shard]
        assert new[0] == "r0"  # into the region that grew
        if old[0] == "r0":
            assert new[1] == "k1"  # within it, into the rack that grew
            if old[1] == "k1":
                assert r.other_shard == 5  # within that, into the shard that grew
    without = [(r, k, s, 0.0 if s == 5 else w) for r, k, s, w in tree]
    assert all(r.shard == 5 or tree[r.shard][0] == "r0" for r in S.moved(tree, without, keys).collect())


def test_odd_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(S, "BLOCK_ROWS", 2)
    rows = [(1, None), (2, ""), (3, "é"), (3, "é"), (None, "x"), (None, "x"), (None, None), *[(9, "same")] * 50]
    docs = documents(spark, rows).withColumns({"shard": F.lit("own"), "size": F.lit(1), "slot": F.lit(2), "_n": F.lit(3)})
    got = S.shard_documents(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len((t or "").encode()) + 1) for d, t in rows)
    held = defaultdict(list)
    for r in got:
        held[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    assert S.shard_documents(documents(spark, [])).count() == 0
    S.write_shards(docs.drop("shard"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.filter("doc_id = 9").select("shard").distinct().count() == 1
