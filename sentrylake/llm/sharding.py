"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws -ln(u) / weight, with u a hash of the key and the child's name, and
the least draw wins; a child's weight is the sum over its shards.  Draws are independent, so a
child wins with probability proportional to its weight, and where one weight rises, keys move only
into that child: movement stays in the subtrees whose weights change.

A tree of ``n`` shards has a fixed core (``CORE`` shards in regions of eight, racks of four); each
shard added beyond it is a region of its own.  Growing by one shard therefore changes one weight at
the top, and rows move into the new shard alone.  The tree is a small table of expressions; a row's
place is computed where the row is, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stored

CORE = 16
RACK = 4
REGION = 8
BLOCK_ROWS = 100_000

#: Rows of (region, rack, shard, weight).
Tree = Sequence[tuple[str, str, int, float]]


def tree_of(shards: int, core: int = CORE) -> list[tuple[str, str, int, float]]:
    """(region, rack, shard, weight) of ``shards`` equal shards: those up to ``core`` in full regions, the rest alone."""
    out = []
    for s in range(shards):
        region, rack = (f"r{s // REGION}", f"k{s // RACK}") if s < core else (f"r+{s}", f"k+{s}")
        out.append((region, rack, s, 1.0))
    return out


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1]: exponential with rate ``weight``."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double")
    return -F.log((bits + 1.0) / float(1 << 53)) / weight


def _descend(key: Column, children: dict[str, tuple[float, Column]]) -> Column:
    """The value of the child with the least draw; ties by name."""
    if len(children) == 1:
        return next(iter(children.values()))[1]
    names = sorted(children)
    draws = [_draw(key, n, children[n][0]) for n in names]
    best = F.array_position(F.array(*draws), F.least(*draws))
    out = F.when(best == 1, children[names[0]][1])
    for i, n in enumerate(names[1:], 2):
        out = out.when(best == i, children[n][1])
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """Shard number for ``key``: region, then rack, then shard."""
    regions: dict[str, dict[str, dict[str, tuple[float, Column]]]] = {}
    for region, rack, shard, weight in tree:
        if weight > 0:
            leaf = regions.setdefault(region, {}).setdefault(f"{region}/{rack}", {})
            leaf[f"{region}/{rack}/{shard}"] = (weight, F.lit(shard))
    if not regions:
        raise ValueError("the tree has no shard of positive weight")
    total = lambda leaves: sum(w for w, _ in leaves.values())
    top = {}
    for region, racks in regions.items():
        inner = {rack: (total(leaves), _descend(key, leaves)) for rack, leaves in racks.items()}
        top[region] = (sum(w for w, _ in inner.values()), _descend(key, inner))
    return _descend(key, top).cast("int")


def place(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard`` (with one shard more), decided by doc_id and the count alone.

    Null ids share one place; columns of the same names are replaced.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keep = [c for c in docs.columns if c not in ("shard", "grown_shard")]
    return docs.select(
        *keep, shard_of(key, tree_of(shards)).alias("shard"), shard_of(key, tree_of(shards + 1)).alias("grown_shard")
    )


def slots(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``slot``: gapless from 0 within each shard.

    Equal rows are counted before the shuffle; shards are cut into blocks by a hash of the row, and
    a block starts where the ones before it end, so no task numbers a whole shard.  ``keys``: columns
    that tell rows apart, ``shard`` among them.
    """
    distinct = stored(rows.groupBy(*keys).agg(F.count("*").alias("_n")))
    blocks = max(1, -(-distinct.count() // BLOCK_ROWS))
    order = [F.col(k).asc_nulls_first() for k in keys if k != "shard"]
    distinct = distinct.withColumn("_block", F.pmod(F.xxhash64(*[k for k in keys if k != "shard"]), F.lit(blocks)))
    up = (W.unboundedPreceding, -1)
    sums = distinct.groupBy("shard", "_block").agg(F.sum("_n").alias("_m"))
    starts = sums.select("shard", "_block", F.coalesce(
        F.sum("_m").over(W.partitionBy("shard").orderBy("_block").rowsBetween(*up)), F.lit(0)).alias("_from"))
    within = F.coalesce(F.sum("_n").over(W.partitionBy("shard", "_block").orderBy(*order).rowsBetween(*up)), F.lit(0))
    numbered = distinct.withColumn("_within", within).join(starts, ["shard", "_block"])
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))
    return numbered.withColumn("_at", at).select(*keys, (F.col("_from") + F.col("_within") + F.col("_at")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard; a row per document.

    The law is ``key``.  A null text has no bytes (size 1, crc 0); repeated rows get slots of their
    own; columns other than doc_id and text are not read; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    light = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = slots(place(light, shards), ["shard", "grown_shard", "doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Documents as Parquet in folders ``shard=<n>``; a shard is written by many tasks, a file each."""
    if "shard" in docs.columns:
        raise ValueError("documents already have a column 'shard'")
    place(docs, shards).drop("grown_shard").write.partitionBy("shard").parquet(path)


def moved(tree: Tree, other: Tree, keys: DataFrame) -> DataFrame:
    """Keys (column ``key``) whose shard differs between two trees: key, shard, other_shard."""
    both = keys.select("key", shard_of(F.col("key"), tree).alias("shard"), shard_of(F.col("key"), other).alias("other_shard"))
    return both.filter("shard <> other_shard")
