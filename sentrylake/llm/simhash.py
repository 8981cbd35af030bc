"""SimHash near duplicates with Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits.  Each is decoded in the
perfect binary Golay code [23, 12]: every word lies within three bits of one codeword.  The keys
of a segment are the codewords that some word within one bit of it decodes to: one if the segment
is within two bits of its codeword, six otherwise.  Two segments that differ in at most two bits
have a word within one bit of both, hence a common key.  Two fingerprints that differ in at most
four bits have two segments with at most two differing bits each, so they meet under one of the
three pairs of segments.  Joined keys are verified on the full fingerprints; nothing is lost.

Keys are dealt by hash and sorted; each group is compared in numpy and gives back a spanning
forest of its links, never all pairs.  A group above ``bucket_rows`` is written out and compared
in pairs of blocks by separate tasks, which is exact as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, pieces, stored, texts
from .graph import components

MAX_BITS = 4
SEED = 42
SHINGLE = 4
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GENERATOR = 0b110001110101
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and width, from the high bits down


# ---------------------------------------------------------------------------
# fingerprints
# ---------------------------------------------------------------------------


def _add_bits(hashes: list[int]) -> np.ndarray:
    raw = np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the whole text; A-Z count as a-z, words are cut at ASCII white space."""
    digest, ones, total, carry = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for part in pieces(text):
        words = carry + part.lower().split()
        n = len(words) - shingle + 1
        if n > 0:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = [0, *(ends[: n - 1] + 1).tolist()]
            hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
            ones += _add_bits(hashes)
            total += n
            carry = words[n:]
        else:
            carry = words
    if total == 0:
        if not carry:
            return 0
        return digest(b" ".join(carry), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_no`` (unique) and ``fp`` (the fingerprint as a signed bigint)."""
    fields = [f for f in docs.schema.fields if f.name not in ("row_no", "fp")]
    docs = only(docs, *[f.name for f in fields])
    schema = T.StructType([*fields, T.StructField("row_no", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], names=[*b.schema.names, "fp"])

    numbered = docs.withColumn("row_no", F.monotonically_increasing_id())
    return numbered.mapInArrow(run, schema)


# ---------------------------------------------------------------------------
# Golay keys
# ---------------------------------------------------------------------------


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder by the generator polynomial: 11 bits."""
    out = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        out ^= np.where(out >> bit & 1, GENERATOR << (bit - 11), 0)
    return out


def _patterns() -> np.ndarray:
    """For each syndrome the error patterns that lead to its keys (2048 x 6, -1 where unused).

    The first is the coset leader.  If that has weight three, five patterns of weight four follow:
    the other codewords that words one bit away decode to.
    """
    table = np.full((2048, 6), -1, np.int64)
    single = 1 << np.arange(23)
    light = [np.zeros(1, np.int64), single]
    for _ in range(3):
        last = light[-1]
        light.append(np.unique((last[:, None] | single[None, :])[(last[:, None] & single[None, :]) == 0]))
    filled = np.zeros(2048, np.int64)
    weight = np.zeros(2048, np.int64)
    for k, patterns in enumerate(light):
        for p, s in zip(patterns.tolist(), _syndromes(patterns).tolist()):
            if filled[s] == 0:
                weight[s] = k
            elif not (k == 4 and weight[s] == 3):
                continue
            table[s, filled[s]] = p
            filled[s] += 1
    return table


PATTERNS = _patterns()


def segment_keys(words: np.ndarray) -> np.ndarray:
    """Codeword numbers (n x 6, -1 where unused) of segments of at most 23 bits."""
    patterns = PATTERNS[_syndromes(words)]
    return np.where(patterns >= 0, (words[:, None] ^ patterns) >> 11, -1)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in ``fps``): every key of every fingerprint (uint64)."""
    parts = [segment_keys((fps >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64)) for s, w in SEGMENTS]
    keys, at = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = parts[i][:, :, None], parts[j][:, None, :]
        both = np.where((a >= 0) & (b >= 0), pair << 24 | a << 12 | b, -1).reshape(len(fps), 36)
        row, col = np.nonzero(both >= 0)
        keys.append(both[row, col])
        at.append(row)
    return np.concatenate(keys), np.concatenate(at)


# ---------------------------------------------------------------------------
# links
# ---------------------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest position reachable over the links a-b, for each of ``n`` positions."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _within_groups(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints with equal key (rows sorted by key), thinned to a forest."""
    left, right, shift = [], [], 1
    rows = np.arange(len(keys))
    while len(rows):
        rows = rows[rows + shift < len(keys)]
        rows = rows[keys[rows] == keys[rows + shift]]
        near = rows[np.bitwise_count(fps[rows] ^ fps[rows + shift]) <= bits]
        left.append(near)
        right.append(near + shift)
        shift += 1
    left, right = np.concatenate(left or [rows]), np.concatenate(right or [rows])
    if not len(left):
        return fps[:0], fps[:0]
    label = forest(left, right, len(keys))
    moved = np.flatnonzero(label != np.arange(len(keys)))
    return fps[moved], fps[label[moved]]


def _block_links(x: np.ndarray, y: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = [], []
    for at in range(0, len(x), 256):
        i, j = np.nonzero(np.bitwise_count(x[at : at + 256, None] ^ y[None, :]) <= bits)
        a.append(i + at)
        b.append(j + len(x))
    both = np.concatenate([x, y])
    label = forest(np.concatenate(a), np.concatenate(b), len(both))
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[moved], both[label[moved]]


_LINK = "kind int, key bigint, a bigint, b bigint"


def _link_batch(kind: int, key, a, b) -> pa.RecordBatch:
    n = len(a)
    key = np.zeros(n, np.int64) if key is None else key
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(key), pa.array(a.astype(np.uint64).view(np.int64)), pa.array(b)],
        names=["kind", "key", "a", "b"],
    )


def near_links(distinct: DataFrame, bits: int = MAX_BITS, bucket_rows: int = 4096, block_rows: int = 2048) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints (``fp``, distinct) within ``bits`` bits.

    Within a group of equal keys the links lead from each fingerprint to the smallest position that
    it reaches there, so a pair returned is connected by near pairs, not always near itself.
    """
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the keys hold up to {MAX_BITS} differing bits, not {bits}")

    def emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(signed), 4096):
                part = signed[at : at + 4096]
                keys, row = golay_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[row])], names=["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key.  kind 0: link a-b; kind 1: row a of an oversize group, at place b."""
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        large, place = None, 0

        def done(keys, fps):
            a, b = _within_groups(keys, fps, bits)
            return _link_batch(0, None, a, b.view(np.int64))

        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
            sizes = np.diff(np.r_[starts, len(k)])
            small = np.ones(len(k), bool)
            for s, n in zip(starts[sizes > bucket_rows], sizes[sizes > bucket_rows]):
                place = place if large == k[s] else 0
                yield _link_batch(1, k[s : s + n], f[s : s + n], np.arange(place, place + n))
                large, place = k[s], place + n
                small[s : s + n] = False
            if large is not None and len(k) and k[0] == large and small[0]:
                n = sizes[0]
                yield _link_batch(1, k[:n], f[:n], np.arange(place, place + n))
                place += n
                small[:n] = False
            k, f = k[small], f[small]
            last = np.searchsorted(k, k[-1]) if len(k) else 0
            if len(k):
                yield done(k[:last], f[:last])
            held_k, held_f = k[last:], f[last:]
        if len(held_k):
            yield done(held_k, held_f)

    def compare_blocks(pdf):
        x = pdf.loc[pdf.side == 0, "a"].to_numpy().view(np.uint64)
        y = pdf.loc[pdf.side == 1, "a"].to_numpy().view(np.uint64)
        a, b = _block_links(x, y if len(y) else x, bits)
        import pandas as pd

        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    spark = distinct.sparkSession
    keys = distinct.select("fp").mapInArrow(emit_keys, "key bigint, fp bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(compare, _LINK))
    over = found.filter("kind = 1").select("key", "a", F.expr(f"b div {block_rows}").alias("block"))
    blocks = over.groupBy("key").agg((F.max("block") + 1).alias("n"))
    over = over.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    paired = over.select(
        "key", "a", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    more = paired.groupBy("key", "i", "j").applyInPandas(compare_blocks, "a bigint, b bigint")
    return found.filter("kind = 0").select("a", "b").union(more)


def simhash_components(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with ``row_no``, ``fp``, ``fingerprint`` (16 hex digits), ``component_id`` and ``first_row``.

    ``component_id`` is the smallest doc_id among the documents reachable by links, ``first_row``
    the row that stands for the group: among its rows with that doc_id the one numbered lowest.
    Null and empty texts have fingerprint zero and link like any other; null doc_ids are passed
    over in the minimum and come last among the rows (a group of null ids only has component null);
    repeated rows stay, all in one group.  An empty table gives an empty one.
    """
    own = ("row_no", "fp", "fingerprint", "component_id", "first_row")
    docs = docs.select(*[docs[c] for c in docs.columns if c not in own])
    rows = stored(fingerprints(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_no").alias("row"))
    distinct = stored(rows.groupBy("fp").agg(F.min(order).alias("least")))
    found = components(near_links(distinct, bits))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"
    )
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    labelled = rooted.join(best, "root").select(
        F.col("fp").alias("of"), F.col("best.id").alias("component_id"), F.col("best.row").alias("first_row")
    )
    return (
        rows.join(labelled, rows["fp"] == labelled["of"]).drop("of")
        .withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    )


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    return simhash_components(only(docs, "doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns."""
    found = simhash_components(docs)
    return found.filter("row_no = first_row").select(*[found[c] for c in docs.columns])
