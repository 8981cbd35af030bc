"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes from learned rotations: the principal axes of a bounded sample, turned by
alternating sign codes and orthogonal fits, several times from different starts where the code has
more bits than the vector has dimensions.  A code is cut into substrings of 16 bits and each shelf
of vectors has one table per substring.  For a Hamming radius r = m * a + b over m substrings, a code
within r differs by at most a bits in one of the first b + 1 substrings or by less than a in one of
the others, so probing those keys misses no code of the radius.  What is found is held against the
whole code and then ranked by the inner products of the vectors themselves.

A query's radius follows from a score that it has surely k neighbours of: first the k best of the
sample, then those of some shelves, about the root of their number; then all shelves are probed.  The angle of that score gives
the expected number of differing bits, and ``margin`` standard deviations are added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import by_hash, stored
from .shelves import SHELF_ROWS, matrix, missing, numbers, shelved, spread_over, visit

SUBSTRING = 16
BLOCK = 256
FEW = 2  # radii up to here are probed key by key, larger ones against the keys there are


@dataclass(frozen=True)
class Params:
    bits: int = 256
    sample_rows: int = 4096
    turns: int = 12
    margin: float = 2.0
    shelf_rows: int = SHELF_ROWS
    seed: int = 7


def rotations(sample: np.ndarray, params: Params) -> np.ndarray:
    """Columns to project on: ``bits`` of them, learned from the unit vectors of ``sample``."""
    rng = np.random.default_rng(params.seed)
    width = sample.shape[1]
    axes = np.linalg.svd(sample, full_matrices=True)[2].T[:, : min(width, params.bits)]
    out = []
    while sum(r.shape[1] for r in out) < params.bits:
        turn = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        projected = sample @ axes
        for _ in range(params.turns):
            u, _, v = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
            turn = (u @ v).T
        out.append(axes @ turn)
    return np.concatenate(out, axis=1)[:, : params.bits]


def codes(vectors: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Substrings: rows by ``bits / 16`` numbers of 16 bits."""
    packed = np.packbits(vectors @ projection >= 0, axis=1)
    return np.ascontiguousarray(packed).view(np.uint16)


def _within(radius: int) -> np.ndarray:
    """Differences of at most ``radius`` bits."""
    every = np.arange(1 << SUBSTRING, dtype=np.uint32)
    return every[np.bitwise_count(every) <= radius].astype(np.uint16)


class Index:
    """Tables of one shelf: for each substring its keys and the rows that have them."""

    def __init__(self, code: np.ndarray):
        self.code, self.n, self.m = code, len(code), code.shape[1]
        self.words = np.ascontiguousarray(code).view(np.uint64) if self.m % 4 == 0 else code
        self.tables, self.near = [], {a: _within(a) for a in range(FEW + 1)}
        for j in range(self.m):
            keys, place = np.unique(code[:, j], return_inverse=True)
            at = np.full(1 << SUBSTRING, -1, np.int32)
            at[keys] = np.arange(len(keys))
            order = np.argsort(place, kind="stable")
            starts = np.searchsorted(place[order], np.arange(len(keys) + 1))
            self.tables.append((keys, place, at, order, starts))

    def probe(self, query: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """query by row: true where a substring is as near as the radius demands of one."""
        hit = np.zeros((len(query), self.n), bool)
        a, b = radius // self.m, radius % self.m
        for j, (keys, place, at, order, starts) in enumerate(self.tables):
            least = np.where(j <= b, a, a - 1)
            for few in range(FEW + 1):
                who = np.flatnonzero(least == few)
                if len(who):
                    found = at[query[who, j][:, None] ^ self.near[few][None, :]]
                    q, k = np.nonzero(found >= 0)
                    k = found[q, k]
                    count = starts[k + 1] - starts[k]
                    rows = np.repeat(starts[k] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                    hit[np.repeat(who[q], count), order[rows]] = True
            who = np.flatnonzero(least > FEW)
            if len(who):
                far = np.bitwise_count(query[who, j][:, None] ^ keys[None, :])
                hit[who] |= (far <= least[who, None])[:, place]
        return hit

    def within(self, query: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of every code at ``radius`` differing bits or fewer."""
        hit = self.probe(query, radius)
        words = np.ascontiguousarray(query).view(np.uint64) if self.m % 4 == 0 else query
        if hit.mean() > 0.05:
            far = np.zeros(hit.shape, np.uint16)
            for w in range(words.shape[1]):
                far += np.bitwise_count(words[:, w, None] ^ self.words[None, :, w])
            return np.nonzero(hit & (far <= radius[:, None]))
        i, j = np.nonzero(hit)
        far = np.bitwise_count(words[i] ^ self.words[j]).sum(axis=1, dtype=np.int64)
        return i[far <= radius[i]], j[far <= radius[i]]


def radius_of(score: np.ndarray, query_norm: np.ndarray, most_norm: float, params: Params) -> np.ndarray:
    """Differing bits within which a vector of ``score`` or more is expected."""
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.clip(score / (query_norm * most_norm), -1.0, 1.0)
    share = np.arccos(np.where(np.isfinite(cosine), cosine, -1.0)) / np.pi
    share = np.where(score > -np.inf, share, 1.0)
    bits = params.bits * share + params.margin * np.sqrt(params.bits * share * (1 - share))
    return np.minimum(np.ceil(bits), params.bits).astype(np.int64)


def inner(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of x with rows j of y, each summed on its own, so that equal vectors score equally."""
    out = np.empty(len(i))
    for at in range(0, len(i), BLOCK * 64):
        part = slice(at, at + BLOCK * 64)
        out[part] = (x[i[part]] * y[j[part]]).sum(axis=1)
    return out


def best(i: np.ndarray, score: np.ndarray, none: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query i, ties to smaller ids, null ids last."""
    order = np.lexsort((rows, ids, none, -score, i))
    s = i[order]
    return order[np.arange(len(s)) - np.searchsorted(s, s) < k]


def usable(vectors: DataFrame) -> DataFrame:
    """id, v (doubles), width, norm, row: vectors null, empty, zero or with null or non-finite components are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & whole).select(F.col("vec_id").alias("id"), x.alias("v"))
    most = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("most", most).filter("most > 0")
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + (c / F.col("most")) * (c / F.col("most")))
    return rows.select(
        "id", "v", F.size("v").alias("width"), (F.col("most") * F.sqrt(squares)).alias("norm"),
        F.monotonically_increasing_id().alias("row"),
    )


_FOUND = "query_row bigint, query_id bigint, row bigint, vec_id bigint, score double"


def _found(part: pa.RecordBatch, q: np.ndarray, x: dict, j: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    take = pa.array(q)
    return pa.RecordBatch.from_arrays(
        [part.column(part.schema.get_field_index("at")).take(take), part.column(part.schema.get_field_index("query_id")).take(take),
         pa.array(x["row"][j]), pa.array(x["id"][j], mask=x["none"][j]), pa.array(score)],
        names=["query_row", "query_id", "row", "vec_id", "score"],
    )


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, params: Params = Params()) -> DataFrame:  # noqa: B008
    """query_id, rank (from 1), vec_id, score for every query among ``vectors`` (vec_id: bigint, embedding: array).

    ``is_query`` is a condition on ``vec_id``.  Candidates are all rows but the query's own (a repeated row is another row) with vectors as
    long as the query's; ties go to the smaller id, null ids last.  Vectors that are null, empty,
    zero or hold null or non-finite components take no part; columns other than vec_id and embedding
    are not read.  With fewer than k candidates all are returned; no vectors give an empty table.
    """
    rows = stored(usable(vectors))
    spark = rows.sparkSession
    count = rows.count()
    kept = by_hash(rows, params.sample_rows, count, "id", "v").orderBy(F.xxhash64("id", "v"), "id").limit(params.sample_rows).collect()
    samples: dict[int, dict] = {}
    for width in sorted({r.width for r in kept}):
        some = [r for r in kept if r.width == width]
        v = np.array([r.v for r in some])
        norm = np.array([r.norm for r in some])
        samples[width] = {
            "v": v, "projection": rotations(v / norm[:, None], params), "row": np.array([r.row for r in some], np.int64),
            "id": np.array([r.id or 0 for r in some], np.int64), "none": np.array([r.id is None for r in some], bool),
        }
    # vectors of a width that the sample has none of are projected at random
    def projection(width: int) -> np.ndarray:
        if width in samples:
            return samples[width]["projection"]
        return np.random.default_rng(params.seed).normal(size=(width, params.bits))

    # norms of a shelf lie close together, so that its greatest says much about each
    band = F.floor(F.ln("norm") / math.log(1.25) + 0.5).cast("int")
    place = F.xxhash64("id", "v", F.when(F.col("id").isNull(), F.col("row")))
    at_rest = stored(shelved(rows.withColumn("band", band), ["width", "band"], place, params.shelf_rows))
    shelves = stored(at_rest.groupBy("shelf", "width").agg(F.max("norm").alias("most")))
    shelves = shelves.select("shelf", F.col("width").alias("of"), "most")
    queries = rows.withColumnRenamed("id", "vec_id").filter(is_query).select(
        F.col("row").alias("at"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("norm").alias("q_norm"), "width")
    queries = stored(queries)
    spread = spread_over(queries.count())

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = numbers(b, "width")
            for width in np.unique(widths):
                if width not in samples:
                    continue
                x = samples[width]
                part = b.filter(pa.array(widths == width))
                for a in range(0, len(part), BLOCK):
                    some = part.slice(a, BLOCK)
                    q, own = matrix(some, "q"), numbers(some, "at")
                    rough = np.where(own[:, None] == x["row"][None, :], -np.inf, q @ x["v"].T)
                    take = min(2 * k + 8, rough.shape[1])  # the products are summed anew below
                    j = np.argpartition(rough, rough.shape[1] - take, axis=1)[:, rough.shape[1] - take :].ravel()
                    i = np.repeat(np.arange(len(q)), take)
                    other = own[i] != x["row"][j]
                    i, j = i[other], j[other]
                    score = inner(q, x["v"], i, j)
                    top = best(i, score, x["none"][j], x["id"][j], x["row"][j], k)
                    yield _found(some, i[top], x, j[top], score[top])

    def begin(table: pa.Table) -> dict:
        v = matrix(table, "v")
        return {"v": v, "row": numbers(table, "row"), "id": numbers(table, "id"), "none": missing(table, "id"),
                "most": float(numbers(table, "norm").max()), "index": Index(codes(v, projection(v.shape[1])))}

    def meet(x: dict, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(part), BLOCK):
            some = part.slice(a, BLOCK)
            q, own = matrix(some, "q"), numbers(some, "at")
            least = numbers(some, "least", -np.inf)
            radius = radius_of(least, numbers(some, "q_norm"), x["most"], params)
            i, j = x["index"].within(codes(q, projection(q.shape[1])), radius)
            other = own[i] != x["row"][j]
            i, j = i[other], j[other]
            score = inner(q, x["v"], i, j)
            good = score >= least[i]
            i, j, score = i[good], j[good], score[good]
            top = best(i, score, x["none"][j], x["id"][j], x["row"][j], k)
            yield _found(some, i[top], x, j[top], score[top])

    def told(found: DataFrame) -> DataFrame:
        """Queries with the k-th best score found, null where there are fewer."""
        nth = W.partitionBy("query_row").orderBy(F.desc("score"))
        kth = found.withColumn("n", F.row_number().over(nth)).filter(F.col("n") == k)
        kth = kth.select(F.col("query_row").alias("of_query"), F.col("score").alias("least"))
        return queries.join(kth, F.col("at") == F.col("of_query"), "left").drop("of_query")

    def visits(known: DataFrame, some: DataFrame) -> DataFrame:
        asked = told(known).join(some, F.col("width") == F.col("of"))
        worth = F.col("least").isNull() | (F.col("q_norm") * F.col("most") * (1 + 1e-9) >= F.col("least"))
        asked = asked.filter(worth).select("shelf", "at", "query_id", "q", "q_norm", "least")
        return stored(visit(at_rest.select("shelf", "row", "id", "v", "norm"), asked, begin, meet, _FOUND, spread=spread))

    of_sample = stored(queries.mapInArrow(seed, _FOUND))
    number = shelves.count()
    first = F.pmod(F.xxhash64("shelf"), F.lit(max(1, math.isqrt(number)))) == 0
    early = visits(of_sample, shelves.filter(first)).unionByName(of_sample).dropDuplicates(["query_row", "row"])
    late = visits(early, shelves.filter(~first))
    order = W.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").isNull(), "vec_id", "row")
    ranked = early.unionByName(late).dropDuplicates(["query_row", "row"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
