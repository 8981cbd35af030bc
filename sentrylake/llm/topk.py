"""Exact top-k inner products by a three-phase uniform threshold.

A score is a sum of partial scores, one for each block of dimensions.  Vectors are kept in chunks
(matrices of some thousand rows); a task holds one chunk of candidates and one of queries.

1. Every block of every chunk gives its list of the k highest partial scores of each query.  The
   scores of those candidates are completed, and the k-th best of all chunks is a safe cutoff: no
   answer scores less.
2. The cutoff goes back to all chunks with the queries.  A score of at least ``cutoff`` has a
   partial score of at least ``cutoff / blocks`` in some block, so the entries above this uniform
   threshold suffice.
3. Only for those the remaining partial scores are computed; totals below the cutoff go, and the k
   best of each chunk are ranked together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stored

CANDIDATES = 4096
QUERIES = 1024
BLOCKS = 2
LOWEST = -(1 << 62)
HELD = 1 << 61


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """id, v: floor(scale * x) of each component; vectors null or with null or non-finite components are left out."""
    number = lambda x: x.cast("double")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(number(x)) < float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & whole).select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * number(x))).alias("v")
    )


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Chunks of ``rows`` (row, id, v): width, n, rows, ids, values (as 64-bit numbers)."""
    schema = "width int, n int, rows binary, ids binary, none binary, v binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def chunk(width, parts):
            ids = pd.array([i for _, i, _ in parts], dtype="Int64")
            return pa.RecordBatch.from_pylist([{
                "width": width, "n": len(parts), "rows": np.array([r for r, _, _ in parts], np.int64).tobytes(),
                "ids": ids.fillna(0).to_numpy(np.int64).tobytes(), "none": ids.isna().tobytes(),
                "v": np.array([v for _, _, v in parts], np.int64).tobytes(),
            }], schema=pa.schema([("width", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("rows", "ids", "none", "v")]]))

        for b in batches:
            for r, i, v in zip(*[b.column(c).to_pylist() for c in ("row", "id", "v")]):
                parts = held.setdefault(len(v), [])
                parts.append((r, i, v))
                if len(parts) == size:
                    yield chunk(len(v), held.pop(len(v)))
        for width, parts in held.items():
            yield chunk(width, parts)

    return rows.mapInArrow(run, schema)


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in double precision where no sum can leave its integers.

    Those of larger numbers are added up as whole numbers and held at 2^61, so that the
    sum of two parts stays below 64.
    """
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    each = np.abs(x.astype(np.float64)).max(axis=1) * float(np.abs(q.astype(np.float64)).max()) * q.shape[1]
    out = np.empty((len(q), len(x)), np.int64)
    near, some, far = each < 2.0**53, (each >= 2.0**53) & (each < HELD), each >= HELD
    out[:, near] = (q.astype(np.float64) @ x[near].astype(np.float64).T).astype(np.int64)
    out[:, some] = q @ x[some].T
    if far.any():
        out[:, far] = np.clip(q.astype(object) @ x[far].astype(object).T, -HELD, HELD).astype(np.int64)
    return out


def _open(row, side: str) -> dict[str, np.ndarray]:
    n, width = row[f"{side}_n"], row["width"]
    return {
        "rows": np.frombuffer(row[f"{side}_rows"], np.int64), "ids": np.frombuffer(row[f"{side}_ids"], np.int64),
        "none": np.frombuffer(row[f"{side}_none"], bool), "v": np.frombuffer(row[f"{side}_v"], np.int64).reshape(n, width),
    }


def _dims(width: int, blocks: int) -> list[slice]:
    edge = np.linspace(0, width, max(1, min(blocks, width)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edge, edge[1:])]


def _parts(q, x, blocks: int) -> np.ndarray:
    """Partial scores: block, query, candidate; a row's product with itself counts as lowest."""
    out = np.stack([product(q["v"][:, d], x["v"][:, d]) for d in _dims(q["v"].shape[1], blocks)])
    return out


def seeds(q, x, k: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1 in one pair of chunks: (query position, complete score) of the candidates on the local lists."""
    parts = _parts(q, x, blocks)
    own = q["rows"][:, None] == x["rows"][None, :]
    parts[:, own] = LOWEST
    n = parts.shape[2]
    take = min(k, n)
    listed = np.zeros(parts.shape[1:], bool)
    for p in parts:
        at = np.argpartition(p, n - take, axis=1)[:, n - take :]
        np.put_along_axis(listed, at, True, axis=1)
    listed &= ~own
    total = np.where(listed, np.where(own, 0, parts).sum(0), LOWEST)
    keep = np.sort(total, axis=1)[:, ::-1][:, :take]
    i, j = np.nonzero(keep > LOWEST)
    return i, keep[i, j]


def entries(q, x, cutoff: np.ndarray, k: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3 in one pair of chunks: (query position, candidate position, score), k per query at most."""
    dims = _dims(q["v"].shape[1], blocks)
    parts = _parts(q, x, blocks)
    least = -(-cutoff // len(dims))
    above = (parts >= least[None, :, None]).any(0)
    above &= q["rows"][:, None] != x["rows"][None, :]
    i, j = np.nonzero(above)
    score = np.zeros(len(i), np.int64)
    for b in range(len(dims)):
        score += parts[b, i, j]
    good = score >= cutoff[i]
    i, j, score = i[good], j[good], score[good]
    order = np.lexsort((x["rows"][j], x["ids"][j], ~x["none"][j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, i)
    top = np.arange(len(i)) - first < k
    return i[top], j[top], score[top]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, blocks: int = BLOCKS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every query among ``vectors`` (id: bigint, v: array of bigint).

    Candidates are all rows but the query's own (a repeated row is another row), of the same width;
    ties go to the smaller id, null ids first.  With fewer than k candidates all are returned.  No
    queries or no vectors give an empty table.  A partial score (of one of ``blocks`` parts of the
    dimensions) beyond 2^61 is held there, and components beyond 64 bits at the ends of their range.
    """
    numbered = stored(vectors.select("id", "v").withColumn("row", F.monotonically_increasing_id()))
    side = lambda df, s: df.select("width", F.col("chunk").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "rows", "ids", "none", "v")])
    chunk = lambda df, size: stored(_packed(df, size).withColumn("chunk", F.monotonically_increasing_id()))
    x = side(chunk(numbered, CANDIDATES), "x")
    q = side(chunk(numbered.withColumnRenamed("id", "vec_id").filter(is_query).withColumnRenamed("vec_id", "id"), QUERIES), "q")

    def paired(q: DataFrame) -> DataFrame:
        """Every chunk of queries with every chunk of candidates, each pair a key of its own."""
        left = x.join(q.select("width", "q"), "width")
        right = q.join(x.select("width", "x"), "width")
        return left.join(right, ["width", "x", "q"])

    def phase1(frames):
        for pdf in frames:
            for _, row in pdf.iterrows():
                i, s = seeds(_open(row, "q"), _open(row, "x"), k, blocks)
                yield pd.DataFrame({"q": np.full(len(i), row["q"], np.int64), "i": i.astype(np.int64), "score": s})

    def phase2(frames):
        for pdf in frames:
            for _, row in pdf.iterrows():
                a, b = _open(row, "q"), _open(row, "x")
                cutoff = np.full(len(a["rows"]), LOWEST, np.int64)
                if row["at"] is not None:
                    cutoff[np.asarray(row["at"], np.int64)] = np.asarray(row["cutoff"], np.int64)
                i, j, s = entries(a, b, cutoff, k, blocks)
                yield pd.DataFrame({
                    "query_row": a["rows"][i], "query_id": pd.array(a["ids"][i]), "query_none": a["none"][i],
                    "row": b["rows"][j], "vec_id": pd.array(b["ids"][j]), "none": b["none"][j], "score": s,
                })

    best = W.partitionBy("q", "i").orderBy(F.desc("score"))
    listed = paired(q).mapInPandas(phase1, "q bigint, i bigint, score bigint")
    cutoffs = listed.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k).filter(F.col("nth") == k)
    by_chunk = stored(cutoffs.groupBy("q").agg(F.collect_list(F.struct("i", "score")).alias("list"))).select(
        F.col("q").alias("of"), F.col("list.i").alias("at"), F.col("list.score").alias("cutoff")
    )
    told = q.join(by_chunk, q["q"] == by_chunk["of"], "left").drop("of")
    found = paired(told).mapInPandas(
        phase2, "query_row bigint, query_id bigint, query_none boolean, row bigint, vec_id bigint, none boolean, score bigint"
    )
    order = W.partitionBy("query_row").orderBy(F.desc("score"), F.desc("none"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(
        F.when(~F.col("query_none"), F.col("query_id")).alias("query_id"), "rank",
        F.when(~F.col("none"), F.col("vec_id")).alias("vec_id"), "score",
    )
