"""Hard negatives by shared lists of anchor clusters, walked until no better row can follow.

Anchors are clustered by angle.  For a cluster whose members lie within an angle w of its centre, the
inner product of a member a with a row x is at most |a| |x| cos(max(0, angle(x, centre) - w)).  On
each shelf the rows are sorted by this bound once per cluster; every member walks the same list
and stops when the bound falls below the k-th score that it has.  Shelves hold rows of one cell
(those nearest to one centre), so the same bound tells which shelves a member need not visit.

One walk finds an anchor's positives, another its negatives in the score band of each positive.  A
first visit to one shelf of the anchor's own cell gives a certified least score, so that the other
shelves send back only what can still be among the best.  Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window as W

from .common import by_hash, stored
from .shelves import SHELF_ROWS, matrix, missing, numbers, shelved, spread_over, visit

LOWEST = -(1 << 63)
HIGHEST = (1 << 63) - 1
MEMBERS = 256


@dataclass(frozen=True)
class Params:
    scale: float = 256.0
    positives: int = 5
    negatives: int = 3
    low: int = 50  # percent of the positive's score
    high: int = 95
    sample_rows: int = 8192
    members: int = 64  # anchors to a cluster, on the average of the sample
    clusters: int = 512
    rounds: int = 8
    shelf_rows: int = SHELF_ROWS
    seed: int = 3


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of whole numbers, exact; beyond 64 bits the end of the range."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    width, limit = x.shape[1], 2.0**53
    a, b = np.abs(x).max(axis=1), np.abs(y).max(axis=1)
    if a.max() * b.max() * width < limit:
        return (x @ y.T).astype(np.int64)
    out = np.empty((len(x), len(y)), np.int64)
    whole = lambda rows: np.array([[int(c) for c in r] for r in rows], object)
    small = b * a.max() * width < limit
    if small.any():
        out[:, small] = (x @ y[small].T).astype(np.int64)
    at = np.flatnonzero(~small)
    out[:, at] = np.clip(whole(x).dot(whole(y[at]).T), LOWEST, HIGHEST).astype(np.int64)
    return out


def lengths(v: np.ndarray) -> np.ndarray:
    most = np.maximum(np.abs(v).max(axis=1, initial=0), 1e-300)
    return most * np.sqrt(((v / most[:, None]) ** 2).sum(axis=1))


def angles(v: np.ndarray, norm: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Row by centre; a zero vector is at a right angle to all."""
    return np.arccos(np.clip((v / np.maximum(norm, 1e-300)[:, None]) @ centres.T, -1.0, 1.0))


def centres_of(sample: np.ndarray, params: Params) -> np.ndarray:
    """Unit centres of the directions in ``sample``; their number grows with it up to ``clusters``."""
    norm = lengths(sample)
    v = sample[norm > 0] / norm[norm > 0, None]
    v = np.unique(v, axis=0)
    if not len(v):
        return np.eye(1, sample.shape[1])
    rng = np.random.default_rng(params.seed)
    centres = v[rng.permutation(len(v))[: max(1, min(params.clusters, len(v) // params.members))]]
    for _ in range(params.rounds):
        nearest = (v @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, v)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return centres


@dataclass
class Shelf:
    v: np.ndarray
    norm: np.ndarray
    label: np.ndarray
    row: np.ndarray
    id: np.ndarray
    none: np.ndarray
    cluster: int | None = None
    order: np.ndarray | None = None
    bound: np.ndarray | None = None

    def listed(self, cluster: int, centre: np.ndarray, within: float) -> None:
        """The list that all members of ``cluster`` walk; made when the first of them comes."""
        if self.cluster == cluster:
            return
        gap = np.maximum(0.0, angles(self.v, self.norm, centre[None])[:, 0] - within - 1e-7)
        bound = self.norm * np.cos(gap)
        self.order = np.argsort(-bound, kind="stable")
        self.bound = bound[self.order]
        self.cluster = cluster

    def walk(self, v, norm, label, row, least, most, same: bool, k: int, step: int = 512):
        """(member, position, score): for each member the k best rows of its list within [least, most], and ties.

        A member stops where |a| times the bound is below the least score that it still wants.
        """
        least, found, at = least.copy(), [], 0
        live = np.arange(len(v))
        while at < len(self.order):
            reach = norm[live] * self.bound[at]
            live = live[reach + 1e-6 * np.abs(reach) + 1e-3 >= least[live]]
            if not len(live):
                break
            rows = self.order[at : at + step]
            score = product(v[live], self.v[rows])
            ok = (self.label[rows][None, :] == label[live][:, None]) == same
            ok &= self.row[rows][None, :] != row[live][:, None]
            ok &= (score <= most[live][:, None]) & (score >= least[live][:, None])
            if len(rows) >= k:
                held = np.where(ok, score, LOWEST)
                kth = np.partition(held, len(rows) - k, axis=1)[:, len(rows) - k]
                least[live] = np.maximum(least[live], kth)
            i, j = np.nonzero(ok & (score >= least[live][:, None]))
            found.append((live[i], rows[j], score[i, j]))
            at += len(rows)
            step = min(2 * step, 4096)
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        i, j, score = map(np.concatenate, zip(*found))
        order = np.lexsort((self.row[j], self.id[j], self.none[j], -score, i))
        s = i[order]
        top = order[np.arange(len(s)) - np.searchsorted(s, s) < k]
        return i[top], j[top], score[top]


def usable(vectors: DataFrame, scale: float) -> DataFrame:
    """id, label (bigint), v (whole doubles floor(scale * x)), width, row of the rows that take part."""
    known = F.col("label").isNotNull() & F.col("embedding").isNotNull()
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    kind = vectors.schema["label"].dataType
    label = F.col("label").cast("bigint") if isinstance(kind, IntegralType) else F.xxhash64(F.col("label").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2)
            flat = np.floor(scale * x.flatten().to_numpy(zero_copy_only=False))
            flat = np.clip(flat, -1.7e308, 1.7e308)
            v = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), v], names=["id", "label", "v"])

    rows = vectors.filter(known & whole & (F.size("embedding") > 0)).select(
        F.col("vec_id").alias("id"), label.alias("label"), F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    return rows.mapInArrow(run, "id bigint, label bigint, v array<double>").withColumn("row", F.monotonically_increasing_id())


def _window(of: list[str], order: list) -> Column:
    return F.row_number().over(W.partitionBy(*of).orderBy(*order))


def hard_negatives(vectors: DataFrame, is_anchor: Column, params: Params = Params()) -> DataFrame:  # noqa: B008
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id (bigint), embedding (array) and label; ``is_anchor`` is a condition on
    vec_id.  Components become floor(scale * x); a score is the integer inner product (held at the
    ends of 64 bits), higher first, ties to the smaller id, null ids last.  An anchor's positives are
    its best other rows of the same label; for each of them the best rows of another label come back
    whose score is between ``low`` and ``high`` percent of the positive's, ``rank`` from 1.  Rows with
    a null label, a null or empty vector, or null or non-finite components take no part; a repeated
    row is another row; vectors of different length never meet; labels that are not whole numbers
    are compared by a 64-bit hash.  Other columns are not read; an empty table gives an empty one.
    """
    rows = stored(usable(vectors, params.scale))
    spark = rows.sparkSession
    anchors = rows.withColumnRenamed("id", "vec_id").filter(is_anchor).withColumnRenamed("vec_id", "id")
    count = anchors.count()
    sample = by_hash(anchors.select("id", "v"), params.sample_rows, count, "id", "v")
    sample = sample.orderBy(F.xxhash64("id", "v"), "id").limit(params.sample_rows).collect()
    widths: dict[int, list] = {}
    for r in sample:
        widths.setdefault(len(r.v), []).append(r.v)
    centres = {w: centres_of(np.array(v), params) for w, v in widths.items()}

    def centre(width: int) -> np.ndarray:
        return centres[width] if width in centres else np.eye(1, width)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(b.schema.get_field_index("v")).value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(sizes):
                part = b.filter(pa.array(sizes == width))
                v = matrix(part, "v")
                norm = lengths(v)
                angle = angles(v, norm, centre(int(width)))
                cell = angle.argmin(axis=1)
                more = [pa.array(np.full(len(v), width, np.int32)), pa.array(norm), pa.array(cell.astype(np.int32)),
                        pa.array(angle[np.arange(len(v)), cell])]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "width", "norm", "cell", "angle"])

    placed = stored(rows.mapInArrow(
        place, "id bigint, label bigint, v array<double>, row bigint, width int, norm double, cell int, angle double"))
    salt = F.xxhash64("id", "row")
    at_rest = stored(shelved(placed, ["width", "cell"], salt, params.shelf_rows).withColumnRenamed("norm", "x_norm"))
    shelves = at_rest.groupBy("shelf", "width", "cell").agg(F.max("x_norm").alias("most"), F.max("angle").alias("radius"))
    number = F.count("*").over(W.partitionBy("width", "cell"))
    nth = F.row_number().over(W.partitionBy("width", "cell").orderBy("shelf"))
    shelves = stored(shelves.withColumns({"nth": nth, "parts": number}).withColumnsRenamed({"width": "s_width", "cell": "s_cell"}))
    # centres to centres: at most clusters^2 numbers per width
    between = pd.DataFrame(
        [(w, a, b, float(x)) for w, c in centres.items() for a, r in enumerate(angles(c, np.ones(len(c)), c)) for b, x in enumerate(r)],
        columns=["c_width", "c_cell", "s_cell", "between"]).astype({"c_width": "int32", "c_cell": "int32", "s_cell": "int32"})
    between = spark.createDataFrame(between, "c_width int, c_cell int, s_cell int, between double")
    route = ["shelf", "c_width", "c_cell", "most", "radius", "between"]
    known = shelves.join(between.withColumnRenamed("s_cell", "b_cell"), (F.col("s_width") == F.col("c_width")) & (F.col("s_cell") == F.col("b_cell")))
    # a width that the sample has no anchor of is one cell
    alone = shelves.filter(~F.col("s_width").isin(list(centres))).withColumns(
        {"c_width": F.col("s_width"), "c_cell": F.col("s_cell"), "between": F.lit(0.0)})
    routes = stored(known.select(*route).unionByName(alone.select(*route)))

    asking = placed.withColumnRenamed("id", "vec_id").filter(is_anchor).withColumnRenamed("vec_id", "id").filter(F.col("id").isNotNull())
    asking = asking.select(
        F.col("row").alias("at"), F.col("id").alias("anchor_id"), F.col("label").alias("own"), F.col("v").alias("a"),
        "norm", "width", "cell", "angle")
    spans = asking.groupBy("width", "cell").agg(F.max("angle").alias("span"))
    spans = stored(spans.withColumnsRenamed({"width": "w_width", "cell": "w_cell"}))
    asking = stored(asking.join(spans, (F.col("width") == F.col("w_width")) & (F.col("cell") == F.col("w_cell"))).drop("w_width", "w_cell"))

    def begin(table: pa.Table) -> Shelf:
        return Shelf(matrix(table, "v"), numbers(table, "x_norm"), numbers(table, "label"), numbers(table, "row"),
                     numbers(table, "id"), missing(table, "id"))

    def walker(same: bool, k: int):
        low, high = params.low, params.high

        def meet(shelf: Shelf, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            cells = numbers(part, "cell")
            edges = np.flatnonzero(np.diff(cells)) + 1
            for a, z in zip([0, *edges], [*edges, len(cells)]):
                for at in range(a, z, MEMBERS):
                    some = part.slice(at, min(MEMBERS, z - at))
                    v = matrix(some, "a")
                    shelf.listed(int(cells[at]), centre(v.shape[1])[cells[at]], float(numbers(some, "span")[0]))
                    least = numbers(some, "least", LOWEST)
                    most = np.full(len(v), HIGHEST)
                    if not same:
                        score = numbers(some, "score")
                        rest = score % 100
                        least = np.maximum(least, (score // 100) * low - (-rest * low // 100))
                        most = (score // 100) * high + rest * high // 100
                    i, j, found = shelf.walk(v, numbers(some, "norm"), numbers(some, "own"), numbers(some, "at"), least, most, same, k)
                    take = pa.array(i)
                    cols = [some.column(some.schema.get_field_index(c)).take(take) for c in ("at", "score")]
                    yield pa.RecordBatch.from_arrays(
                        [*cols, pa.array(shelf.row[j]), pa.array(shelf.id[j], mask=shelf.none[j]), pa.array(found)],
                        names=["at", "score", "row", "id", "found"])

        return meet

    def walk(asked: DataFrame, same: bool, k: int) -> DataFrame:
        """at, score, row, id, found, rank: the k best of each (at, score) asked for."""
        meet, of = walker(same, k), ["at", "score"]
        spread = spread_over(asked.count())
        best = _window(of, [F.desc("found"), F.col("id").isNull(), "id", "row"])
        asked = asked.withColumn("least", F.lit(None).cast("bigint"))
        columns = ["shelf", "at", "own", "a", "norm", "cell", "span", "score", "least"]
        rest = at_rest.select("shelf", "v", "x_norm", "label", "row", "id")
        schema = "at bigint, score bigint, row bigint, id bigint, found bigint"
        home = asked.join(shelves, (F.col("width") == F.col("s_width")) & (F.col("cell") == F.col("s_cell")))
        home = home.filter(F.col("nth") == F.pmod(F.xxhash64("at"), F.col("parts")) + 1).select(*columns)
        first = visit(rest, home, begin, meet, schema, ["cell"], spread)
        kth = stored(first.withColumn("rank", best).filter(F.col("rank") == k).select(
            F.col("at").alias("k_at"), F.col("score").alias("k_score"), F.col("found").alias("k_least")))
        told = asked.join(kth, (F.col("at") == F.col("k_at")) & F.col("score").eqNullSafe(F.col("k_score")), "left")
        told = told.withColumn("least", F.col("k_least")).drop("k_at", "k_score", "k_least")
        sent = told.join(routes, (F.col("width") == F.col("c_width")) & (F.col("cell") == F.col("c_cell")))
        gap = F.greatest(F.lit(0.0), F.col("between") - F.col("angle") - F.col("radius") - 1e-7)
        reach = F.col("norm") * F.col("most") * F.cos(gap)
        floor = F.greatest("least", F.col("score") * (params.low / 100)) if not same else F.col("least").cast("double")
        sent = sent.filter(floor.isNull() | (reach + 1e-6 * F.abs(reach) + 1 >= floor)).select(*columns)
        found = visit(rest, sent, begin, meet, schema, ["cell"], spread)
        return stored(found.withColumn("rank", best).filter(F.col("rank") <= k))

    positives = walk(asking.withColumn("score", F.lit(None).cast("bigint")), True, params.positives)
    positives = positives.select("at", F.col("found").alias("score"), F.col("id").alias("positive_id"), F.col("row").alias("p_row"))
    # the band of a positive depends on its score alone; below zero it is empty
    bands = positives.filter("score >= 0").select("at", "score").distinct()
    bands = stored(bands.withColumnRenamed("at", "b_at").join(asking, F.col("b_at") == F.col("at")).drop("b_at"))
    negatives = walk(bands, False, params.negatives)
    found = positives.withColumnsRenamed({"at": "p_at", "score": "p_score"}).join(
        negatives, (F.col("p_at") == F.col("at")) & (F.col("p_score") == F.col("score")))
    names = asking.select(F.col("at").alias("n_at"), "anchor_id")
    return found.join(names, F.col("at") == F.col("n_at")).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
        F.col("score").alias("positive_score"), F.col("found").alias("negative_score"))
