"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by Naive Bayes ratios.

The indicators of a text are its words and word pairs, its byte 4-grams (all hashed), the 5-grams
of its byte classes (space, lower, upper, digit, mark, other), and whether a word follows itself
once, twice or three times.  An indicator j is scaled by r_j = log of its smoothed share in class
1 over that in class 0; a text is scaled to unit length.  A support vector machine is fitted to
these by dual coordinate descent, and its margin is turned into a probability by a logistic curve
fitted on labelled rows held back from it.

A long text is read in windows of about ``window`` bytes, all of them, and is as good as its worst
window, so that a poor passage does not vanish among good ones.  The first fit takes texts whole;
the second takes all windows of class 1, and of class 0 the window that the first finds worst.

The model is fitted on at most ``per_class`` labelled rows of each class (``Params``); scoring
reads every whole text in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, buffers, remainder, with_columns_last

BITS = 17
SLOTS = 1 << BITS
CLASSES = 6
GRAM = 5
SHAPES = CLASSES**GRAM
REPEATS = 3
WIDTH = 3 * SLOTS + SHAPES + REPEATS
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    per_class: int = 2000
    cost: float = 1.0
    epochs: int = 30
    smooth: float = 1.0
    folds: int = 5  # one fold of the sample fits the logistic curve
    window: int = 4096
    block_bytes: int = 1 << 20


def _byte_classes() -> np.ndarray:
    out = np.full(256, 4, np.int64)
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[ord("a") : ord("z") + 1] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    out[128:] = 5
    return out


BYTE_CLASS = _byte_classes()
_BASE = np.uint64(0x100000001B3)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _slot(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return (x >> np.uint64(64 - BITS)).astype(np.int64) + kind * SLOTS


def block_indicators(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct indicator numbers of each text ``data[at[i]:at[i + 1]]``."""
    lo, hi = int(at[0]), int(at[-1])
    b = data[lo:hi]
    at = at - lo
    n = len(b)
    kind = BYTE_CLASS[b]
    wide = b.astype(np.uint64)
    grams = np.zeros(n, np.int64)
    shapes = np.zeros(n, np.int64)
    if n >= 4:
        four = wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16) | wide[3:] << np.uint64(24)
        grams[: n - 3] = _slot(four, 2)
    if n >= GRAM:
        code = np.zeros(n - GRAM + 1, np.int64)
        for k in range(GRAM):
            code = code * CLASSES + kind[k : n - GRAM + 1 + k]
        shapes[: n - GRAM + 1] = code + 3 * SLOTS
    # words; a text boundary always ends a word
    inside = kind > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    border = at[:-1][at[:-1] < n]
    first[border] = inside[border]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = at[1:][(at[1:] > 0)] - 1
    last[ends_at] |= inside[ends_at]
    ends = np.flatnonzero(last) + 1
    up, down = _powers(n)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((wide + np.uint64(1)) * up, dtype=np.uint64)])
    words = (run[ends] - run[starts]) * down[starts] if len(starts) else np.zeros(0, np.uint64)
    one = _slot(words, 0)
    two = _slot(words[:-1] * np.uint64(3) + words[1:] * _MIX, 1) if len(words) > 1 else np.zeros(0, np.int64)
    same = words[:-1] == words[1:]
    place = np.searchsorted(starts, at)
    seen = np.empty(WIDTH, np.int64)
    for i in range(len(at) - 1):
        s, e, ws, we = at[i], at[i + 1], place[i], place[i + 1]
        again = same[ws : max(ws, we - 1)]
        runs = [again, again[1:] & again[:-1], again[2:] & again[1:-1] & again[:-2]]
        found = np.concatenate([
            grams[s : max(s, e - 3)], shapes[s : max(s, e - GRAM + 1)], one[ws:we], two[ws : max(ws, we - 1)],
            np.array([3 * SLOTS + SHAPES + k for k in range(REPEATS) if runs[k].any()], np.int64),
        ])
        order = np.arange(len(found))
        seen[found] = order
        yield found[seen[found] == order]


def window_cuts(data: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the windows of all texts, and the text of each window.

    Texts above 1.5 windows are cut at the first white space behind each multiple of ``window``.
    """
    white = None
    cuts, owner = [], []
    for i in range(len(at) - 1):
        s, e = int(at[i]), int(at[i + 1])
        here = np.array([s])
        if e - s > 1.5 * window:
            if white is None:
                lo = int(at[0])
                white = np.flatnonzero(BYTE_CLASS[data[lo : int(at[-1])]] == 0) + lo
            wanted = np.arange(s + window, e - window // 2, window)
            place = np.searchsorted(white, wanted)
            behind = white[place[place < len(white)]]
            here = np.unique(np.append(here, behind[behind < e]))
        cuts.append(here)
        owner.append(np.full(len(here), i))
    if not cuts:
        return at[:1], np.zeros(0, np.int64)
    return np.append(np.concatenate(cuts), at[-1]), np.concatenate(owner)


def indicators(batch: pa.RecordBatch, params: Params) -> Iterator[tuple[int, np.ndarray]]:
    """(row, indicators) of each window of each text; every row has at least one."""
    data, at = buffers(batch)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + params.block_bytes, "right")) - 1)
        cuts, owner = window_cuts(data, at[i : j + 1], params.window)
        w = 0
        while w < len(owner):  # a single text may exceed the block
            v = max(w + 1, int(np.searchsorted(cuts, cuts[w] + params.block_bytes, "right")) - 1)
            yield from zip((owner[w:v] + i).tolist(), block_indicators(data, cuts[w : v + 1]))
            w = v
        i = j


def dual_coordinate_descent(rows, y, cost, epochs, seed=0) -> np.ndarray:
    """Weights of the L1-loss support vector machine; ``rows``: (indices, values); one slot for the bias.

    ``cost`` may differ by row.  Stops early once no dual variable violates its condition by 0.001.
    """
    w = np.zeros(WIDTH + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            g = y[i] * float(w[at] @ value) - 1.0
            projected = min(g, 0.0) if alpha[i] <= 0 else max(g, 0.0) if alpha[i] >= cost[i] else g
            worst = max(worst, abs(projected))
            if projected and norm[i]:
                new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
                w[at] += (new - alpha[i]) * y[i] * value
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


def fit_logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic curve, by Newton steps on smoothed targets."""
    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - target)) + 1e-6 * beta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta = beta - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


@dataclass
class Model:
    """``scaled`` holds weight times ratio of each indicator, ``square`` the squared ratio."""

    scaled: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        length = float(self.square[found].sum()) ** 0.5
        return (float(self.scaled[found].sum()) / length if length > 0 else 0.0) + self.bias

    def probability(self, margins) -> np.ndarray:
        z = self.slope * np.asarray(margins, float) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


    def document(self, windows: list[np.ndarray]) -> float:
        return min(self.margin(w) for w in windows)


def _fit_weights(rows: list[np.ndarray], y: np.ndarray, params: Params) -> Model:
    count = [np.full(WIDTH, params.smooth), np.full(WIDTH, params.smooth)]
    for found, c in zip(rows, y):
        count[c][found] += 1
    r = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    data = []
    for found in rows:
        value = r[found]
        length = float(value @ value) ** 0.5 or 1.0
        data.append((np.append(found, WIDTH).astype(np.int32), np.append(value / length, 1.0).astype(np.float32)))
    per = {c: len(y) / (2 * max(1, int((y == c).sum()))) for c in (0, 1)}
    cost = np.array([params.cost * per[int(c)] for c in y])
    w = dual_coordinate_descent(data, np.where(y == 1, 1.0, -1.0), cost, params.epochs)
    return Model(w[:-1] * r, r * r, float(w[-1]), 1.0, 0.0)


def train(found: list[list[np.ndarray]], y: np.ndarray, totals: dict[int, int], fold: np.ndarray, params: Params) -> Model:
    """A model of labelled texts (the indicators of their windows); one class alone gives its constant share."""
    zero = np.zeros(WIDTH)
    if len(set(y.tolist())) < 2:
        share = 0.5 if not len(y) else (totals[int(y[0])] + 1) / (totals[int(y[0])] + 2)
        share = share if not len(y) or y[0] == 1 else 1 - share
        return Model(zero, zero, 0.0, 1.0, float(np.log(share / (1 - share))))
    fit = np.flatnonzero(fold != 0)
    if len(set(y[fit].tolist())) < 2 or len(set(y[fold == 0].tolist())) < 2:
        fit, fold = np.arange(len(y)), np.zeros(len(y), int)  # too few rows to hold any back
    model = _fit_weights([np.unique(np.concatenate(found[i])) for i in fit], y[fit], params)
    if any(len(found[i]) > 1 for i in fit):
        rows, sign = [], []
        for i in fit:
            own = found[i] if y[i] == 1 else [min(found[i], key=model.margin)]
            rows += own
            sign += [y[i]] * len(own)
        model = _fit_weights(rows, np.array(sign), params)
    back = np.flatnonzero(fold == 0)
    margins = np.array([model.document(found[i]) for i in back])
    weight = np.array([totals[int(c)] / max(1, int((y[back] == c).sum())) for c in y[back]])
    model.slope, model.offset = fit_logistic(margins, y[back], weight * len(back) / weight.sum())
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1,
        params: Params = Params()) -> Model:  # noqa: B008
    """Fits on labelled rows whose crc32(doc_id as text) mod ``folds`` is not ``held_out``.

    The fit runs in one task over a sample of at most ``2 * params.per_class`` texts.
    """
    allowed = labels.filter(remainder("doc_id", folds) != held_out)
    sample = bounded_sample(allowed, label, params.per_class)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    chosen = chosen.select("text", "y", "n", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(params.folds)).alias("fold"))
    schema = "scaled binary, square binary, bias double, slope double, offset double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, y, fold, totals = [], [], [], {0: 0, 1: 0}
        for b in batches:
            own: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
            for i, f in indicators(b, params):
                own[i].append(f.astype(np.int32))
            found += own
            y += b.column(1).to_pylist()
            fold += b.column(3).to_pylist()
            totals |= dict(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
        m = train(found, np.array(y, int), totals, np.array(fold, int), params)
        yield pa.RecordBatch.from_pylist([{
            "scaled": m.scaled.astype(np.float32).tobytes(), "square": m.square.astype(np.float32).tobytes(),
            "bias": m.bias, "slope": m.slope, "offset": m.offset,
        }])

    got = chosen.repartition(1).mapInArrow(run, schema).collect()
    if not got:
        return train([], np.zeros(0, int), {0: 0, 1: 0}, np.zeros(0, int), params)
    r = got[0]
    return Model(np.frombuffer(r.scaled, np.float32), np.frombuffer(r.square, np.float32), r.bias, r.slope, r.offset)


def score(docs: DataFrame, model: Model, params: Params = Params(),  # noqa: B008
          names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with a score (0 to 1, higher: label 1 likelier) and a prediction (1 from 0.5 on).

    Only ``text`` is read for it; null and empty texts get the score of the bias alone.  Columns of
    the same names are replaced; repeated rows stay; an empty table gives an empty one.
    """
    kept = docs.select(*with_columns_last(docs, *names))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            worst = np.full(b.num_rows, np.inf)
            for i, f in indicators(b, params):
                worst[i] = min(worst[i], m.margin(f))
            p = m.probability(worst)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                names=[*b.schema.names, *names],
            )

    return kept.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """doc_id, held_out, score, predicted for every row of ``docs``; a null doc_id is not held out."""
    model = fit(docs, labels, params=params)
    scored = score(docs.select("doc_id", "text"), model, params)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """The documents predicted to be of quality, with their own columns."""
    scored = score(docs, fit(docs, labels, params=params), params, ("_quality_score", "_quality_kept"))
    return scored.filter("_quality_kept = 1").select(*[scored[c] for c in docs.columns])
