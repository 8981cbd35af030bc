"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Labelled rows are split by hash into three parts.  The first gives the lexicon: words and word
beginnings that are far more frequent (by documents) in toxic texts.  The second fits the trees, the
third the isotonic curve that turns their margin into a probability; so neither the trees nor the
curve see features that were chosen on their own rows.  The parts hold at most ``per_class`` rows
of each class together (``Params``); scoring reads every whole text in one pass, without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, pieces, remainder, texts, with_columns_last

#: Second-person words (fixed values).
SECOND_PERSON = frozenset(
    w.encode() for w in (
        "you", "your", "yours", "yourself", "u", "ur",
        "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie",
        "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos",
        "tú", "usted", "ustedes", "vosotros", "ti", "tus",
    )
)
#: Signs that stand for letters in disguised words (fixed values).
DISGUISE = bytes.maketrans(b"013457@$!|+", b"oieastasilt")
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NEAR = 4
BEGINNINGS = (4, 5, 6)
FEATURES = (
    "hits_log", "hit_density", "weight_density", "strongest", "second_strongest", "near_second_person",
    "second_person_rate", "capital_rate", "capital_words", "exclamation_rate", "mark_rate", "obfuscated_rate",
    "obfuscated_hits", "words_log",
)


@dataclass(frozen=True)
class Params:
    per_class: int = 6000
    lexicon_size: int = 1024
    least_documents: int = 3
    least_log_odds: float = 1.5
    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    cache_words: int = 200_000


# ---------------------------------------------------------------------------
# lexicon
# ---------------------------------------------------------------------------


def bare(word: bytes) -> bytes:
    """Lower-case word without marks at its ends."""
    return word.lower().strip(MARKS)


def disguised(word: bytes) -> bytes | None:
    """What a word with signs among its letters stands for, else None."""
    core = word.strip(b".,;:?\"'()[]{}")
    inner = core[1:] if core[-1:].isalpha() else core[1:].rstrip(b"!?.")
    if not core or core.isalpha() or not any(c in b"013457@$!|+*.-_" for c in inner):
        return None
    plain = core.translate(DISGUISE, b"*.-_").lower()
    letters = sum(c >= 97 for c in core.lower())
    return plain if letters >= 2 and plain.isalpha() and len(plain) >= 3 else None


def units(word: bytes) -> list[bytes]:
    """Lexicon units of a bare word: the word, and its beginnings marked by ^ (in characters)."""
    out = [word] if len(word) > 1 else []
    text = word.decode("utf-8", "ignore")
    return out + [b"^" + text[:n].encode() for n in BEGINNINGS if len(text) >= n]


def _count_units(rows: Iterable[tuple[bytes, int]]) -> Counter:
    count: Counter = Counter()
    for text, y in rows:
        seen: set[bytes] = set()
        for part in pieces(text):
            seen.update(bare(w) for w in set(part.split()))
        count.update((u, y) for u in {u for w in seen for u in units(w)})
    return count


def learn_lexicon(sample: DataFrame, params: Params) -> dict[bytes, float]:
    """Unit to log odds; at most ``lexicon_size`` units.  ``sample``: text, y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count = _count_units(zip(texts(b), b.column(1).to_pylist()))
            yield pa.RecordBatch.from_pydict({
                "unit": pa.array([u for u, _ in count], pa.binary()), "y": pa.array([y for _, y in count], pa.int32()),
                "docs": pa.array(list(count.values()), pa.int64()),
            })

    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return {}
    count = sample.select("text", "y").mapInArrow(run, "unit binary, y int, docs bigint")
    by_class = [F.sum(F.when(F.col("y") == y, F.col("docs")).otherwise(0)) for y in (0, 1)]
    share = [(F.col(f"n{y}") + 0.5) / F.lit(sizes[y] + 1.0) for y in (0, 1)]
    odds = F.log(share[1] / share[0])
    best = (
        count.groupBy("unit").agg(by_class[0].alias("n0"), by_class[1].alias("n1"))
        .filter(F.col("n1") >= params.least_documents)
        .withColumn("odds", odds).filter(F.col("odds") >= params.least_log_odds)
        .orderBy(F.desc(F.col("odds") * F.sqrt("n1")), "unit").limit(params.lexicon_size)
    )
    return {bytes(r.unit): r.odds for r in best.collect()}


# ---------------------------------------------------------------------------
# features
# ---------------------------------------------------------------------------


class Words(dict):
    """Word as written to (log odds, flags); filled on demand and emptied when it grows too large.

    Flags: 1 second person, 2 disguised, 4 written in capitals.
    """

    def __init__(self, lexicon: dict[bytes, float], most: int):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, word: bytes) -> float:
        """Log odds plus 1000 times the flags, as one number."""
        if len(self) >= self.most:
            self.clear()
        plain = bare(word)
        odds = max((self.lexicon.get(u, 0.0) for u in units(plain)), default=0.0)
        flags = (plain in SECOND_PERSON) + 4 * (len(word) > 2 and word.isupper())
        meant = disguised(word)
        if meant is not None:
            flags += 2
            odds = max(odds, max((self.lexicon.get(u, 0.0) for u in units(meant)), default=0.0))
        self[word] = value = odds + 1000.0 * flags
        return value


def features(text: bytes, words: Words) -> np.ndarray:
    """The dense features of a whole text, in the order of FEATURES."""
    n = hits = person = near = caps = shouted = obfuscated = obfuscated_hits = 0
    weight = first = second = 0.0
    for part in pieces(text):
        tokens = part.split()
        if not tokens:
            continue
        value = np.fromiter(map(words.__getitem__, tokens), np.float64, len(tokens))
        n += len(tokens)
        odd = np.flatnonzero(value)
        flags = (value[odd] // 1000).astype(np.int64)
        odds = value[odd] - 1000.0 * flags
        at = odd[odds > 0]
        odds_at = odds[odds > 0]
        you = odd[flags & 1 > 0]
        hits += len(at)
        weight += float(odds_at.sum())
        if len(odds_at):
            top = np.sort(odds_at)[-2:]
            first, second = sorted([first, second, *top.tolist()])[: -3 : -1]
        person += len(you)
        if len(at) and len(you):
            place = np.searchsorted(you, at)
            left = np.abs(at - you[np.maximum(place - 1, 0)])
            right = np.abs(you[np.minimum(place, len(you) - 1)] - at)
            near += int((np.minimum(left, right) <= NEAR).sum())
        obfuscated += int((flags & 2 > 0).sum())
        obfuscated_hits += int(((flags & 2 > 0) & (odds > 0)).sum())
        shouted += int((flags & 4 > 0).sum())
    size = max(1, len(text))
    for part in pieces(text):
        caps += len(part) - len(part.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(text) - len(text.translate(None, MARKS))
    d = max(1, n)
    return np.array([
        np.log1p(hits), hits / d, weight / d, first, second, near, person / d, caps / size, shouted / d,
        text.count(b"!") / size, marks / size, obfuscated / d, obfuscated_hits, np.log1p(n),
    ])


# ---------------------------------------------------------------------------
# trees and calibration
# ---------------------------------------------------------------------------


@dataclass
class Trees:
    """Level-order trees: feature and cut of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, params: Params) -> Trees:
    """Second-order boosting of the weighted logistic loss on binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, params.bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    inner = (1 << params.depth) - 1
    share = float(weight[y == 1].sum() / weight.sum())
    base = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    margin = np.full(len(x), base)
    out_feature, out_cut, out_leaf = [], [], []
    for _ in range(params.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-9)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(params.depth):
            first, many = (1 << level) - 1, 1 << level
            best = np.zeros(many)
            for j, edge in enumerate(edges):
                if not len(edge):
                    continue
                cell = (node - first) * (params.bins + 1) + binned[:, j]
                sums = [np.bincount(cell, v, many * (params.bins + 1)).reshape(many, -1) for v in (g, h)]
                left_g, left_h = (np.cumsum(s, 1)[:, : len(edge)] for s in sums)
                all_g, all_h = (s.sum(1, keepdims=True) for s in sums)
                gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
                at = gain.argmax(1)
                top = gain[np.arange(many), at]
                for k in np.flatnonzero(top > best + 1e-9):
                    best[k], feature[first + k], cut[first + k] = top[k], j, edge[at[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        leaves = node - inner
        leaf = -params.rate * np.bincount(leaves, g, inner + 1) / (np.bincount(leaves, h, inner + 1) + 1)
        margin += leaf[leaves]
        out_feature.append(feature)
        out_cut.append(cut)
        out_leaf.append(leaf)
    return Trees(base, np.array(out_feature), np.array(out_cut), np.array(out_leaf))


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins and non-decreasing probabilities of the pooled blocks (one pseudo row per block and class)."""
    level, place = np.unique(margin, return_inverse=True)
    mass, hit = np.bincount(place, weight), np.bincount(place, weight * y)
    blocks: list[list[float]] = []  # weight, weighted sum, first and last margin
    for m, w, t in zip(level, mass, hit):
        blocks.append([w, t, m, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    at = np.array([v for b in blocks for v in (b[2], b[3])])
    value = np.array([v for b in blocks for v in [(b[1] + 0.01) / (b[0] + 0.02)] * 2])
    return at, np.maximum.accumulate(value)


@dataclass
class Model:
    lexicon: dict[bytes, float]
    trees: Trees | None
    at: np.ndarray
    value: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; the margin itself breaks ties within a flat piece of the curve, by 0.001 at most."""
        if self.trees is None:
            return np.full(len(x), float(self.value[0]))
        margin = self.trees.margin(x)
        p = np.interp(margin, self.at, self.value)
        return np.clip(p + 0.0005 * np.tanh(margin / 10), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0,
        params: Params = Params()) -> Model:  # noqa: B008
    """Fits on labelled rows whose crc32(doc_id as text) mod ``folds`` is not ``held_out``.

    With labels of one class only (or none) the score is the constant share of that class.
    """
    allowed = labels.filter(remainder("doc_id", folds) != held_out)
    sample = bounded_sample(allowed, label, params.per_class).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10)).cast("int")
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    lexicon = learn_lexicon(chosen.filter("part < 5").select("text", "y"), params)
    rows = with_features(chosen.filter("part >= 5").select("text", "y", "n", "part"), lexicon, params).toPandas()
    y = rows.y.to_numpy(int)
    fitting, rest = (rows.part < 8).to_numpy(), (rows.part >= 8).to_numpy()
    if len(set(y[fitting])) < 2 or len(set(y[rest])) < 2:
        counts = {r.y: r.n for r in sample.groupBy("y").agg(F.max("n").alias("n")).collect()}
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return Model(lexicon, None, np.zeros(1), np.array([share]))
    x = np.array(rows.x.tolist())
    weight = np.zeros(len(rows))
    for part in (fitting, rest):
        for c in (0, 1):
            own = part & (y == c)
            weight[own] = rows.n.to_numpy(float)[own] / own.sum()
        weight[part] *= part.sum() / weight[part].sum()
    trees = boost(x[fitting], y[fitting], weight[fitting], params)
    return Model(lexicon, trees, *isotonic(trees.margin(x[rest]), y[rest], weight[rest]))


def with_features(rows: DataFrame, lexicon: dict[bytes, float], params: Params) -> DataFrame:
    """The columns but ``text``, and ``x``: the features."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    rest = [c for c in rows.columns if c != "text"]
    schema = T.StructType([*[rows.schema[c] for c in rest], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value, params.cache_words)
        for b in batches:
            x = [features(t, words) for t in texts(b)]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in rest], pa.array(x, pa.list_(pa.float64()))], names=[*rest, "x"]
            )

    return rows.select("text", *rest).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, params: Params = Params(),  # noqa: B008
          names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with a score (0 to 1, higher: label 1 likelier) and a prediction (1 from 0.5 on).

    Only ``text`` is read for it; null and empty texts are scored as texts without words.  Columns
    of the same names are replaced; repeated rows stay; an empty table gives an empty one.
    """
    kept = docs.select(*with_columns_last(docs, *names))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = Words(m.lexicon, params.cache_words)
        for b in batches:
            x = np.array([features(t, words) for t in texts(b)]).reshape(b.num_rows, len(FEATURES))
            p = m.probability(x)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                names=[*b.schema.names, *names],
            )

    return kept.mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """doc_id, held_out, score, predicted for every row of ``docs``; a null doc_id counts as the id ''."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, params=params), params)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """The documents not predicted to be toxic, with their own columns."""
    scored = score(docs, fit(docs, labels, params=params), params, ("_toxic_score", "_toxic"))
    return scored.filter("_toxic = 0").select(*[scored[c] for c in docs.columns])
