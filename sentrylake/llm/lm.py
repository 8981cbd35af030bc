"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation.

Counts.  All words of all training documents are counted, in the tasks first, then by word.  The
``head_words`` most frequent (ties by hash) go to every task as a dictionary; the counts of other
words are met by a join on the word, of one row per word and document.

Model.  Two levels, a class and a word within its class.  The ``singles`` most frequent words, the
end of a text, and all words beyond the head are classes of their own; the other head words are cut
by frequency into at most ``blocks`` classes.  The class is predicted from the classes of the two
words before, the word within its class from the two words themselves: context vectors are scaled by
place, summed, and multiplied with the vectors of the targets, plus a bias.  Every head word has its
own context and target vectors.  A word beyond the head has its smoothed unigram share within the
class of such words, so that the words of a text, unseen ones as one further word, have
probabilities that sum to one.

Training.  The documents are turned into numbers once.  A hash of the row deals them to shards of
about ``shard_tokens`` tokens, and the shards to ``rounds`` rounds, whatever the partitions of the
table; each document is learnt from once.  In a round every shard is one task, which runs
noise-contrastive estimation in numpy over the stream of its documents from common parameters.  Then
each vector and its step size are averaged with the number of its uses in a shard as weight (of up
to ``fan`` shards at once; of more in two steps, so that no group grows with the number of shards),
and go to the tasks of the next round.

Scoring.  Log normalisers of all pairs of context classes come from batched matrix products once;
those within a class from one product per class over a batch of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import buffers, pieces, remainder, stored


@dataclass(frozen=True)
class Params:
    singles: int = 510  # classes of one word; and two more: words beyond the head, end
    blocks: int = 512  # classes of several words
    width: int = 16
    word_width: int = 8
    rounds: int = 6
    shard_tokens: int = 1 << 22
    max_shards: int = 16_384
    batch: int = 8192
    noise: int = 32
    word_noise: int = 4
    rate: float = 0.04
    word_rate: float = 0.04
    head_words: int = 100_000
    spill_words: int = 300_000
    block: int = 512  # vectors averaged in one row
    fan: int = 256  # shards averaged in one group
    slice: int = 1 << 17  # tokens scored together


# ---------------------------------------------------------------------------
# counts
# ---------------------------------------------------------------------------


def words_of(batch: pa.RecordBatch, limit: int = 1 << 22) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Lower-case words of the texts in parts of about ``limit`` bytes: the number of the text of each, and the words."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()), b"")
    _, at = buffers(batch)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        whole = at[hi] - at[lo] <= limit
        for part in (column.slice(lo, hi - lo),) if whole else (pa.array([x], pa.large_binary()) for x in pieces(column[lo].as_py(), limit)):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(part.view(pa.large_string())))
            words = lists.flatten().view(pa.large_binary())
            some = pc.greater(pc.binary_length(words), 0)
            yield lo + pc.list_parent_indices(lists).filter(some).to_numpy(), words.filter(some)
        lo = hi


def count_words(texts_only: DataFrame, params: Params) -> DataFrame:
    """word, n over all documents, the end of each text not counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> pa.Table:
            words, n = (pa.chunked_array([x.field(k) for x in held]) for k in (0, 1))
            return pa.table({"word": words, "n": n}).group_by("word").aggregate([("n", "sum")])

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            return iter(pa.table({"word": table["word"].cast(pa.binary()), "n": table["n_sum"]}).to_batches())

        for b in batches:
            for _, words in words_of(b):
                held.append(words.value_counts())
                size += len(held[-1])
                if size > 2 * params.spill_words:
                    table = merged()
                    held, size = [], 0
                    if len(table) > params.spill_words:
                        yield from out(table)
                    else:
                        held = [pa.StructArray.from_arrays([c.combine_chunks() for c in (table["word"], table["n_sum"])], names=["values", "counts"])]
                        size = len(table)
        if held:
            yield from out(merged())

    part = texts_only.select("text").mapInArrow(run, "word binary, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """Word numbers: 0 is every word beyond the head, 1 the end, then the head by count."""

    head: dict[bytes, int]
    numbers: np.ndarray  # count by word number
    starts: np.ndarray  # first word number of each class, and one past the last
    tokens: int  # N
    words: int  # V
    other_mass: float  # smoothed counts of all words beyond the head, the unseen one included

    @property
    def ends(self) -> int:
        return int(self.numbers[1])

    @property
    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1, dtype=np.int32), np.diff(self.starts))

    @property
    def class_counts(self) -> np.ndarray:
        return np.add.reduceat(self.numbers, self.starts[:-1])

    def log_total(self) -> float:
        return float(np.log10(self.tokens + 0.1 * (self.words + 1)))


def head_of(counts: DataFrame, want: int) -> list:
    """The ``want`` most frequent words with their counts (all, if fewer), equal counts by hash of the word."""
    many = counts.groupBy("n").agg(F.count("*").alias("m"))  # one row per distinct count
    reach = many.select("n", "m", F.sum("m").over(W.orderBy(F.desc("n"))).alias("upto"))
    least = reach.filter(F.col("upto") <= want).agg(F.min("n").alias("n"), F.max("upto").alias("upto")).first()
    whole = [] if least.n is None else counts.filter(F.col("n") >= least.n).collect()
    missing = want - len(whole)
    # the next count is shared by more words than there is room for: a share of them by hash
    edge = reach.filter(F.col("upto") > want).orderBy(F.desc("n")).first()
    if edge is None or missing == 0:
        return whole
    place = F.pmod(F.xxhash64("word"), F.lit(1 << 40))
    below = int((1 << 40) * min(1.0, 1.2 * missing / edge.m + 200 / edge.m))
    some = counts.filter((F.col("n") == edge.n) & (place < below)).withColumn("place", place).collect()
    return whole + sorted(some, key=lambda r: (r.place, bytes(r.word)))[:missing]


def gather(counts: DataFrame, documents: int, params: Params) -> Counts:
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    head = sorted(head_of(counts, params.head_words), key=lambda r: (-r.n, bytes(r.word)))
    in_head = sum(r.n for r in head)
    numbers = np.array([int(total.n or 0) - in_head, documents, *[r.n for r in head]], np.int64)
    alone = min(params.singles, len(head))
    size = max(1, -(-(len(head) - alone) // params.blocks))
    starts = np.concatenate([np.arange(2 + alone), np.arange(2 + alone, len(numbers), size), [len(numbers)]])
    words = int(total.v) + (1 if documents else 0)
    mass = numbers[0] + 0.1 * (int(total.v) - len(head) + 1)
    return Counts({bytes(r.word): k + 2 for k, r in enumerate(head)}, numbers, starts, int(total.n or 0) + documents, words, float(mass))


# ---------------------------------------------------------------------------
# model
# ---------------------------------------------------------------------------


@dataclass
class Level:
    """Vectors of one level of the model."""

    context: np.ndarray  # rows x width
    target: np.ndarray
    bias: np.ndarray  # rows x 1
    place: np.ndarray  # 2 x width

    def predicted(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.joined(self.context[before], self.context[last])

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Predicted vectors from the context vectors of both places."""
        return a * self.place[0] + b * self.place[1]

    def copy(self) -> Level:
        return Level(*(getattr(self, v).copy() for v in TABLES))


TABLES = ("context", "target", "bias", "place")


@dataclass
class Model:
    classes: Level
    words: Level
    squares: tuple[dict[str, np.ndarray], dict[str, np.ndarray]]  # of both levels, for further rounds

    def normalisers(self) -> np.ndarray:
        """log sum of exp over all classes, for every pair of context classes (before, last)."""
        c = self.classes
        first = (c.context * c.place[0]) @ c.target.T
        second = (c.context * c.place[1]) @ c.target.T + c.bias[:, 0]
        high, top = first.max(1), second.max(1)
        product = np.exp(first - high[:, None]) @ np.exp(second - top[:, None]).T
        return (np.log(np.maximum(product, 1e-30)) + high[:, None] + top[None, :]).astype(np.float32)


def start(counts: Counts, params: Params) -> Model:
    """Unigram biases and small vectors; within a class exactly the unigram shares."""
    rng = np.random.default_rng(11)
    by_class, n, v = counts.class_counts, len(counts.starts) - 1, len(counts.numbers)

    def small(rows: int, width: int) -> np.ndarray:
        return (rng.normal(size=(rows, width)) * 0.1).astype(np.float32)

    def level(rows: int, width: int, share: np.ndarray, target: np.ndarray) -> Level:
        return Level(small(rows, width), target, np.log(share).astype(np.float32)[:, None], np.ones((2, width), np.float32))

    share = (by_class + 0.1) / (by_class + 0.1).sum()
    classes = level(n, params.width, share, small(n, params.width))
    words = level(v, params.word_width, within(counts), np.zeros((v, params.word_width), np.float32))
    return Model(classes, words, tuple({k: np.ones(len(getattr(x, k)), np.float32) for k in TABLES} for x in (classes, words)))


def within(counts: Counts) -> np.ndarray:
    """Unigram share of each word number within its class."""
    smooth = counts.numbers + 0.1
    return smooth / np.add.reduceat(smooth, counts.starts[:-1])[counts.class_of]


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` by row number."""
    width = values.shape[1]
    at = (rows[:, None] * width + np.arange(width)).ravel()
    return np.bincount(at, values.ravel(), n * width).reshape(n, width)


class Learner:
    """Adagrad on one level, one sum of squares a row, with the number of uses of each row."""

    def __init__(self, level: Level, squares: dict[str, np.ndarray], rate: float):
        self.level, self.rate = level.copy(), rate
        self.squares = {v: x.copy() for v, x in squares.items()}
        self.uses = {v: np.zeros(len(getattr(level, v)), np.float32) for v in TABLES}
        self.spot = np.zeros(len(level.context), np.int64)
        self.mark = np.zeros(len(level.context), bool)

    def step(self, name: str, *parts: tuple[np.ndarray, np.ndarray]) -> None:
        """Move rows of a table up the sum of gradients given as (row numbers, values)."""
        for rows, _ in parts:
            self.mark[rows] = True
        hit = np.flatnonzero(self.mark)
        self.mark[hit] = False
        self.spot[hit] = np.arange(len(hit))
        g = sum(_scatter(self.spot[rows], values, len(hit)) for rows, values in parts).astype(np.float32)
        squares = self.squares[name][hit] + (g * g).mean(1)
        self.squares[name][hit] = squares
        getattr(self.level, name)[hit] += self.rate * g / np.sqrt(squares)[:, None]

    def used(self, name: str, rows: np.ndarray) -> None:
        np.add.at(self.uses[name], rows, np.float32(1))

    def learn(self, before, last, token, a, b, gr) -> None:
        """Update after a batch: ``a`` and ``b`` the context vectors, ``gr`` the gradient of the predicted vectors."""
        own = self.level
        place = np.stack([np.einsum("ij,ij->j", gr, a), np.einsum("ij,ij->j", gr, b)])
        self.step("context", (before, gr * own.place[0]), (last, gr * own.place[1]))
        self.step("place", (np.arange(2), place))
        for name, rows in (("context", before), ("context", last), ("target", token), ("bias", token)):
            self.used(name, rows)
        self.uses["place"] += len(token)


def _odds(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(x, -30, 30)))


def nce(model: Model, stream: Iterator[tuple], counts: Counts, params: Params, seed: int) -> tuple[Learner, Learner]:
    """One pass over (before, last, token) batches of word numbers: the two levels as learnt.

    Data is told from noise by the log odds of the model's unnormalised score against the expected
    noise.  Noise classes are drawn from the class unigrams for a whole batch, noise words from the
    unigrams of the token's class for each token.
    """
    rng = np.random.default_rng(seed)
    by_class, class_of, n = counts.class_counts, counts.class_of, len(counts.starts) - 1
    share = (by_class + 0.1) / (by_class + 0.1).sum()
    log_noise, edges = np.log(params.noise * share).astype(np.float32), np.cumsum(share)
    log_word_noise = np.log(params.word_noise * within(counts)).astype(np.float32)
    smooth = np.concatenate([[0.0], np.cumsum(counts.numbers + 0.1)])
    several = np.diff(counts.starts) > 1
    upper = Learner(model.classes, model.squares[0], params.rate)
    lower = Learner(model.words, model.squares[1], params.word_rate)

    for before, last, token in stream:
        # classes
        a, b, t = class_of[before], class_of[last], class_of[token]
        own = upper.level
        drawn = np.minimum(np.searchsorted(edges, rng.random(params.noise)), n - 1)
        x, y = own.context[a], own.context[b]
        r = own.joined(x, y)
        to, q = own.target[t], own.target[drawn]
        up = _odds(np.einsum("ij,ij->i", r, to) + own.bias[t, 0] - log_noise[t])
        down = -_odds(log_noise[drawn] - own.bias[drawn, 0] - r @ q.T)
        gr = up[:, None] * to + down @ q
        upper.step("target", (t, up[:, None] * r), (drawn, down.T @ r))
        upper.step("bias", (t, up[:, None]), (drawn, down.sum(0)[:, None]))
        upper.learn(a, b, t, x, y, gr)
        # words within classes of several words
        inner = np.flatnonzero(several[t])
        if len(inner):
            before, last, token, t = before[inner], last[inner], token[inner], t[inner]
            own = lower.level
            low, high = smooth[counts.starts[t]], smooth[counts.starts[t + 1]]
            at = low[:, None] + rng.random((len(inner), params.word_noise)) * (high - low)[:, None]
            drawn = np.clip(np.searchsorted(smooth, at, side="right") - 1, counts.starts[t][:, None], counts.starts[t + 1][:, None] - 1)
            x, y = own.context[before], own.context[last]
            r = own.joined(x, y)
            to, q = own.target[token], own.target[drawn]
            up = _odds(np.einsum("ij,ij->i", r, to) + own.bias[token, 0] - log_word_noise[token])
            down = -_odds(log_word_noise[drawn] - own.bias[drawn, 0] - np.einsum("ij,ikj->ik", r, q))
            gr = up[:, None] * to + np.einsum("ik,ikj->ij", down, q)
            noise = drawn.ravel()
            lower.step("target", (token, up[:, None] * r), (noise, (down[:, :, None] * r[:, None, :]).reshape(len(noise), -1)))
            lower.step("bias", (token, up[:, None]), (noise, down.reshape(-1, 1)))
            lower.learn(before, last, token, x, y, gr)
    return upper, lower


def triples(flat: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and tokens ``lo`` to ``hi`` of texts that lie one after another; an end stands before each."""
    at = np.arange(lo, hi)
    token = flat[lo:hi]
    last, before = flat[np.maximum(at - 1, 0)], flat[np.maximum(at - 2, 0)]
    for shift in (0, 1):
        begin = offsets[np.searchsorted(offsets, lo - shift) : np.searchsorted(offsets, hi - shift)] - lo + shift
        before[begin] = 1
        if not shift:
            last[begin] = 1
    return before, last, token


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """Batches of ``size`` tokens, across texts and record batches."""
    held, n = [], 0
    for b in batches:
        flat, offsets = _flat(b.column(0))
        lo = 0
        while lo < len(flat):
            hi = min(len(flat), lo + size - n)
            held.append(triples(flat, offsets, lo, hi))
            n, lo = n + hi - lo, hi
            if n == size:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def train(codes: DataFrame, counts: Counts, params: Params) -> Model:
    """Rounds of noise-contrastive estimation over shards of ``codes`` (row, codes), and averaging."""
    spark = codes.sparkSession
    shards = min(params.max_shards, counts.tokens // params.shard_tokens + 1)
    rounds = min(params.rounds, shards)
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    model = start(counts, params)
    facts = spark.sparkContext.broadcast(counts)
    schema = "level int, name int, block int, part int, uses array<float>, squares array<float>, v array<float>"
    for turn in range(rounds if counts.tokens else 0):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            learners = nce(shared.value, _batches(batches, params.batch), facts.value, params, seed=100_000 * turn + part)
            for number, learner in enumerate(learners):
                for k, name in enumerate(TABLES):
                    rows, uses = getattr(learner.level, name), learner.uses[name]
                    firsts = [x for x in range(0, len(rows), params.block) if uses[x : x + params.block].any()]
                    if firsts:
                        own = [uses[x : x + params.block] for x in firsts]
                        scales = [learner.squares[name][x : x + params.block] * u for x, u in zip(firsts, own)]
                        sums = [(rows[x : x + params.block] * u[:, None]).ravel() for x, u in zip(firsts, own)]
                        whole = [np.full(len(firsts), z, np.int32) for z in (number, k, 0, part // params.fan)]
                        whole[2] = np.array(firsts, np.int32) // params.block
                        yield pa.RecordBatch.from_arrays(
                            [*map(pa.array, whole), *(pa.array(x, pa.list_(pa.float32())) for x in (own, scales, sums))],
                            names=["level", "name", "block", "part", "uses", "squares", "v"],
                        )

        def add(key: tuple, table: pa.Table) -> pa.Table:
            names = ("uses", "squares", "v")
            sums = [table[c].combine_chunks().flatten().to_numpy().reshape(len(table), -1).sum(0, dtype=np.float64).astype(np.float32) for c in names]
            firsts = [pa.array([x.as_py()], pa.int32()) for x in (*key[:3], table["part"][0])]
            return pa.table([*firsts, *(pa.array([x], pa.list_(pa.float32())) for x in sums)], names=["level", "name", "block", "part", *names])

        mine = codes.filter(F.pmod(shard, F.lit(rounds)) == turn)
        together = -(-shards // rounds)
        dealt = mine.repartitionById(together, F.floor(shard / rounds).cast("int")).select("codes")
        keys = ["level", "name", "block"]
        sums = dealt.mapInArrow(run, schema)
        for by in ([*keys, "part"], keys)[0 if together > params.fan else 1 :]:
            sums = sums.groupBy(*by).applyInArrow(add, schema)
        model = Model(model.classes.copy(), model.words.copy(), tuple({k: x.copy() for k, x in s.items()} for s in model.squares))
        for r in sums.toLocalIterator():  # the parameters: bounded by the head, whatever the corpus
            rows = getattr((model.classes, model.words)[r.level], TABLES[r.name])
            uses, v = np.array(r.uses, np.float32), np.array(r.v, np.float32)
            some, first = np.flatnonzero(uses), r.block * params.block
            rows[first + some] = v.reshape(len(uses), -1)[some] / uses[some][:, None]
            model.squares[r.level][TABLES[r.name]][first + some] = np.array(r.squares, np.float32)[some] / uses[some]
        shared.unpersist()
    return model


# ---------------------------------------------------------------------------
# scoring
# ---------------------------------------------------------------------------


def encode(docs: DataFrame, counts: Counts) -> DataFrame:
    """doc_id, held_out, codes (word numbers, the end last), words and many (words beyond the head, counted)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts.head)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = pa.array(sorted(shared.value, key=shared.value.get), pa.large_binary())
        for b in batches:
            of, own, beyond, tail = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [pa.array([], pa.large_binary())]
            for text, words in words_of(b):
                of.append(text)
                own.append(pc.fill_null(pc.index_in(words, value_set=head), -2).to_numpy() + np.int32(2))
                far = own[-1] == 0
                beyond.append(text[far])
                tail.append(words.filter(pa.array(far)))
            of, own, beyond = (np.concatenate(x) for x in (of, own, beyond))
            codes = np.ones(len(own) + b.num_rows, np.int32)
            codes[np.arange(len(own)) + of] = own  # as many ends stand before a word as texts
            sizes = np.bincount(of, minlength=b.num_rows) + 1
            different = pa.concat_arrays(tail).dictionary_encode()
            n = max(1, len(different.dictionary))
            pairs, many = np.unique(beyond * n + different.indices.to_numpy(), return_counts=True)
            tails = np.bincount(pairs // n, minlength=b.num_rows)
            at, of = (pa.array(np.concatenate([[0], np.cumsum(x)]), pa.int32()) for x in (sizes, tails))
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.ListArray.from_arrays(at, pa.array(codes)),
                pa.ListArray.from_arrays(of, different.dictionary.take(pa.array(pairs % n)).cast(pa.binary())),
                pa.ListArray.from_arrays(of, pa.array(many, pa.int64())),
            ], names=["doc_id", "held_out", "codes", "words", "many"])

    schema = f"doc_id {kind}, held_out boolean, codes array<int>, words array<binary>, many array<bigint>"
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def token_scores(model: Model, log_z: np.ndarray, counts: Counts, class_of: np.ndarray, before, last, token) -> np.ndarray:
    """ln probability of each token; of a word beyond the head that of its class."""
    a, b, t = class_of[before], class_of[last], class_of[token]
    own = model.classes
    value = np.einsum("ij,ij->i", own.predicted(a, b), own.target[t]) + own.bias[t, 0] - log_z[a, b]
    value = value.astype(np.float64)
    own = model.words
    inner = np.flatnonzero((np.diff(counts.starts) > 1)[t])
    inner = inner[np.argsort(t[inner], kind="stable")]
    classes, first = np.unique(t[inner], return_index=True)
    for c, lo, hi in zip(classes, first, [*first[1:], len(inner)]):
        rows = inner[lo:hi]
        x, y = counts.starts[c], counts.starts[c + 1]
        s = own.predicted(before[rows], last[rows]) @ own.target[x:y].T + own.bias[x:y, 0]
        picked = s[np.arange(len(rows)), token[rows] - x].copy()
        top = s.max(1)
        s -= top[:, None]
        value[rows] += picked - top - np.log(np.exp(s, out=s).sum(1))
    return value


def score(docs: DataFrame, folds: int = 10, held_out: int = 0, params: Params = Params()) -> DataFrame:  # noqa: B008
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row per row of ``docs``.

    Training documents are those whose crc32(doc_id as text) mod ``folds`` is not ``held_out``; all
    are scored.  A null or empty text is its end alone; a null doc_id counts as the id ''; repeated
    rows count and are scored each.  Without training documents every word is unseen: base_score is
    that of a uniform share, and score that of the untrained model.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    all_rows = docs.select("doc_id", (remainder("doc_id", folds) == held_out).alias("held_out"), "text")
    training = all_rows.filter(~F.col("held_out")).select("text")
    table = stored(count_words(training, params))
    counts = gather(table, training.count(), params)
    encoded = stored(encode(all_rows, counts).withColumn("row", F.monotonically_increasing_id()))
    model = train(encoded.filter(~F.col("held_out")).select("row", "codes"), counts, params)
    shared = spark.sparkContext.broadcast((counts, model, model.normalisers()))
    ln10 = float(np.log(10.0))
    log_total, log_other = counts.log_total(), float(np.log10(counts.other_mass))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, m, z = shared.value
        class_of = c.class_of
        log_c = np.log10(c.numbers + 0.1)
        log_c[0] = 0.0
        for b in batches:
            flat, offsets = _flat(b.column(1))
            n = np.diff(offsets)
            base, value, beyond = (np.zeros(len(n)) for _ in range(3))
            for lo in range(0, len(flat), params.slice):
                hi = min(len(flat), lo + params.slice)
                of = np.searchsorted(offsets, np.arange(lo, hi), side="right") - 1
                before, last, token = triples(flat, offsets, lo, hi)
                value += np.bincount(of, token_scores(m, z, c, class_of, before, last, token), len(n))
                base += np.bincount(of, log_c[token], len(n))
                beyond += np.bincount(of, token == 0, len(n))
            known = n - beyond.astype(np.int64) - (0 if c.ends else 1)
            value = value / ln10 - beyond * log_other
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *map(pa.array, (n, known, base, value))], names=["row", "n_tokens", "known", "base", "value"]
            )

    schema = "row bigint, n_tokens bigint, known bigint, base double, value double"
    kept = encoded.select("doc_id", "held_out", F.col("row").alias("of"))
    scored = encoded.select("row", "codes").mapInArrow(run, schema)
    each = encoded.select("row", F.explode(F.arrays_zip("words", "many")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.many").alias("n"))
    joined = each.join(table.withColumnRenamed("n", "count"), "word", "left")
    tails = joined.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("count", F.lit(0)) + 0.1)).alias("tail"),
        F.sum(F.when(F.col("count").isNotNull(), F.col("n")).otherwise(0)).alias("tail_known"),
    )
    out = kept.join(scored, F.col("row") == F.col("of")).drop("of").join(tails, "row", "left")
    tail = F.coalesce("tail", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(counts.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + tail - F.col("n_tokens") * log_total).alias("base_score"), (F.col("value") + tail).alias("score"),
    )
