"""Packing token sequences: shortest-pack-first over the length histogram.

Documents are tokenised and cut into full pieces of ``length`` tokens and one remainder.  The
histogram of remainder lengths (at most ``length`` numbers) is packed on the driver: lengths are
placed longest first, each into the open pack with the most room left, a whole bin at a time, so
what is kept are packing patterns with counts, never packs.  A position of a pattern with count c
takes c pieces of one length: pieces get a rank within their length from prefix sums over blocks
of rows, and the slot table, whose size depends on ``length`` alone, is joined by length and rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import pieces as text_pieces
from .common import stored, texts

LENGTH = 2048
END = 1
BLOCK = 65536
CACHE_WORDS = 800_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Marks that the tokenizer takes as one run behind the letters of a word (no apostrophes, no brackets).
MARKS = ".,;:!?*#$%&|"


#: Words learnt in one call of the tokenizer.
TOGETHER = 4096


class WordIds(dict):
    """Word to its ids as little-endian 32-bit bytes, learnt many at once and emptied when it grows too large.

    The tokenizer cuts at white space before all else and drops it, so the ids of a text are those
    of its words one after the other; it then cuts letters from marks and lowers their case, so a
    word of letters with marks behind it is put together from the two.  Words of letters are given
    to the tokenizer as one text: the last id of each is one of a word's end.  A test holds this
    against whole texts.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def single(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_letters(self, words: list[str]) -> None:
        """Lower-case words of letters alone."""
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(some):
                self.update((w.encode(), self.single(w)) for w in some)
                continue
            data = ids.tobytes()
            self.update((w.encode(), data[a:b]) for w, a, b in zip(some, [0, *stops], stops))

    def learn(self, words: set[bytes]) -> None:
        """Every word of ``words`` is known afterwards."""
        new = {w for w in words if w not in self}
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = words
        letters, joined = set(), []
        for word in new:
            text = word.decode("utf-8", "replace")
            front = text.rstrip(MARKS)
            if front.isalpha() and (low := front.lower()).isalpha():
                if low == text:
                    letters.add(low)
                    continue
                if (key := low.encode()) not in self:
                    letters.add(low)
                joined.append((word, key, text[len(front) :].encode()))
            else:
                self[word] = self.single(text)
        self.learn_letters(list(letters))
        for word, key, marks in joined:
            if marks and marks not in self:
                self[marks] = self.single(marks.decode())
            self[word] = self[key] + (self[marks] if marks else b"")

    def ids(self, text: bytes) -> bytes:
        out = []
        for part in text_pieces(text):
            words = part.split()
            try:
                out.append(b"".join(map(self.__getitem__, words)))
            except KeyError:
                self.learn(set(words))
                out.append(b"".join(map(self.__getitem__, words)))
        return b"".join(out)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per Python worker and file, kept from task to task."""
    return WordIds(path)


def cut(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens[, ids].

    A document's ids are the tokenizer's, without special tokens, then ``END``; a null or empty
    text has only that one.  Every id lies in exactly one piece.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<bigint>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            of, rows, ids = [], [], []
            for i, text in enumerate(texts(b)):
                data = memoryview(known.ids(text) + end)
                n = len(data) // 4
                for at in range(0, n, length):
                    part = data[4 * at : 4 * min(n, at + length)]
                    of.append(i)
                    rows.append((at, len(part) // 4, zlib.crc32(part), n))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            cols = np.array(rows, np.int64).reshape(-1, 4).T
            doc = b.column(b.schema.get_field_index("doc_id")).take(pa.array(of, pa.int64()))
            arrays = [doc, *map(pa.array, cols)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_histogram(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[int]]]:
    """Packing patterns with counts: (count, lengths in order); each bin is used up exactly."""
    room: dict[int, list[tuple[int, list[int]]]] = {}  # open packs by room left
    for size in sorted(histogram, reverse=True):
        todo = histogram[size]
        while todo > 0:
            most = max((r for r in room if r >= size), default=None)
            if most is None:
                count, pattern = todo, []
                left = length
            else:
                count, pattern = room[most].pop()
                left = most
                if not room[most]:
                    del room[most]
            if count > todo:
                room.setdefault(left, []).append((count - todo, pattern))
                count = todo
            room.setdefault(left - size, []).append((count, [*pattern, size]))
            todo -= count
    return [p for packs in room.values() for p in packs]


def slots(patterns: list[tuple[int, list[int]]], first_sequence: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(length, rank from, rank to, sequence of the first, offset) of each position of each pattern."""
    used: dict[int, int] = {}
    out, sequence = [], first_sequence
    for count, pattern in patterns:
        offset = 0
        for size in pattern:
            at = used.get(size, 0)
            out.append((size, at, at + count, sequence, offset))
            used[size] = at + count
            offset += size
        sequence += count
    return out


def ranked(cut_pieces: DataFrame) -> DataFrame:
    """``cut_pieces`` (a written table with ``row``) with ``rank`` among the pieces of equal length."""
    rows = cut_pieces.withColumn("block", F.expr(f"row div {BLOCK}"))
    counts = rows.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    within = F.row_number().over(W.partitionBy("length", "block").orderBy("row")) - 1
    return (
        rows.withColumn("within", within).join(starts, ["length", "block"])
        .withColumn("rank", F.col("from") + F.col("within")).drop("block", "from", "within", "row")
    )


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    Sequences hold at most ``length`` tokens and are filled gapless from 0.  Repeated rows and null
    doc_ids are documents of their own; columns other than doc_id and text are not read; an empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    table = stored(cut(docs, tokenizer, length, with_ids).withColumn("row", F.monotonically_increasing_id()))
    histogram = {r.length: r.n for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    full = histogram.pop(length, 0)
    places = slots(pack_histogram(histogram, length), full)
    slot = spark.createDataFrame(places, "slot_length bigint, low bigint, high bigint, first bigint, at bigint")
    if len(places) <= 64 * length:  # at most 5 MB for 2048; patterns do not grow with the documents
        slot = F.broadcast(slot)
    place = ranked(table)
    short = place.join(slot, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ids = ["ids"] * with_ids
    placed = short.select(*own, (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("at").alias("offset"), *ids)
    whole = place.filter(F.col("length") == length).select(
        *own, F.col("rank").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), *ids
    )
    return placed.unionByName(whole)
