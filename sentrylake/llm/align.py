"""Cross-tokenizer alignment, with counts in dense vectors behind minimal perfect hashes.

Both tokenizers cut no token across a space that follows another character than a space, so a text
is a row of segments, each a run of spaces with what follows it, that can be tokenised apart.
A test holds this against whole texts.

First pass: the distinct links (pairs of ids whose tokens end together) of every chunk of documents
with their counts.  Pairs are dealt to buckets; a minimal perfect hash is built for the distinct pairs of
each bucket, and the counts are added up in dense vectors indexed by it, in a tree: per bucket and group of
chunks, then per bucket.  The key of each slot is kept, so every look-up is verified.  Second pass:
every chunk gets the counts of its pairs, and its documents are aligned again and look them up.  No
table of all pairs is held in one task, nor sent to the driver.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts
from .shelves import missing, numbers, visit

CHUNK_ROWS = 8192
BUCKET_BYTES = 1 << 26  # of text to a bucket of pairs
MOST_BUCKETS = 1024
GROUPS = 8  # first level of the tree of sums
PART = 1 << 22
GATHER, WINDOW = 1 << 24, 3 << 21  # bytes of text whose distinct segments are learnt together, in the first and second pass
TOGETHER = 4096
SPACED = re.compile(rb" ( *[^ ]*)")
#: Fixed value: the pattern by which byte-level BPE of this kind cuts a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def segments(text: bytes) -> Iterator[list[bytes]]:
    """The segments of space + ``text`` without their first space, in lists of about ``PART`` bytes."""
    data = b" " + text
    at, n = 0, len(data)
    while at < n:
        end = n
        if n - at > PART:
            end = data.rfind(b" ", at + 1, at + PART)
            while end > at and data[end - 1] == 32:
                end -= 1
            if end <= at:  # one segment longer than the part
                spaces = at
                while spaces < n and data[spaces] == 32:
                    spaces += 1
                end = data.find(b" ", spaces)
                end = n if end < 0 else end
        part = data[at:end]
        yield SPACED.findall(part) if b"  " in part else part.split(b" ")[1:]
        at = end


@dataclass
class Learned:
    """What is known of distinct segments, by their position; ``of`` has the segment of each link."""

    good: np.ndarray  # tokens give back the bytes
    sizes: np.ndarray  # n_a, n_b, n_groups
    links: np.ndarray
    of: np.ndarray
    groups: list[bytes]


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = byte_of_character()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.long_a = np.array([len(b) for b in self.bytes_a])
        self.long_b = np.array([len(b) for b in self.bytes_b])
        self.space = self.b.piece_to_id("▁")
        self.fast_a = self._ranked(path_a)
        # an id with what follows it in the text of groups: the next id, the other side, the next group, the next segment
        self.most = max(len(self.bytes_a), len(self.bytes_b))
        self.words = [b"%d%c" % (i, c) for c in b",|;\n" for i in range(self.most)]

    def _ranked(self, path: str):
        """A faster form of the same byte-level BPE, where merges have the order of the ids they make; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        vocabulary = model["model"]["vocab"]
        made = [vocabulary[x + y] for x, y in merges]
        if made != sorted(made) or len(set(made)) != len(made) or len(made) + 256 > len(vocabulary):
            return None
        byte = byte_of_character()
        ids = set(made) | {vocabulary[c] for c in byte}
        ranks = {self.bytes_a[i]: i for i in ids}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)

    def tokens(self, text: str, short: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both for space + ``text``; ``short`` if it has no long run without white space."""
        if short and self.fast_a is not None:
            a = self.fast_a.encode_ordinary(" " + text)
        else:
            a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        return np.array(a, np.int64), np.array(self.b.encode(text) if text else [self.space], np.int64)

    def aligned(self, text: str, bounds: np.ndarray, with_groups: bool) -> Learned | None:
        """The segments that end at ``bounds`` (bytes of space + text); None where bytes differ."""
        data = b" " + text.encode("utf-8")
        a, b = self.tokens(text, len(bounds) > 1)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != data or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != data:
            return None
        end_a, end_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        at_b = np.minimum(np.searchsorted(end_b, end_a), len(b) - 1)
        at_a = np.flatnonzero(end_b[at_b] == end_a)  # A tokens that end a group
        at_b, both = at_b[at_a], end_a[at_a]
        last = np.minimum(np.searchsorted(both, bounds), len(both) - 1)
        if (both[last] != bounds).any():
            return None
        n = len(bounds)
        of = np.searchsorted(bounds, both)
        sizes = np.stack([np.bincount(x, minlength=n) for x in (np.searchsorted(bounds, end_a), np.searchsorted(bounds, end_b), of)], axis=1)
        groups = []
        if with_groups:
            count_a, count_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
            word = np.empty(len(a) + len(b), np.int64)
            # the A ids of a group stand before its B ids
            word[np.arange(len(a)) + np.repeat(np.cumsum(count_b) - count_b, count_a)] = a
            word[np.arange(len(b)) + np.repeat(np.cumsum(count_a), count_b)] = b
            ends = np.cumsum(count_a + count_b) - 1
            word[ends - count_b] += self.most
            word[ends] += 2 * self.most
            word[ends[last]] += self.most
            groups = b"".join(map(self.words.__getitem__, word.tolist())).split(b"\n")[:-1]
        return Learned(np.ones(n, bool), sizes, a[at_a] << 32 | b[at_b], of, groups)

    def learn(self, segments: list[bytes], with_groups: bool = True) -> Learned:
        """Distinct ``segments``, many of them tokenised as one text."""
        n = len(segments)
        good, sizes, links, of, groups = np.zeros(n, bool), np.zeros((n, 3), np.int64), [], [], [b""] * n

        def put(at: list[int]) -> bool:
            some = [segments[i] for i in at]
            try:
                found = self.aligned(b" ".join(some).decode("utf-8"), np.cumsum([len(s) + 1 for s in some]), with_groups)
            except UnicodeDecodeError:
                return False
            if found is None:
                return False
            place = np.array(at)
            good[place], sizes[place] = True, found.sizes
            links.append(found.links)
            of.append(place[found.of])
            for i, g in zip(at, found.groups):
                groups[i] = g
            return True

        # spaces at an end would run into the next segment
        joined = [i for i, s in enumerate(segments) if s and len(s) < 256 and s[-1] != 32]
        apart = [i for i, s in enumerate(segments) if not (s and len(s) < 256 and s[-1] != 32)]
        for at in range(0, len(joined), TOGETHER):
            if not put(joined[at : at + TOGETHER]):
                apart += joined[at : at + TOGETHER]
        for i in apart:
            put([i])
        none = np.zeros(0, np.int64)
        return Learned(good, sizes, np.concatenate([none, *links]), np.concatenate([none, *of]), groups)


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker, kept from task to task."""
    return Aligner(path_a, path_b)


def windows(items: list[bytes], most: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together."""
    at, size = 0, 0
    for i, text in enumerate(items):
        size += len(text)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(items):
        yield at, len(items)


def link_counts(known: Aligner, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct links of some texts with their counts; texts that have no tokens give none."""
    count: Counter = Counter()
    for text in filter(None, items):
        for part in segments(text):
            count.update(part)
    distinct = list(count)
    found = known.learn(distinct, with_groups=False)
    if not found.good.all():
        bad = {s for s, g in zip(distinct, found.good) if not g}
        for text in filter(None, items):
            parts = list(segments(text))
            if any(not bad.isdisjoint(p) for p in parts):
                for part in parts:
                    count.subtract(part)
    weight = np.array([count[s] for s in distinct], np.int64)
    return summed([(found.links, weight[found.of])])


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bit arrays; a key's slot is the rank of the first bit that it has alone."""

    GAMMA = 2

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.before = np.cumsum([0, *[int(x.sum()) for x in levels]])
        self.ranks = [np.cumsum(x) - 1 for x in levels]

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < 48:
            at = cls.place(keys, len(levels), cls.GAMMA * len(keys))
            alone = np.bincount(at, minlength=cls.GAMMA * len(keys)) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def __len__(self) -> int:
        return int(self.before[-1]) + len(self.rest)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for some that are not in it; others must be told by the key kept in the slot."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self.place(keys[todo], level, len(bits))
            here = bits[at]
            out[todo[here]] = self.before[level] + self.ranks[level][at[here]]
            todo = todo[~here]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            same = self.rest[at] == keys[todo]
            out[todo[same]] = self.before[-1] + at[same]
        return out

    def bytes(self) -> bytes:
        """Sizes of the levels, their bits, then what is left over."""
        head = np.array([len(self.levels), *map(len, self.levels)], np.int64).tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels) + self.rest.tobytes()

    @classmethod
    def read(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8).tolist()
        at, levels = 8 * (n + 1), []
        for size in sizes:
            packed = np.frombuffer(data, np.uint8, -(-size // 8), at)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        return cls(levels, np.frombuffer(data[at:], np.int64))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return PerfectHash.place(keys, 99, buckets)


def _list(values: np.ndarray) -> pa.Array:
    return pa.array([values.tobytes()], pa.binary())


def _each(part: pa.RecordBatch, *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    columns = [part.column(part.schema.get_field_index(n)) for n in names]
    for i in range(len(part)):
        yield tuple(np.frombuffer(c[i].as_buffer(), np.int64) for c in columns)


class Table:
    """A bucket's pairs in the order of their slots, and the counts being added up."""

    def __init__(self, shelf: str, hashed: PerfectHash, keys: np.ndarray, counts: np.ndarray | None = None):
        self.shelf, self.hashed, self.keys = shelf, hashed, keys
        self.counts = np.zeros(len(keys), np.int64) if counts is None else counts

    def slots(self, keys: np.ndarray) -> np.ndarray:
        at = self.hashed.slots(keys)
        if (at < 0).any() or (self.keys[at] != keys).any():
            raise ValueError("a pair that the hash does not know")
        return at


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None, chunk_rows: int = CHUNK_ROWS,
          bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every document.

    ``tokenizers`` are the files of a byte-level BPE (A) and of a sentencepiece model (B).  Texts that
    are null, empty, or that either tokenizer's tokens do not give back byte by byte have zeros and
    ''.  Repeated rows and null doc_ids are documents of their own and count as often as they come; columns
    other than doc_id and text are not read; an empty table gives an empty one.
    """
    path_a, path_b = tokenizers or default_tokenizers()
    kind = docs.schema["doc_id"].dataType.simpleString()
    row = F.monotonically_increasing_id()
    rows = stored(docs.select("doc_id", "text").withColumn("at", row).withColumn("shelf", F.expr(f"cast(at div {chunk_rows} as string)")))
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    buckets = int(min(MOST_BUCKETS, max(4, -(-size // bucket_bytes))))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(path_a, path_b)
        now, held, waiting, size = None, [], [], 0

        def fold() -> None:
            """Texts that wait become counts."""
            nonlocal waiting, size, held
            if waiting:
                held.append(link_counts(known, waiting))
                waiting, size = [], 0
            if len(held) > 16:
                held = [summed(held)]

        def pairs() -> Iterator[pa.RecordBatch]:
            fold()
            if not held:
                return
            keys, counts = summed(held)
            keys, counts = keys[counts > 0], counts[counts > 0]
            bucket = _bucket(keys, buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                some = order[edges[b] : edges[b + 1]]
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([str(b)]), pa.array([now]), pa.array([int(now)], pa.int64()), _list(keys[some]), _list(counts[some])],
                        names=["shelf", "chunk", "at", "keys", "counts"])

        for b in batches:
            chunks = b.column(b.schema.get_field_index("shelf")).to_pylist()
            for chunk, text in zip(chunks, texts(b)):
                if chunk != now:
                    yield from pairs()
                    now, held = chunk, []
                waiting.append(text)
                size += len(text)
                if size >= GATHER:
                    fold()
        yield from pairs()

    def unique_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct keys of each (shelf, part); rows come sorted by them."""
        now, held, n = None, [], 0
        for b in batches:
            names = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for key, (keys,) in zip(names, _each(b, "keys")):
                if key != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now[0]]), _list(np.unique(np.concatenate(held)))], names=["shelf", "keys"])
                    now, held, n = key, [], 0
                held.append(keys)
                n += len(keys)
                if n > 1 << 21:
                    held = [np.unique(np.concatenate(held))]
                    n = 0
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), _list(np.unique(np.concatenate(held)))], names=["shelf", "keys"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in unique_keys(batches):
            (keys,) = next(_each(b, "keys"))
            hashed = PerfectHash.build(keys)
            ordered = np.empty_like(keys)
            ordered[hashed.slots(keys)] = keys
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashed.bytes()], pa.binary()), _list(ordered)], names=["shelf", "hash", "slot_keys"])

    def table(rest: pa.Table) -> Table:
        first = rest.slice(0, 1).to_batches()[0]
        hashed = PerfectHash.read(first.column(first.schema.get_field_index("hash"))[0].as_py())
        keys = next(_each(first, "slot_keys"))[0]
        counted = not missing(first, "slot_counts")[0] if "slot_counts" in first.schema.names else False
        shelf = first.column(first.schema.get_field_index("shelf"))[0].as_py()
        return Table(shelf, hashed, keys, next(_each(first, "slot_counts"))[0] if counted else None)

    def add(held: Table, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for keys, counts in _each(part, "keys", "counts"):
            held.counts[held.slots(keys)] += counts  # keys of a row are distinct
        return iter(())

    def vector(held: Table) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([held.shelf]), _list(held.counts)], names=["shelf", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum of the vectors of each shelf; rows come sorted by it."""
        now, held = None, None
        for b in batches:
            for key, (sums,) in zip(b.column(0).to_pylist(), _each(b, "sums")):
                if key != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), _list(held)], names=["t_shelf", "slot_counts"])
                    now, held = key, np.zeros(len(sums), np.int64)
                held += sums
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), _list(held)], names=["t_shelf", "slot_counts"])

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Highest count of each B id in a bucket."""
        for b in batches:
            for keys, counts in _each(b, "slot_keys", "slot_counts"):
                ids = keys & 0xFFFFFFFF
                order = np.lexsort((counts, ids))
                last = np.flatnonzero(np.diff(ids[order], append=-1))
                yield pa.RecordBatch.from_arrays([pa.array(ids[order][last]), pa.array(counts[order][last])], names=["b", "most"])

    def tell(held: Table, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        chunks = part.column(part.schema.get_field_index("chunk"))
        for i, (keys,) in enumerate(_each(part, "keys")):
            counts = held.counts[held.slots(keys)]
            yield pa.RecordBatch.from_arrays([chunks.slice(i, 1), _list(keys), _list(counts)], names=["shelf", "keys", "counts"])

    pairs = stored(rows.select("shelf", "text").mapInArrow(gather, "shelf string, chunk string, at bigint, keys binary, counts binary"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.pmod(F.xxhash64("at"), F.lit(GROUPS)).cast("string")
    some = pairs.select("shelf", group.alias("part"), "keys").repartition(parts, "shelf", "part").sortWithinPartitions("shelf", "part")
    some = some.mapInArrow(unique_keys, "shelf string, keys binary").withColumn("part", F.lit("")).select("shelf", "part", "keys")
    some = some.repartition(parts, "shelf").sortWithinPartitions("shelf")
    hashed = stored(some.mapInArrow(hashes, "shelf string, hash binary, slot_keys binary"))
    vectors = visit(hashed, pairs.select("shelf", "at", "keys", "counts"), table, add, "shelf string, sums binary", spread=GROUPS, ending=vector)
    sums = vectors.repartition(parts, "shelf").sortWithinPartitions("shelf").mapInArrow(total, "t_shelf string, slot_counts binary")
    counted = stored(hashed.join(sums, F.col("shelf") == F.col("t_shelf")).drop("t_shelf"))
    # one row for each B id at most: bounded by the vocabulary
    most = counted.select("slot_keys", "slot_counts").mapInArrow(highest, "b bigint, most bigint").groupBy("b").agg(F.max("most").alias("most"))
    most = {r.b: r.most for r in most.collect()}
    best_of = np.zeros(max(most, default=0) + 1, np.int64)
    best_of[list(most)] = list(most.values())
    told = visit(counted, pairs.select("shelf", "at", "chunk", "keys"), table, tell, "shelf string, keys binary, counts binary", spread=GROUPS)
    told = stored(told)

    def begin(rest: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        parts = [p for b in rest.to_batches() for p in _each(b, "keys", "counts")]
        keys, counts = (np.concatenate(x) for x in zip(*parts))
        keys, first = np.unique(keys, return_index=True)  # a chunk can lie in two files' parts
        return keys, counts[first]

    def measure(held: tuple[np.ndarray, np.ndarray], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = aligner(path_a, path_b)
        keys, counts = held
        best = counts == best_of[keys & 0xFFFFFFFF]
        items, out, digests = texts(part), [], []
        for low, high in windows(items):
            parts = [list(segments(t)) if t else [] for t in items[low:high]]
            distinct = list({s for p in parts for some in p for s in some})
            place = {s: i for i, s in enumerate(distinct)}
            found = known.learn(distinct)
            at = np.minimum(np.searchsorted(keys, found.links), max(0, len(keys) - 1))
            n = len(distinct)
            # links of texts without tokens need not be known
            count = np.where(keys[at] == found.links, counts[at], 0) if len(keys) else np.zeros(len(at), np.int64)
            top = (count > 0) & best[at] if len(keys) else np.zeros(len(at), bool)
            per = np.stack([np.bincount(found.of, minlength=n), np.bincount(found.of, top, n), np.bincount(found.of, count, n)], axis=1)
            per = np.concatenate([found.sizes, per.astype(np.int64)], axis=1)
            groups = dict(zip(distinct, found.groups))
            for p in parts:
                total, digest = np.zeros(6, np.int64), hashlib.sha256()
                for k, some in enumerate(p):
                    where = np.fromiter(map(place.__getitem__, some), np.int64, len(some))
                    if not found.good[where].all():
                        p = None
                        break
                    total += per[where].sum(axis=0)
                    digest.update(b";" * (k > 0) + b";".join(map(groups.__getitem__, some)))
                out.append(total if p else np.zeros(6, np.int64))
                digests.append(digest.hexdigest() if p else "")
        columns = np.array(out, np.int64).reshape(-1, 6).T
        yield pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index("doc_id")), *map(pa.array, columns), pa.array(digests, pa.string())],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    # a chunk without any pair still has its documents
    empty = rows.select("shelf").distinct().select(
        "shelf", F.lit(b"").alias("keys"), F.lit(b"").alias("counts"))
    return visit(
        told.unionByName(empty), rows.select("shelf", "at", "doc_id", "text"), begin, measure,
        f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([c for _, c in held]).astype(float), len(keys)).astype(np.int64)
