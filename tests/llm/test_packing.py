from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sentrylake.llm import packing as P

from .helpers import documents, read


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.default_tokenizer())


def check(rows, got, tokenizer, length):
    """Every id of every document in exactly one piece, packs gapless and within bounds."""
    want = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in rows]
    left = Counter()
    for (d, _), ids in zip(rows, want):
        left.update((d, a, len(ids[a : a + length]), zlib.crc32(ids[a : a + length].tobytes()), len(ids)) for a in range(0, len(ids), length))
    assert left == Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
    packs = defaultdict(list)
    for r in got:
        packs[r.sequence_id].append((r.offset, r.length))
    for parts in packs.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return sum(map(len, want)) / (length * len(packs)) if packs else 1.0


def test_given_documents(spark, sf, tokenizer):
    docs = read(sf, "documents")
    got = P.pack(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert check(list(zip(docs.doc_id, docs.text)), got, tokenizer, 2048) > 0.9


def test_words_give_the_ids_of_whole_texts(tokenizer, monkeypatch):
    monkeypatch.setattr(P, "CACHE_WORDS", 40)
    known = P.WordIds(P.default_tokenizer())
    rng = random.Random(4)
    alphabet = "aZé Ö ΣσΆ   　 \t\n\x0b\x0c\r\x1c\x85 don't we'll 12x <|endoftext|> <|startoftext|>🙂漢字 ​  !?.,'s".split(" ") + [" ", "  ", "\n", "\t", "́", "İ", "ﬁ"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(0, 30)))
        assert np.frombuffer(known.ids(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_histogram_packing():
    rng = random.Random(1)
    for length in (8, 64, 2048):
        histogram = Counter(rng.randrange(1, length) for _ in range(3000))
        patterns = P.pack_histogram(histogram, length)
        used = Counter()
        for count, pattern in patterns:
            assert count > 0 and sum(pattern) <= length and pattern == sorted(pattern, reverse=True)
            used.update({s: 0 for s in pattern})
            for s in pattern:
                used[s] += count
        assert used == histogram
        packs = sum(c for c, _ in patterns)
        assert sum(k * v for k, v in histogram.items()) > (0.95 if length > 100 else 0.8) * length * packs
    big = P.pack_histogram({k: 10**9 + k for k in range(1, 2048)})
    assert sum(len(p) for _, p in big) < 64 * 2048


def test_odd_rows_with_ids(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "a b c " * 30), (3, "a b c " * 30), (None, "word " * 40), (5, "x"), (6, " \n ")]
    docs = documents(spark, rows).selectExpr("*", "1 AS row", "2 AS length", "3 AS rank", "4 AS low")
    got = P.pack(docs, length=16, with_ids=True).collect()
    check(rows, got, tokenizer, 16)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert P.pack(documents(spark, [])).count() == 0
