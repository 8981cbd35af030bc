from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sentrylake.llm import align as X

from .helpers import documents

PATH_A, PATH_B = X.default_tokenizers()


def brute(rows):
    """Whole texts, one after the other, as the contract words it."""
    a_tok, b_tok = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    a_tok.encode_special_tokens = True
    byte = X.byte_of_character()
    token_of = {i: t for t, i in a_tok.get_vocab().items()}
    bytes_a = lambda i: bytes(byte[c] for c in token_of[i])

    def bytes_b(i):
        piece = b_tok.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_tok.is_byte(i) else piece.replace("▁", " ").encode()

    docs, count = [], Counter()
    for i, text in rows:
        a, b = (a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)) if text else ([], [])
        x, y = [bytes_a(t) for t in a], [bytes_b(t) for t in b]
        if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
            docs.append((i, None))
            continue
        ends_b = {int(e): n for n, e in enumerate(np.cumsum([len(t) for t in y]))}
        links, groups, last = [], [], (0, 0)
        for n, e in enumerate(np.cumsum([len(t) for t in x])):
            m = ends_b.get(int(e))
            if m is not None:
                links.append((a[n], b[m]))
                groups.append(",".join(map(str, a[last[0] : n + 1])) + "|" + ",".join(map(str, b[last[1] : m + 1])))
                last = (n + 1, m + 1)
        count.update(links)
        docs.append((i, (len(a), len(b), links, ";".join(groups))))
    most = defaultdict(int)
    for (_, t), n in count.items():
        most[t] = max(most[t], n)
    out = []
    for i, found in docs:
        if found is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, links, groups = found
        best = sum(count[p] == most[p[1]] for p in links)
        out.append((i, n_a, n_b, len(links), len(links), best, sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = documents(spark, rows).selectExpr("*", "1 AS at", "'x' AS shelf", "2 AS n_a", "3 AS keys")
    found = X.align(df, **options)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("chunk,bucket", [(4096, 1 << 26), (7, 1 << 14)])
def test_given_documents(spark, chunk, bucket):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, rows, chunk_rows=chunk, bucket_bytes=bucket) == brute(rows)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "a  b", "   a   b   ", "a\n b", "a \n b", "a\n\n  b\t \tc", "  x  y", "it's 's 'll we'll",
    "<|endoftext|>", "x <|endoftext|> <s> </s> <unk> <0x41>", "▁", "a▁b", "▁ a", "Hello, world!  (tokens) 1234567", "\x00 a\x00b",
    "é é ﬁ Å", "日本語 のテキスト", "\U0001f600 \U0001f468‍\U0001f469", "\r\n a\r\n", "-" * 300, "ab" * 5000,
    "word " * 50, "　 a   b", "﻿ a", "a\u0085 b",
]


def test_odd_texts(spark):
    rows = list(enumerate(ODD)) + [(3, "a"), (3, "a"), (None, "a b"), (None, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, chunk_rows=2) == brute(rows)


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(X, "PART", 50)
    known = X.Aligner(PATH_A, PATH_B)
    texts = ["some words " * 40, "x" * 300 + " " + "y " * 100, "a" + " " * 200 + "b", " " * 400, "a" * 60 + " " * 60 + "b" * 60 + " c" * 60]
    for text in [*texts, *filter(None, ODD)]:
        parts = [s for part in X.segments(text.encode()) for s in part]
        found = known.learn(list(dict.fromkeys(parts)))
        at = {s: i for i, s in enumerate(dict.fromkeys(parts))}
        (_, n_a, n_b, *_, digest), = brute([(1, text)])
        assert found.good.all() == (digest != "")
        if digest:
            groups = b";".join(found.groups[at[s]] for s in parts)
            assert hashlib.sha256(groups).hexdigest() == digest
            assert sum(found.sizes[at[s]][:2] for s in parts).tolist() == [n_a, n_b]


def test_both_forms_of_the_byte_level_tokenizer():
    known = X.Aligner(PATH_A, PATH_B)
    texts = [t for t in ODD if t and len(t) < 1000] + ["don't they'LL we'd x's 1st 22nd 3.14 (a) --- ...  \u00bd\u2167 \u0e01\u0e33 e\u0301 \u1100\u1161 \ud55c"]
    assert known.fast_a is not None
    for text in texts:
        assert known.tokens(text, True)[0].tolist() == known.tokens(text, False)[0].tolist()


@pytest.mark.parametrize("window", [1 << 23, 100])
def test_windows_of_texts(window):
    known = X.Aligner(PATH_A, PATH_B)
    items = [(t or "").encode() for t in ODD]
    ranges = list(X.windows(items, window))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(len(items)))
    keys, counts = X.summed([X.link_counts(known, items[a:b]) for a, b in ranges])
    assert counts[counts > 0].sum() == sum(r[3] for r in brute(list(enumerate(ODD))))


def test_a_third_of_the_rows_alike(spark):
    rows = [(i, "the same text, many times over" if i % 3 else f"text {i} of its own {i * 7}") for i in range(600)]
    assert run(spark, rows, chunk_rows=50) == brute(rows)


def test_no_documents(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 200_000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 48, n))
    hashed = X.PerfectHash.read(X.PerfectHash.build(keys).bytes())
    assert len(hashed) == len(keys) and sorted(hashed.slots(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(rng.integers(0, 1 << 48, 1000), keys)
    kept = np.zeros(len(keys) + 1, np.int64) - 1
    kept[hashed.slots(keys)] = keys
    assert (kept[hashed.slots(others)] != others).all()
    assert len(hashed.bytes()) < 8 * 60 + len(keys) * 1.0  # below a byte a key
