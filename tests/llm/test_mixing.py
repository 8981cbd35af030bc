from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import mixing
from sentrylake.llm.queries import QUERIES

from .helpers import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(size):
    """Share by weight; where a source is above three times its size, cut it and share the excess again."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(size.values()), {}
    while True:
        left = total - sum(full.values())
        open_weight = sum(w for s, w in weight.items() if s not in full)
        target = full | {s: left * w / open_weight for s, w in weight.items() if s not in full}
        above = [s for s in names if s not in full and target[s] > 3 * size[s] + 1e-9]
        if not above:
            return target
        full |= {s: 3.0 * size[s] for s in above}


CASES = {
    "plain": [("a", 30), ("b", 30), ("c", 30)],
    "capped": [("a", 3), ("b", 500), ("c", 400), ("d", 2), (None, 90)],
    "one": [("z", 17)],
    "empty source": [("a", 0), ("b", 12), ("c", 0)],
    "chain of caps": [("a", 10), ("b", 11), ("c", 300), ("d", 15), ("e", 1000)],
}


@pytest.mark.parametrize("case", CASES)
def test_targets_and_taken(spark, case):
    rows, i = [], 0
    for s, n in CASES[case]:
        k = 0
        while k < n or k == 0:
            m = min(n - k, 1 + i % 9)
            rows.append((i, " ".join(["w"] * m), s))
            i, k = i + 1, k + max(1, m)
    got = mixing.mix(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == list(range(i))
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t))
    want = plain_targets(size)
    taken = Counter()
    for r in got:
        assert r.size == len(WORD.findall(rows[r.doc_id][1])) and r.source_size == size[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 9 for s in size)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    names = ("doc_id", "size", "source_size", "target", "taken")
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({mixing.SQL})").fetchall())
    df = QUERIES["op2_mixing"](spark, f"/root/testdata/{sf}").select(*names)
    assert sorted(tuple(r) for r in df.collect()) == want
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "x y", None), (None, "p q r", "a"), (4, "k l m", ""), (4, "k l m", "")]
    docs = documents(spark, rows).withColumns({"size": F.lit("own"), "rank": F.lit(1), "copies": F.lit(2), "n": F.lit(0)})
    got = mixing.mix(docs).collect()
    assert sorted((r.size, r.source or "") for r in got) == [(0, ""), (0, "a"), (2, ""), (2, ""), (2, ""), (3, "a")]
    again = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.repeat_documents(docs)
    assert mixed.columns == docs.columns
    took = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert sum(len(WORD.findall(t or "")) * n for (_, t), n in took.items()) == sum(r.taken for r in got)
    assert mixing.mix(documents(spark, [])).count() == 0 and mixing.repeat_documents(documents(spark, [])).count() == 0


def test_repeated_rows_of_one_size(spark):
    rows = [(7, "w w w", "a")] * 50 + [(i, "w w w", "b") for i in range(100, 150)]
    got = mixing.mix(documents(spark, rows)).collect()
    for s, share in (("a", 5 / 7), ("b", 2 / 7)):
        assert abs(sum(r.taken for r in got if r.source == s) - 300 * share) <= 3
