"""The order-dependent operators against plain loops, with hot keys, ties and negative times."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.operators import scan as S

SEC = 1_000_000


def stamps(seed: int, n: int, hot: float, span: int, grain: int = 1):
    """Rows (k, id, t, x); a share ``hot`` of them belongs to one key; ``grain`` makes ties."""
    rnd = random.Random(seed)
    return [
        ("hot" if rnd.random() < hot else rnd.choice("abc"), i, rnd.randrange(-span // 4, span) // grain * grain, rnd.random() < 0.5)
        for i in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, id long, t long, x boolean")


@pytest.mark.parametrize("seed,grain,slice_us", [(1, 1, 10 * SEC), (2, SEC, 3 * SEC), (3, 5 * SEC, 60 * SEC)])
def test_window_counts(spark, seed, grain, slice_us):
    rows = stamps(seed, 600, 0.5, 100 * SEC, grain)
    got = {
        (r.k, r.t): (r.all10, r.x5)
        for r in S.window_counts(
            frame(spark, rows), "k", "t", {"all": F.lit(True), "x": F.col("x")},
            {"all10": ("all", 10 * SEC), "x5": ("x", 5 * SEC)}, wanted="x", slice_us=slice_us,
        ).collect()
    }
    expected = {}
    for k, _, t, x in rows:
        if x:
            same = [(u, y) for j, _, u, y in rows if j == k]
            expected[(k, t)] = (
                sum(t - 10 * SEC <= u <= t for u, _ in same), sum(y and t - 5 * SEC <= u <= t for u, y in same)
            )
    assert got == expected


def test_window_counts_bounds(spark):
    rows = [("a", 0, 0, True), ("a", 1, 10 * SEC, True), ("a", 2, 20 * SEC + 1, True), (None, 3, 0, True), ("", 4, 0, True)]
    got = {
        r.t: r.n for r in S.window_counts(
            frame(spark, rows), "k", "t", {"all": F.lit(True)}, {"n": ("all", 10 * SEC)}).collect()
    }
    assert got == {0: 1, 10 * SEC: 2, 20 * SEC + 1: 1}


@pytest.mark.parametrize("seed,grain", [(4, 1), (5, SEC)])
def test_asof_last(spark, seed, grain):
    rows = stamps(seed, 600, 0.6, 100 * SEC, grain)
    df = frame(spark, rows)
    got = {
        (r.k, r.t): (r._entry_t, r.id)
        for r in S.asof_last(df.filter("not x"), df.filter("x"), ["k"], "t", ["id"], tie="id", slice_us=7 * SEC).collect()
    }
    expected = {}
    for k, _, t, x in rows:
        if not x:
            before = [(u, i) for j, i, u, y in rows if y and j == k and u <= t]
            expected[(k, t)] = max(before) if before else (None, None)
    assert got == expected


def kept(rows, gap):
    out = set()
    for k in {r[0] for r in rows}:
        last = None
        for t in sorted({r[2] for r in rows if r[0] == k}):
            if last is None or t - last >= gap:
                out.add((k, t))
                last = t
    return out


@pytest.mark.parametrize("gap", [SEC // 2, 3 * SEC, 10 * SEC, 1000 * SEC])
def test_chained_gap(spark, gap):
    rows = stamps(6, 500, 0.7, 60 * SEC, 1000)
    got = {(r.k, r.t) for r in S.chained_gap(frame(spark, rows), ["k"], "t", gap).collect()}
    assert got == kept(rows, gap)
    for k in {k for k, _ in got}:
        ts = sorted(t for j, t in got if j == k)
        assert all(b - a >= gap for a, b in zip(ts, ts[1:]))


def test_chained_gap_example(spark):
    rows = [("a", i, t, True) for i, t in enumerate((0, 9, 10, 19, 20))]
    got = sorted(r.t for r in S.chained_gap(frame(spark, rows), ["k"], "t", 10).collect())
    assert got == [0, 10, 20]


def test_chained_gap_of_nothing(spark):
    assert S.chained_gap(frame(spark, []), ["k"], "t", 10).count() == 0


@pytest.mark.parametrize("fan,extent,far", [(4, None, 30), (16, (-5000, 30), 30), (S.FAN, None, 1 << 40)])
def test_tree_of_slice_totals(spark, fan, extent, far):
    """Three levels, numbers below 0, slices without rows, keys of one slice."""
    rnd = random.Random(fan)
    rows = [(rnd.choice(["hot", "hot", "a", "b"]), rnd.randrange(-far, far), i, rnd.choice([None, i]))
            for i in range(400)] + [("one", 0, 999, 5)]
    df = spark.createDataFrame(rows, "k string, s long, n long, v long")
    scanned = S.sliced_scan(df.withColumn("m", F.col("n")), ["k"], "s", ["s", "n"], sums=["m"], lasts=["v"], extent=extent, fan=fan)
    got = {r.n: (r.m, r.v) for r in scanned.collect()}
    for k in {r[0] for r in rows}:
        total, last = 0, None
        for _, _, n, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            total, last = total + n, v if v is not None else last
            assert got[n] == (total, last)


def windows_of(df):
    """Partition keys of every window in the plan."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return [re.findall(r"(\w+)#\d+", w) for w in re.findall(r"^.*?Window \[.*?\], \[(.*?)\], \[", text, re.M)]


def test_no_window_sees_a_whole_key(spark):
    df = frame(spark, [*stamps(9, 50, 0.5, 10 * SEC), ("hot", 99, 10 * 365 * 86400 * SEC, True)])  # ten years on
    counts = S.window_counts(df, "k", "t", {"all": F.lit(True)}, {"n": ("all", SEC)})
    found = S.asof_last(df.filter("not x"), df.filter("x"), ["k"], "t", ["id"], tie="id")
    filled = S.fill_both_ways(df.withColumn("v", F.col("id")), "k", "id", "v", "out")
    for plan, least in ((counts, 3), (found, 3), (filled, 4)):
        seen = windows_of(plan)
        assert len(seen) >= least and all({"_slice", "_b"} & set(w) for w in seen)


@pytest.mark.parametrize("gap,levels", [(SEC, 9), (50 * SEC, 3), (400 * SEC, 0)])
def test_tables_of_a_chain_follow_its_longest_island(spark, monkeypatch, gap, levels):
    """One island as long as the table beside many short ones."""
    rows = [("hot", i, i * SEC // 2, True) for i in range(600)] + [("a", i, i * 600 * SEC, True) for i in range(50)]
    rows += [("a", 700 + i, i * 600 * SEC + 7, True) for i in range(50)] + [("b", 900, -5 * SEC, True), ("b", 901, -4 * SEC, True)]
    written, write = [], S.materialise
    monkeypatch.setattr(S, "materialise", lambda df: (written.append(1), write(df))[1])
    got = {(r.k, r.t) for r in S.chained_gap(frame(spark, rows), ["k"], "t", gap).collect()}
    assert got == kept(rows, gap) and len(written) == (5 + 2 * levels if levels else 3)


@pytest.mark.parametrize("block", [100_000, 25])
def test_rolling_mean(spark, block):
    rows = stamps(7, 400, 0.8, 30 * SEC, SEC)
    df = frame(spark, rows).withColumn("v", F.col("id") * F.col("id"))
    got = {r.id: r.m for r in S.rolling_mean(df, "k", ["t", "id"], "v", 10, "m", block_rows=block).collect()}
    for k in {r[0] for r in rows}:
        seen = [i for _, i in sorted((t, i) for j, i, t, _ in rows if j == k)]
        for n, i in enumerate(seen):
            last = seen[max(0, n - 9): n + 1]
            assert got[i] == pytest.approx(sum(j * j for j in last) / len(last))
    assert len(got) == len(rows)


def test_fill_both_ways(spark):
    rows = [("f", i, v) for i, v in enumerate([None, None, 5, None, 7, None])] + [("g", 0, None), (None, 9, 4)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    for width in (100_000, 2):
        got = {(r.k, r.i): r.o for r in S.fill_both_ways(df, "k", "i", "v", "o", width).collect()}
        assert got.pop((None, 9)) is None
        assert got == {("f", 0): 5, ("f", 1): 5, ("f", 2): 5, ("f", 3): 5, ("f", 4): 7, ("f", 5): 7, ("g", 0): None}


@pytest.mark.parametrize("seed", [8, 9])
def test_exact_quantiles(spark, seed):
    rnd = random.Random(seed)
    data = {
        "spread": [rnd.lognormvariate(3, 2) for _ in range(300)],
        "ties": [float(rnd.choice((0, 0, 0, 5, -3))) for _ in range(301)],
        "tight": [1.0 + rnd.random() * 1e-5 for _ in range(200)],
        "one": [4.0],
    }
    rows = [(g, v) for g, vs in data.items() for v in vs]
    probs = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)
    for steps in (4096, 3, 1):
        check_quantiles(spark, rows, data, probs, steps)


def check_quantiles(spark, rows, data, probs, steps):
    out = S.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", probs, steps).collect()
    assert len(out) == len(data) * len(probs)
    for r in out:
        assert r.quantile == pytest.approx(float(np.quantile(data[r.g], r.prob)), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_take_by_hash(spark, n):
    df = spark.range(n).select(F.col("id"), (F.pmod(F.hash("id").cast("bigint"), F.lit(1 << 32))).alias("h"))
    rows = S.take_by_hash(df, "h", "id", F.floor(F.col("_total") * 0.8)).collect()
    take = int(n * 0.8)
    expected = {i for _, i in sorted((r.h, r.id) for r in rows)[:take]}
    assert {r.id for r in rows if r._taken} == expected and len(rows) == n


def test_take_by_hash_same_bin(spark):
    """Every row in the one bin that holds the cut, in two strata of very different size."""
    df = spark.range(100).select(F.col("id"), F.lit(77).cast("bigint").alias("h"), (F.col("id") < 90).alias("s"))
    rows = S.take_by_hash(df, "h", "id", F.floor(F.col("_total") * 0.5), ["s"]).collect()
    assert {r.id for r in rows if r._taken} == {*range(45), *range(90, 95)}


def test_range_codes(spark):
    words = ["b", "", "aa", "ab", "a", "zebra", "ä"]
    df = spark.createDataFrame([(w,) for w in words], "value string")
    got = {r.value: r.code for r in S.range_codes(df, "value", "code").collect()}
    assert got == {w: i for i, w in enumerate(sorted(words, key=lambda w: w.encode()))}
    assert S.range_codes(df.limit(0), "value", "code").count() == 0


def test_range_codes_of_values_that_begin_alike(spark, monkeypatch):
    written, write = [], S.materialise
    monkeypatch.setattr(S, "materialise", lambda df: (written.append(write(df)), written[-1])[1])
    df = spark.range(100_000).selectExpr("format_string('ET POLICY %d', id * 7919 % 100003) AS value")
    codes = S.range_codes(df, "value", "code")
    wanted = {v: i for i, v in enumerate(sorted(r.value for r in df.collect()))}
    assert {r.value: r.code for r in codes.collect()} == wanted
    pieces = [r["count"] for r in written[-1].groupBy(F.expr("shiftright(_m, 33)")).count().collect()]
    assert len(pieces) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(pieces) < 100_000 / len(pieces) * 1.5
    assert all("_piece" in w or not w for w in windows_of(codes))


def test_slice_of_negative(spark):
    df = spark.createDataFrame([(-11,), (-10,), (-1,), (0,), (9,), (10,)], "t long")
    assert [r[0] for r in df.select(S.slice_of("t", 10)).collect()] == [-2, -1, -1, 0, 0, 1]
    assert [r[0] for r in df.select(S.slice_of(F.col("t"), 10)).collect()] == [-2, -1, -1, 0, 0, 1]
