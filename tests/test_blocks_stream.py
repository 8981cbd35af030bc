"""Blocks on streams: equal to the table's, however rows arrive; released by time; no state left."""

from __future__ import annotations

import random

import pytest

from sentrylake.operators import policy
from sentrylake.streaming import blocks as X

S = 1_000_000


def plain(requests, commands, length, upto):
    """(ip, block, unblock) of all blocks opened by rows up to ``upto``, one row after the other."""
    out = {}
    rows = [(t, 0, ip) for ip, t in commands] + [(t, 1, ip) for ip, t, *_ in requests]
    for t, kind, ip in sorted(r for r in rows if r[0] <= upto):
        mine = out.setdefault(ip, [])
        blocked = mine and t < mine[-1][1]
        if kind == 0 and blocked and t > mine[-1][0]:
            mine[-1][1] = t
        if kind == 1 and not blocked:
            mine.append([t, t + length])
    return sorted((ip, a, b) for ip, found in out.items() for a, b in found)


class Feed:
    def __init__(self, spark, path, with_commands=True, length=60 * S):
        self.spark, self.path, self.length, self.with_commands = spark, path, length, with_commands

    def put(self, requests, commands=()):
        if requests:
            rows = [(ip, t, "r", 0.5, i) for ip, t, i in requests]
            self.spark.createDataFrame(rows, "ip string, t_us long, reason string, confidence double, event_id long").coalesce(2).write.mode("append").parquet(f"{self.path}/requests")
        if commands:
            self.spark.createDataFrame(list(commands), "ip string, t_us long").coalesce(1).write.mode("append").parquet(f"{self.path}/commands")
        read = lambda name, schema: self.spark.readStream.schema(schema).parquet(f"{self.path}/{name}")
        requests = read("requests", "ip string, t_us long, reason string, confidence double, event_id long")
        commands = read("commands", "ip string, t_us long") if self.with_commands else None
        X.write_blocks(X.block_events(requests, commands, self.length), f"{self.path}/out", f"{self.path}/state")
        return self

    def rows(self):
        return sorted((r.ip, r.block_us, r.unblock_us, r.released) for r in self.spark.read.parquet(f"{self.path}/out").collect())

    def state(self, name):
        return self.spark.read.format("statestore").option("stateVarName", name).load(f"{self.path}/state").count()


def test_follow_blocks_by_hand():
    r = lambda *ts: [(t, "r", 0.5, t) for t in ts]
    short = lambda found: [x[:3] for x in found[0]]
    assert X.follow_blocks(None, [], [], 100, 10) == ([], None)
    assert short(X.follow_blocks(None, r(1, 5, 11, 12), [], 30, 10)) == [(1, 11, False), (1, 11, True), (11, 21, False), (11, 21, True)]
    found, block = X.follow_blocks(None, r(1, 5), [], 10, 10)
    assert [x[:3] for x in found] == [(1, 11, False)] and block[:2] == (1, 11)
    assert X.follow_blocks(block, r(12), [], 12, 10)[0][0][:3] == (1, 11, True)
    # before, at, inside, at a request's instant, after
    assert short(X.follow_blocks(None, r(3, 4), [1], 20, 10)) == [(3, 13, False), (3, 13, True)]
    assert short(X.follow_blocks(None, r(3, 4), [3], 20, 10)) == [(3, 13, False), (3, 13, True)]
    assert short(X.follow_blocks(None, r(3, 4, 6), [5], 20, 10)) == [(3, 13, False), (3, 5, True), (6, 16, False), (6, 16, True)]
    assert short(X.follow_blocks(None, r(3, 4), [4], 20, 10)) == [(3, 13, False), (3, 4, True), (4, 14, False), (4, 14, True)]


def test_commands_before_with_and_after_their_block(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    feed.put([("b", 100 * S, 3), ("a", 100 * S, 1), ("a", 110 * S, 2)], [("a", 95 * S), ("b", 105 * S)])
    feed.put([("c", 120 * S, 4), ("b", 106 * S, 9)], [("c", 130 * S), ("a", 112 * S)])
    feed.put([("a", 113 * S, 5), ("z", 300 * S, 6)], [("a", 113 * S), ("z", 300 * S)])
    assert feed.rows() == [
        ("a", 100 * S, 112 * S, True), ("a", 100 * S, 160 * S, False), ("a", 113 * S, 173 * S, False), ("a", 113 * S, 173 * S, True),
        ("b", 100 * S, 105 * S, True), ("b", 100 * S, 160 * S, False), ("b", 106 * S, 166 * S, False), ("b", 106 * S, 166 * S, True),
        ("c", 120 * S, 130 * S, True), ("c", 120 * S, 180 * S, False)]
    assert feed.state("block") == 0 and feed.state("pending") <= 2  # what waits of z alone


def test_the_slower_input_holds_the_watermark(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    feed.put([("a", 100 * S, 1), ("z", 900 * S, 2)], [("z", 50 * S)])
    assert feed.rows() == []
    feed.put([("z", 901 * S, 3)], [("a", 130 * S), ("z", 145 * S)])
    assert feed.rows() == [("a", 100 * S, 130 * S, True), ("a", 100 * S, 160 * S, False)]


def test_late_rows_and_restart_without_commands(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), with_commands=False)
    feed.put([("a", 10 * S, 1), ("a", 40 * S, 2), ("b", 45 * S, 8)])
    assert feed.rows() == [("a", 10 * S, 70 * S, False)]
    feed.put([("a", 20 * S, 3), ("b", 36 * S, 4), ("a", 75 * S, 5)])  # 20 s is late, 36 s is not
    assert feed.rows() == [("a", 10 * S, 70 * S, False), ("b", 36 * S, 96 * S, False)]
    assert feed.state("block") == 2
    feed.put([("q", 400 * S, 7)])
    assert feed.rows() == [
        ("a", 10 * S, 70 * S, False), ("a", 10 * S, 70 * S, True), ("a", 75 * S, 135 * S, False), ("a", 75 * S, 135 * S, True),
        ("b", 36 * S, 96 * S, False), ("b", 36 * S, 96 * S, True)]
    assert feed.state("block") == 0
    again = feed.rows()
    assert feed.put([]).rows() == again
    assert [tuple(r) for r in X.active_at(spark.read.parquet(f"{tmp_path}/out"), 50 * S).orderBy("ip").collect()] == [
        ("a", 10 * S, 70 * S), ("b", 36 * S, 96 * S)]


@pytest.mark.parametrize("chunks,length", [(1, 7 * S), (4, 7 * S), (4, 500 * S)])
def test_any_order_equals_the_table(spark, tmp_path, chunks, length):
    """A hot address, ties, repeated rows; rows arrive out of order within the delay."""
    rng, start = random.Random(chunks), 1_704_067_200 * S
    at = lambda: start + rng.randrange(0, 200 * S, S // 4)
    requests = [(rng.choice(["hot", "hot", "x", "y"]), at(), i) for i in range(1500)]
    requests += requests[:50]
    commands = [(rng.choice(["hot", "x", "none"]), at()) for _ in range(40)]
    requests.append(("end", start + 200 * S, 5000))
    commands.append(("end", start + 200 * S))
    feed, span = Feed(spark, str(tmp_path), length=length), 200 * S // chunks + 1
    # rows come with the chunk of an earlier time or their own, so that none is later than the delay
    place = lambda t: min(chunks - 1, max(0, t - start - rng.randrange(0, 4 * S)) // span)
    dealt = [(place(r[1]), r) for r in requests], [(place(c[1]), c) for c in commands]
    for n in range(chunks):
        feed.put([r for k, r in dealt[0] if k == n], [c for k, c in dealt[1] if k == n])
    upto = start + 190 * S
    want = plain(requests, commands, length, upto)
    known = feed.rows()
    assert [r[:2] for r in known if not r[3]] == [w[:2] for w in want if w[1] <= upto]
    assert [r[:3] for r in known if r[3]] == [w for w in want if w[2] <= upto]
    table = spark.createDataFrame([(ip, t, i, True, "r", 0.5) for ip, t, i in requests], "src_ip string, t_us long, event_id long, should_block boolean, reason string, confidence double")
    batch = policy.block_intervals(table, length, commands=spark.createDataFrame(commands, "ip string, t_us long"))
    ended = sorted(tuple(r) for r in batch.select("ip", "block_us", "unblock_us", "event_id").filter(f"unblock_us <= {upto}").collect())
    out = spark.read.parquet(f"{tmp_path}/out").filter("released").select("ip", "block_us", "unblock_us", "event_id")
    assert sorted(map(tuple, out.collect())) == ended


def test_folding_keeps_every_instant(spark):
    import pandas as pd

    pdf = pd.DataFrame({"ip": ["a"] * 5, "kind": 1, "t_us": [5, 3, 3, 1_000_001, 5], "reason": "r", "confidence": 0.1, "event_id": [4, 9, 2, 7, 1]})
    (out,) = X._fold(iter([pdf]))
    assert out[["times", "ids", "last_us"]].values.tolist() == [[[3, 5], [2, 1], 5], [[1_000_001], [7], 1_000_001]]
