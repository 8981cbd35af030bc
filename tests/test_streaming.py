"""Streams give what the batch form gives, however the input is cut and after a restart."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import filters as B
from sentrylake.operators import policy
from sentrylake.plans import detect, fixture
from sentrylake.plans.fixture import FIXTURE_PARAMS
from sentrylake.streaming import dedup, evaluation, follow, rates
from sentrylake.streaming.detect import DetectStream

START = 1704067200000000


def chunk(spark, sf, path, first, last):
    part = fixture.events(spark, sf).filter((F.col("t_us") >= START + first * 1_000_000) & (F.col("t_us") < START + last * 1_000_000))
    fixture.as_nested(part).write.mode("append").json(path)


def comparable(df):
    return sorted(tuple(map(str, r)) for r in df.select(*[
        F.round(c, 6) if t == "double" else F.col(c) for c, t in df.dtypes
    ]).collect())


@pytest.fixture(scope="module")
def batch_result(spark, sf):
    return comparable(detect.detect(fixture.staged(spark, sf), fixture.model, FIXTURE_PARAMS))


@pytest.mark.parametrize("cuts", [(0, 520), (0, 130, 131, 520)])
def test_detect_stream_equals_batch(spark, sf, tmp_path, cuts, batch_result):
    """Each chunk is handled by a new object on the same checkpoints, that is, after a restart."""
    landing, work = str(tmp_path / "in"), str(tmp_path / "work")
    for a, b in zip(cuts, cuts[1:]):
        chunk(spark, sf, landing, a, b)
        stream = DetectStream(spark, landing, work, fixture.model, FIXTURE_PARAMS)
        stream.advance()
    stream.finish()
    assert comparable(stream.result()) == batch_result
    assert stream.late().count() == 0


def test_late_rows_within_the_delay(spark, tmp_path):
    """An older late flow does not hide a newer one, a later flow is not found, counts are in time order."""
    landing, work = str(tmp_path / "in"), str(tmp_path / "work")

    def put(*rows):
        flat = spark.createDataFrame([
            (i, START + int(t * 1_000_000), kind, "10.0.0.1", "192.168.38.10", 1, 2, "TCP", kind == "flow", kind == "alert",
             "SYN flood detected" if kind == "alert" else None, n)
            for i, t, kind, n in rows
        ], "event_id long, t_us long, event_type string, src_ip string, dest_ip string, src_port int, dest_port int, proto string, "
           "has_flow boolean, has_alert boolean, signature string, pkts_toserver long").selectExpr(
            "*", "CAST(NULL AS STRING) AS community_id", "CAST(NULL AS LONG) AS flow_id", "t_us AS start_us", "t_us AS end_us",
            "0L AS pkts_toclient", "0L AS bytes_toserver", "0L AS bytes_toclient", "'x' AS category", "1 AS severity", "1 AS signature_id",
            "date_format(timestamp_micros(t_us) + INTERVAL 0 HOURS, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX\") AS timestamp")
        nested = flat.select(
            "event_id", "timestamp", "event_type", "src_ip", "dest_ip", "src_port", "dest_port", "proto", "community_id", "flow_id",
            F.when(F.col("has_flow"), F.struct("pkts_toserver")).alias("flow"),
            F.when(F.col("has_alert"), F.struct("signature", "category", "severity", "signature_id")).alias("alert"))
        nested.write.mode("append").json(landing)
        stream = DetectStream(spark, landing, work, fixture.model, FIXTURE_PARAMS)
        stream.advance()
        return stream

    put((1, 100, "flow", 5), (2, 100.5, "alert", None), (3, 101.5, "alert", None))
    put((4, 98, "alert", None), (5, 97, "flow", 9), (6, 95, "alert", None))
    stream = put((7, 101, "alert", None), (8, 130, "flow", 1))
    stream = put((9, 90, "alert", None))
    stream.finish()
    got = {r.event_id: r for r in stream.result().collect()}
    assert {i: (r.fwd_pkts_tot if r.hit else None) for i, r in got.items()} == {2: 5, 3: 5, 4: 9, 6: None, 7: 5}
    assert {i: r.alerts_count_5s for i, r in got.items()} == {6: 1, 4: 2, 2: 2, 7: 3, 3: 4}
    assert [r.event_id for r in stream.late().collect()] == [9]


def test_dedup_stream(spark, sf, tmp_path):
    landing, work = str(tmp_path / "in"), str(tmp_path / "work")
    for a, b in ((0, 200), (200, 210), (210, 520)):
        chunk(spark, sf, landing, a, b)
        stream = dedup.DedupStream(spark, landing, work, FIXTURE_PARAMS)
        stream.advance()
    stream.finish()
    batch = policy.dedup_notifications(B.admit_alerts(fixture.alerts(spark, sf), FIXTURE_PARAMS))
    got = stream.result()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(*got.columns).collect()))


def test_an_ended_stream_stays_ended_and_old_state_goes(spark, sf, tmp_path):
    landing, work = str(tmp_path / "in"), str(tmp_path / "work")
    for a, b in ((0, 100), (100, 200), (200, 300), (300, 520)):
        chunk(spark, sf, landing, a, b)
        stream = dedup.DedupStream(spark, landing, work, FIXTURE_PARAMS)
        stream.advance()
    kept = {kind: sorted(p.name for p in (tmp_path / "work" / kind).iterdir()) for kind in ("mark", "seen", "state/pending", "state/sent")}
    assert all(names == ["000000002", "000000003"] for names in kept.values())
    stream.finish()
    rows = comparable(stream.result())
    stream.finish()
    assert comparable(stream.result()) == rows
    with pytest.raises(ValueError):
        dedup.DedupStream(spark, landing, work, FIXTURE_PARAMS).advance()


def plain_rates(rows, size, stride):
    out: dict = {}
    for t, ip, kind in rows:
        for w in range(t // stride * stride, t - size, -stride):
            n = out.setdefault((w, ip), [0, 0])
            n[kind == "alert"] += 1
    return [(w, ip, *n) for (w, ip), n in out.items()]


@pytest.mark.parametrize("length,step,size,stride", [
    ("10 seconds", "1 second", 10, 1), ("10 seconds", "4 seconds", 10, 4), ("5 seconds", "5 seconds", 5, 5), ("3 minutes", "1 minute", 180, 60)])
def test_windowed_rates_by_hand(spark, length, step, size, stride):
    rnd = random.Random(size)
    us = 1_000_000
    rows = [(rnd.randrange(-200 * us, 900 * us), rnd.choice(["hot", "hot", "b", None]), rnd.choice(["flow", "alert", "dns"])) for _ in range(700)]
    rows += [(0, "edge", "flow"), (60 * us, "edge", "flow"), (60 * us - 1, "edge", "alert")]
    df = spark.createDataFrame([*rows, (None, "x", "flow")], "t_us long, src_ip string, event_type string")
    got = sorted(map(tuple, rates.windowed_source_rates(df, length, step).collect()), key=str)
    assert got == sorted(plain_rates([r for r in rows if r[2] != "dns"], size * us, stride * us), key=str)


def test_windowed_rates_shuffle_panes(spark, sf):
    """Before the first exchange an event stays one row; after it a pane is in two blocks at the most."""
    plan = rates.windowed_source_rates(fixture.events(spark, sf))._jdf.queryExecution().executedPlan().toString()
    expand = re.findall(r"Expand \[(.*)\], \[", plan)
    assert len(expand) == 1 and expand[0].count("], [") + 1 == 2
    assert plan.index("Expand") < plan.index("window", plan.index("Exchange hashpartitioning", plan.index("Expand")))


def test_windowed_rates_stream(spark, sf, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    for first, last in ((0, 200), (200, 210), (210, 520)):
        chunk(spark, sf, landing, first, last)
        counts = rates.windowed_source_rates(follow.follow_events(spark, landing))
        follow.drain(counts.writeStream.format("parquet").option("path", out).outputMode("append")
                     .option("checkpointLocation", str(tmp_path / "state")))
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    batch = sorted(map(tuple, rates.windowed_source_rates(fixture.events(spark, sf)).collect()))
    final = (START // 1_000_000 + 420) * 1_000_000  # whole blocks that the watermark has passed
    assert [r for r in got if r[0] < final] == [r for r in batch if r[0] < final] and len(got) > 100
    assert set(got) <= set(batch)


def test_eval_stream(spark, sf, tmp_path):
    landing = str(tmp_path / "in")
    chunk(spark, sf, landing, 0, 520)
    follow.drain(evaluation.write_eval_stream(
        follow.follow_events(spark, landing), str(tmp_path / "out"), str(tmp_path / "state"),
        fixture.attackers(spark), fixture.windows(spark)))
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == fixture.flows(spark, sf).count()
    assert set(r[0] for r in rows.select("auto_label").distinct().collect()) <= {"benign", "attacker_window"}


def test_rows_without_time_are_kept_aside(spark, sf, tmp_path):
    landing, work = str(tmp_path / "in"), str(tmp_path / "work")
    part = fixture.as_nested(fixture.events(spark, sf).limit(3))
    part.withColumn("timestamp", F.lit("no time")).write.mode("append").json(landing)
    stream = DetectStream(spark, landing, work, fixture.model, FIXTURE_PARAMS)
    stream.advance()
    assert stream.untimed().count() == 3 and stream.late().count() == 0
