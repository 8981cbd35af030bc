"""Physical plans: pushed filters, pruned columns, shared shuffles, no driver-side or quadratic steps."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sentrylake.operators import filters as B
from sentrylake.operators import joins as J
from sentrylake.operators import scan, windows
from sentrylake.plans import detect, fixture
from sentrylake.plans.fixture import FIXTURE_PARAMS


def plan(df, run=False):
    if run:
        df.write.format("noop").mode("overwrite").save()
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_has_no_cross_join_and_no_single_partition(spark, sf):
    text = plan(detect.decisions(fixture.staged(spark, sf), fixture.model, FIXTURE_PARAMS))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text
    assert "Python" not in text  # everything stays in the JVM


def test_filters_reach_the_scan(spark, sf):
    alerts = B.admit_alerts(fixture.staged(spark, sf).filter("event_type = 'alert'"), FIXTURE_PARAMS).select("event_id")
    text = plan(alerts)
    assert "EqualTo(event_type,alert)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"event_id", "event_type", "dest_ip", "signature"}


def test_rate_windows_share_one_shuffle(spark, sf):
    flows, alerts = B.split_events(fixture.staged(spark, sf))
    text = plan(windows.source_counts(flows, alerts, FIXTURE_PARAMS), run=True).split("Initial Plan")[0]
    scans = len(re.findall(r"FileScan", text))
    assert scans == 2 and "ReusedExchange" in text  # one per kind of event, for all five frames
    assert len(re.findall(r"Window \[", text)) == 2  # inside the slices, and over slice totals


def test_asof_shuffles_flows_once(spark, sf):
    flows, alerts = B.split_events(fixture.staged(spark, sf))
    text = plan(J.asof_flow_features(alerts, flows, FIXTURE_PARAMS), run=True).split("Initial Plan")[0]
    assert len(re.findall("ReusedExchange", text)) >= 2


def test_windows_never_span_a_whole_key_of_rows(spark, sf):
    """Row-level windows are partitioned by (key, slice); whole keys are windowed only as slice totals."""
    flows, alerts = B.split_events(fixture.staged(spark, sf))
    text = plan(J.asof_flow_features(alerts, flows, FIXTURE_PARAMS))
    row_level = [w for w in re.findall(r"windowspecdefinition\(([^)]*)\)?", text) if "t_us" in w]
    assert row_level and all("_slice" in w for w in row_level)


def test_attack_windows_use_an_equi_join(spark, sf):
    many = spark.range(100_000).select((F.col("id") * 10).alias("start_s"), (F.col("id") * 10 + 3).alias("end_s"))
    text = plan(J.attack_flags(fixture.staged(spark, sf), None, many))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_split_needs_no_global_sort(spark, sf):
    df = scan.materialise(fixture.raw_events(spark, sf).select("event_id"))
    from sentrylake.operators.prep import train_val_split
    assert "rangepartitioning" not in plan(train_val_split(df))
