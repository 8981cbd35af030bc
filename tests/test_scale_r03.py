"""Steps that repeated work or left it to the JVM's interpreter: each test fails on the code before round 3's findings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import models, scan
from sentrylake.plans import catalog, fixture
from sentrylake.sources import tables
from sentrylake.streaming import carry, dedup

_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_materialise_leaves_no_stage_to_the_interpreter(spark, monkeypatch):
    seen, before = [], spark.conf.get(_LIMIT)
    kind = type(spark.range(1).write)
    write = kind.parquet
    monkeypatch.setattr(kind, "parquet", lambda self, path: (seen.append(int(spark.conf.get(_LIMIT))), write(self, path))[1])
    assert scan.materialise(spark.range(5)).count() == 5
    assert seen == [scan.JIT_BYTES] and spark.conf.get(_LIMIT) == before
    with pytest.raises(Exception):
        scan.materialise(spark.range(1).select(F.raise_error(F.lit("x"))))
    assert spark.conf.get(_LIMIT) == before


def test_events_divide_by_whole_numbers(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, u, "view", 1.5, '{"k": 3}') for i, u in enumerate([0, 249, 250, 62499, 62500, 125001, -1, -62501, None])],
        "event_id long, user_id long, event_type string, value double, props string",
    ).withColumn("ts", F.expr("timestampadd(MICROSECOND, event_id * 4999, TIMESTAMP_NTZ'2023-12-31 23:59:59.99')"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = fixture.raw_events(spark, str(tmp_path))
    assert "62500.0" not in plan(got) and "5000.0" not in plan(got)
    net, sub = "CAST(FLOOR(user_id/62500.0) AS BIGINT)", "CAST(FLOOR(user_id/250.0) AS BIGINT)"
    us = fixture.SPARK_MACROS["EPOCH_US"]
    want = spark.read.parquet(str(tmp_path / "events.parquet")).selectExpr(
        "event_id", f"CAST(FLOOR(({us} - 1704067200000000) / 5000.0) AS BIGINT) + 1704067200000000 AS t_us",
        f"CONCAT('10.', CAST({net} AS STRING), '.', CAST({sub} % 250 AS STRING), '.', CAST(user_id % 250 + 1 AS STRING)) AS src_ip")
    assert sorted(map(tuple, got.select("event_id", "t_us", "src_ip").collect())) == sorted(map(tuple, want.collect()))


def test_data_set_is_decided_once_for_both_writes(spark, sf, monkeypatch):
    written, real = [], tables.batch_writer
    monkeypatch.setattr(tables, "batch_writer", lambda path: lambda rows, n: (written.append(plan(rows)), real(path)(rows, n)))
    assert catalog._training_rows(spark, sf).count() > 0
    assert len(written) == 2 and not any("Join" in p for p in written)


def test_commands_come_from_the_staged_events(spark, sf, monkeypatch):
    plans = []

    class Stop(Exception):
        pass

    def note(rows, path, number, chunks=3):
        plans.append(plan(rows))
        if len(plans) == 2:
            raise Stop

    monkeypatch.setattr(fixture, "write_rows_chunk", note)
    with pytest.raises(Stop):
        catalog._block_stream(spark, sf, True)
    assert "get_json_object" not in plans[1]


def test_stream_parses_its_input_once(spark, sf, tmp_path, monkeypatch):
    plans, real = [], carry.with_event_id
    monkeypatch.setattr(carry, "with_event_id", lambda df, n: (plans.append(plan(df)), real(df, n))[1])
    landing = fixture.write_chunks(spark, sf, str(tmp_path / "in"), 1)
    dedup.DedupStream(spark, landing, str(tmp_path / "work")).advance()
    assert plans and all("Relation" in p and "parquet" in p for p in plans)


def test_models_are_asked_once_a_row(spark, monkeypatch):
    alerts = spark.range(4).selectExpr("id AS event_id", "'a' AS timestamp")
    monkeypatch.setattr(models, "runtime_features_from_dataset", lambda df, keep: df.select(*keep))
    monkeypatch.setattr(models, "score_detector", lambda df, d: df.withColumns(
        {"action": (F.rand(1) < 2).cast("int"), "confidence": F.lit(0.8)}))
    out = models.as_model(None)(alerts)
    assert "rand" not in plan(out) and out.columns == ["event_id", "timestamp", "action", "confidence"] and out.count() == 4
