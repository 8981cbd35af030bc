from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sentrylake.operators import columns as C
from sentrylake.plans import fixture
from sentrylake.schema import AGGREGATE_COLUMNS, DATASET_COLUMNS, EVAL_COLUMNS, LOG_COLUMNS
from sentrylake.sources import eve, flow_csv, tables

GOOD = {"timestamp": "2025-10-17T23:30:00.000000+0700", "event_type": "alert", "src_ip": "10.0.0.5", "dst_ip": "192.168.38.10",
        "src_port": 1, "dst_port": 22, "proto": "TCP", "flow": {"fwd_pkts_tot": 3, "start": "2025-10-17T23:29:58+0700"},
        "alert": {"signature": "ET SCAN", "category": "x", "severity": 1}}


def test_json_lines(spark, tmp_path):
    lines = [json.dumps(GOOD), "", "{broken", "[]", json.dumps({"event_type": "flow", "src_port": "not a number"}), "   "]
    (tmp_path / "eve.json").write_text("\n".join(lines))
    raw = eve.with_event_id(eve.read_eve_json(spark, str(tmp_path / "eve.json")))
    rows = sorted(C.normalise_event(raw).collect(), key=lambda r: r.event_type)
    assert [r.event_type for r in rows] == ["alert", "flow"]  # one odd field does not lose its record
    a = rows[0]
    assert (a.dest_ip, a.dest_port, a.t_us, a.start_us) == ("192.168.38.10", 22, 1760718600000000, 1760718598000000)
    assert (a.pkts_toserver, a.fwd_pkts_tot) == (None, 3)  # each path chooses between them
    assert a.ts_local.hour == 23 and a.has_alert and a.log_file.endswith("eve.json")
    assert rows[1].src_port is None and rows[1].src_ip is None and not rows[1].has_flow
    assert rows[0].event_id != rows[1].event_id
    again = eve.with_event_id(eve.read_eve_json(spark, str(tmp_path / "eve.json")).repartition(3))
    assert {r.event_id for r in again.collect()} == {r.event_id for r in rows}
    twice = eve.with_event_id(eve.read_eve_json(spark, [str(tmp_path / "eve.json")] * 2))
    assert len({r.event_id for r in twice.collect()}) == 4 and all(r.event_id < 0 for r in twice.collect())
    text = spark.createDataFrame([(i, ln) for i, ln in enumerate(lines)], "n int, value string")
    assert sorted(r.n for r in eve.parse_eve_text(text).collect()) == [0, 4]


def test_dated_file(spark, tmp_path):
    (tmp_path / "eve.json").write_text(json.dumps(GOOD))
    pattern = str(tmp_path / "eve-%Y-%m-%d.json")
    assert eve.read_dated_json(spark, pattern, date(2025, 1, 1), str(tmp_path / "eve.json")).count() == 1
    (tmp_path / "eve-2025-01-01.json").write_text(json.dumps(GOOD) + "\n" + json.dumps(GOOD))
    assert eve.read_dated_json(spark, pattern, date(2025, 1, 1), str(tmp_path / "eve.json")).count() == 2
    with pytest.raises(AnalysisException):
        eve.read_dated_json(spark, pattern, date(2025, 1, 2))


def test_daily_table_prunes(spark, sf, tmp_path):
    eve.write_daily(fixture.raw_events(spark, sf), str(tmp_path / "t"), "orig_us")
    days = eve.read_daily(spark, str(tmp_path / "t"), "2024-01-03")
    assert {str(r.event_date) for r in days.select("event_date").distinct().collect()} == {"2024-01-03"}
    assert "PartitionFilters: [isnotnull(event_date" in days._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("d", [",", ";", "\t", "|"])
def test_untidy_csv(spark, tmp_path, d):
    lines = [["a", "sig", "c"], ["1", f'"x{d}y"', "NA"], ["2", "", ""], ["3", "short"], ["4", "too", "many", "fields"],
             ["5", '"q\\"uote"', "z"], ["6", "too", "many", "fields", "here"]]
    (tmp_path / "f.csv").write_text("\n".join(d.join(x) for x in lines) + "\n")
    rows = [tuple(r) for r in flow_csv.read_flow_csv(spark, str(tmp_path / "f.csv")).collect()]
    assert rows == [("1", f"x{d}y", "NA"), ("2", "", ""), ("3", "short", ""), ("5", 'q"uote', "z")]


def test_csv_files_with_different_column_orders(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("a;b;c\n1;2;x,y,z\n" * 1 + "3;4;q,r,s\n" * 30)
    (tmp_path / "t" / "b.csv").write_text("\nb;a\n8;7\n")
    got = {tuple(r) for r in flow_csv.read_flow_csv(spark, str(tmp_path / "t")).select("a", "b", "c").collect()}
    assert got == {("1", "2", "x,y,z"), ("3", "4", "q,r,s"), ("7", "8", "")}


ODD_LINES = [
    'a;b;c', '1;"two', 'lines";x', '', '2;"one";y', '3;"a', '', '";"b', 'c"', '4;5" disk;z', '5;"esc \\" aped;', 'on";w', '6;"x";"y;', ';z"',
    '7;"ends', 'here"', '8;9;0;too;many', '9;plain;end',
]


def plain_records(text):
    """One character after the other; a quote opens at the begin of a field only."""
    rows, field, row, quoted, at = [], "", [], False, 0
    while at < len(text):
        c = text[at]
        if quoted and c == "\\" and at + 1 < len(text):
            at += 1
            field += text[at] if text[at] == '"' else "\\" + text[at]
        elif c == '"' and (quoted or field == ""):
            quoted = not quoted
        elif c in ";\n" and not quoted:
            row.append(field)
            field = ""
            if c == "\n":
                rows, row = [*rows, row], []
        else:
            field += c
        at += 1
    return [tuple((r + [""] * 3)[:3]) for r in rows[1:] if len(r) <= 3 and r != [""]]


def small_splits(spark, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    return before


@pytest.mark.parametrize("split", [1 << 27, 64])
def test_quoted_line_breaks(spark, tmp_path, split):
    (tmp_path / "t").mkdir()
    text = "\n".join([*ODD_LINES, *ODD_LINES[1:] * 20]) + "\n"
    (tmp_path / "t" / "a.csv").write_text(text)
    (tmp_path / "t" / "b.csv").write_text("c;a\n\"p\nq\";r\n")
    before = small_splits(spark, split)
    try:
        rows = flow_csv.read_flow_csv(spark, str(tmp_path / "t"), ";").select("a", "b", "c").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, rows)) == sorted([*plain_records(text), ("r", "", "p\nq")])


def test_a_quote_that_is_never_closed(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a;b\n1;"x\ny"\n2;"open\n3;z\n')
    rows = {tuple(r) for r in flow_csv.read_flow_csv(spark, str(tmp_path / "f.csv"), ";").collect()}
    assert {("1", "x\ny"), ("3", "z")} <= rows and len(rows) == 3


def test_empty_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("")
    with pytest.raises(ValueError):
        flow_csv.read_flow_csv(spark, str(tmp_path / "f.csv"))


def test_dataset_rows(spark):
    df = spark.createDataFrame(
        [("a\r\nb", "7", 0.5, "x", None, ["flow", "alert"]), (None, "bad", 0.5, "2", "auto", None)],
        "signature string, action string, confidence float, y_attack string, y_reason string, label_sources array<string>",
    ).withColumns({c: F.lit(1.0) for c in DATASET_COLUMNS if c.endswith(("_tot", "_sec", "ratio", "duration"))} | {"timestamp": F.lit("t")})
    out = tables.dataset_rows(df)
    assert out.columns == [*DATASET_COLUMNS, *AGGREGATE_COLUMNS]
    a, b = out.collect()
    assert (a.signature, a.action, a.y_attack, a.y_reason, a.label_sources) == ("a  b", 7, 0, "", "alert;flow")
    assert (b.signature, b.action, b.y_attack, b.y_reason, b.label_sources) == ("", 0, 1, "auto", "")
    assert (a.proto, a.direction, a.status, a.bwd_header_size_max) == ("unknown", "inbound", "detected", 0.0)


def test_append_and_batch_writer(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01")], "x int, event_date string")
    for _ in range(2):
        tables.append_table(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2
    write = tables.batch_writer(str(tmp_path / "b"))
    for batch in (0, 1, 1):  # a repeated batch replaces itself
        write(df, batch)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2


def test_row_shapes(spark, sf):
    ev = fixture.events(spark, sf)
    assert tables.eval_rows(ev).columns == list(EVAL_COLUMNS)
    assert tables.alert_log(fixture.alerts(spark, sf)).columns == list(LOG_COLUMNS)
