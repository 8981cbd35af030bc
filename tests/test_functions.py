"""Edge tables of the column expressions; expected values worked out by hand."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from sentrylake.functions import labels as L
from sentrylake.functions import net, numeric, text, times
from sentrylake.functions.flow import with_flow_features
from sentrylake.operators import columns as C
from sentrylake.operators import profile


def one(spark, col, **values):
    """Evaluates ``col`` over one row of text/number values."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"`{k}` {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()
    )) if values else spark.range(1)
    return df.select(col.alias("x")).first()[0]


@pytest.mark.parametrize("value,expected", [
    ("abc", 0.0), ("NaN", 0.0), ("inf", 0.0), ("-Infinity", 0.0), ("1e13", 1e12), ("-1e13", -1e12), (None, 0.0),
    (" 7.5 ", 7.5), ("3d", 0.0), ("2f", 0.0), ("", 0.0),
])
def test_safe_num(spark, value, expected):
    assert one(spark, numeric.safe_num("v", text=True), v=value) == expected


def test_safe_ratio(spark):
    df = spark.createDataFrame([(6, 3), (5, 0), (None, 2), (4, None)], "a int, b int")
    got = [r[0] for r in df.select(numeric.safe_ratio(F.col("a"), F.col("b"), -1.0)).collect()]
    assert got == [2.0, -1.0, -1.0, -1.0]


def test_unit_interval(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (0.4,), (7.0,), (-1.0,), (None,)], "v double")
    assert [r[0] for r in df.select(numeric.unit_interval(F.col("v"))).collect()] == [0.0, 1.0, 0.0, 0.4, 1.0, 0.0, 0.0]


def test_conform_vector(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    row = df.select(numeric.conform_vector("v", 4), numeric.conform_vector("v", 1)).first()
    assert row[0] == [1.0, 2.0, 0.0, 0.0] and row[1] == [1.0]


@pytest.mark.parametrize("stamp,hour,day,micros", [
    ("2025-10-17T23:30:00.000000+0700", 23, 4, 1760718600000000),
    ("2025-10-17T23:30:00+07:00", 23, 4, 1760718600000000),
    ("2025-10-17T16:30:00Z", 16, 4, 1760718600000000),
    ("2025-10-17T16:30:00", 16, 4, 1760718600000000),
    ("2025-10-19 01:00:00.5", 1, 6, 1760835600500000),
    ("2025-10-17", 0, 4, 1760659200000000),
    ("garbage", 0, 0, None),
    (None, 0, 0, None),
])
def test_times(spark, stamp, hour, day, micros):
    local = times.parse_local("s")
    df = spark.createDataFrame([(stamp,)], "s string")
    row = df.select(times.hour_of(local), times.weekday_of(local), times.parse_micros("s"), times.parse_epoch("s")).first()
    assert tuple(row) == (hour, day, micros, (micros or 0) // 1_000_000)


def test_ntz_round_trip(spark):
    df = spark.createDataFrame([(1704067200123456,)], "t long")
    row = df.select(times.micros_to_ntz("t").alias("n")).select("n", times.ntz_micros("n")).first()
    assert row[0] == dt.datetime(2024, 1, 1, 0, 0, 0, 123456) and row[1] == 1704067200123456


def test_cyclic(spark):
    s, c = times.cyclic("h", 24)
    row = spark.createDataFrame([(6,)], "h int").select(s, c).first()
    assert row[0] == pytest.approx(1.0) and row[1] == pytest.approx(0.0, abs=1e-12)


def test_parse_windows(spark):
    table = spark.createDataFrame([
        ("1697535600", "1697535660"),
        ("2025-10-14T17:58:38Z", "2025-10-14T17:59:00Z"),
        ("2025-10-14 17:58:38", "2025-10-14T10:59:00Z"),  # naive is local: 10:58:38Z
        ("10", "9"), ("x", "10"), ("7", "7"),
    ], "start string, end string")
    got = sorted(tuple(r) for r in times.parse_windows(table, "Asia/Jakarta").collect())
    assert got == [(7, 7), (1697535600, 1697535660), (1760439518, 1760439540), (1760464718, 1760464740)]


@pytest.mark.parametrize("sig", [None, "", "  ", "ET SCAN", "sígn 漢字"])
def test_signature_features(spark, sig):
    s = (sig or "").strip()
    expected = (len(s), int(hashlib.sha256(s.encode()).hexdigest()[:8], 16) % 1000 if s else 0)
    row = spark.createDataFrame([(sig,)], "s string").select(text.signature_length("s"), text.signature_hash("s")).first()
    assert tuple(row) == expected


def test_ip_hash(spark):
    expected = int(hashlib.sha256(b"10.0.0.9").hexdigest()[:8], 16) % 10000
    assert one(spark, text.ip_hash("s"), s="10.0.0.9") == expected


def test_text_cleaning(spark):
    assert one(spark, text.clean_text("s"), s="a\r\nb") == "a  b"
    assert one(spark, text.join_list(F.array(F.lit("flow"), F.lit("alert")))) == "alert;flow"
    assert one(spark, text.first_truthy("a", "b", empty=""), a="", b="x") == "x"
    assert one(spark, text.first_present("a", "b"), a="", b="x") == ""


def test_contains_any_ignores_implied_words(spark):
    words = ("scan", "portscan", "nmap")
    for s, expected in (("a portscan", True), ("Nmap", False), ("nmap", True), ("", False), (None, False)):
        assert one(spark, text.contains_any(F.col("s"), words), s=s) is expected
    assert one(spark, text.contains_any(F.col("s"), ()), s="x") is False


@pytest.mark.parametrize("ip,inside", [
    ("192.168.38.0", True), ("192.168.38.255", True), ("192.168.39.0", False), ("192.168.37.255", False),
    ("::1", False), ("x", False), (None, False), ("192.168.38.256", False), ("192.168.038.1", False), ("1.2.3", False),
])
def test_in_network(spark, ip, inside):
    assert one(spark, net.in_network("ip", "192.168.38.0/24"), ip=ip) is inside


def test_in_network_other_cases(spark):
    assert one(spark, net.in_network("ip", "192.168.38.77/24"), ip="192.168.38.1") is True
    assert one(spark, net.in_network("ip", "not a net"), ip="192.168.38.1") is False
    df = spark.createDataFrame([("2001:db8::5",), ("2001:db9::5",), ("10.0.0.1",), ("::x",), (None,)], "ip string")
    got = [r[0] for r in df.select(net.in_network("ip", "2001:db8::/32")).collect()]
    assert got == [True, False, False, False, False]


def test_proto_flags(spark):
    df = spark.createDataFrame([("TCP",), ("udp",), ("IPv6-ICMP",), ("icmpv6",), (None,), ("sctp",)], "p string")
    flags = net.proto_flags("p")
    got = [tuple(r) for r in df.select(*flags.values()).collect()]
    assert got == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 1), (0, 0, 0), (0, 0, 0)]


FLOW = "t_us long, start_us long, end_us long, pkts_toserver long, pkts_toclient long, bytes_toserver long, bytes_toclient long"


@pytest.mark.parametrize("mode,ratio", [("live", 0.0), ("eval", 5.0), ("vector", 999.0)])
def test_ratio_modes(spark, mode, ratio):
    df = spark.createDataFrame([(10, 0, 2_000_000, 0, 5, 7, 8)], FLOW)
    row = with_flow_features(df, mode).first()
    assert (row.down_up_ratio, row.flow_duration, row.bwd_pkts_per_sec) == (ratio, 2.0, 2.5)
    assert (row.fwd_data_pkts_tot, row.bwd_data_pkts_tot) == (7, 8)


@pytest.mark.parametrize("mode", ["live", "eval", "vector"])
def test_flow_edges(spark, mode):
    df = spark.createDataFrame([
        (10, 5_000_000, 1_000_000, 4, 2, 0, 0),     # end before start
        (10, None, None, 4, 2, 0, 0),               # both bounds from the event time
        (3_000_000, 1_000_000, None, 4, 2, 0, 0),   # end from the event time
        (None, None, None, None, None, None, None),
    ], FLOW)
    got = [(r.flow_duration, r.flow_pkts_per_sec, r.down_up_ratio) for r in with_flow_features(df, mode).collect()]
    assert got == [(0.0, 6.0, 0.5), (0.0, 6.0, 0.5), (2.0, 3.0, 0.5), (0.0, 0.0, 0.0)]


def test_flow_key_preference(spark):
    cols = FLOW + ", fwd_pkts_tot long, bwd_pkts_tot long, flow_duration double"
    df = spark.createDataFrame([(None, None, None, 1, 2, 0, 0, 10, 20, 4.0)], cols)
    assert with_flow_features(df, "live").first().fwd_pkts_tot == 1
    assert with_flow_features(df, "eval").first().fwd_pkts_tot == 1
    vector = with_flow_features(df, "vector").first()
    assert (vector.fwd_pkts_tot, vector.flow_duration, vector.fwd_pkts_per_sec) == (10, 4.0, 2.5)


def test_headers_are_zero(spark):
    df = spark.createDataFrame([(0, 0, 0, 1, 1, 1, 1)], FLOW)
    assert with_flow_features(df, headers=True).first().bwd_header_size_max == 0.0


@pytest.mark.parametrize("sig,live,prof", [
    ("dos with brute", "BRUTEFORCE", "dos"), ("", "UNKNOWN", "unknown"), (None, "UNKNOWN", "unknown"),
    ("SYN scan then brute", "SCAN", "scan"), ("UDP Flood", "DOS", "dos"), ("password guess", "BRUTEFORCE", "bruteforce"),
    ("xmas", "UNKNOWN", "unknown"), ("slowloris", "DOS", "unknown"),
])
def test_keyword_orders(spark, sig, live, prof):
    assert one(spark, L.classify_signature("s"), s=sig) == live
    assert one(spark, profile.profile_class("s", "st"), s=sig, st="attack") == prof
    assert one(spark, profile.profile_class("s", "st"), s=sig, st="Benign") == "benign"


ALERT = "signature string, category string, severity int, signature_id long"


@pytest.mark.parametrize("row,expected", [
    (("x", "Bruteforce", None, 0), ("bruteforce", 0.9, "alert")),          # severity missing counts as 2
    (("x", "Attempted DoS", 1, 0), ("dos", 0.95, "alert")),
    (("x", "DDoS", 9, 0), ("dos", 0.9, "alert")),
    (("nmap sweep", "", 9, 0), ("scan", 0.85, "alert")),                     # keyword rule, other severity
    (("Port Scan", None, 3, 0), ("scan", 0.85, "alert")),                    # category empty: signature text
    (("hydra", "Misc", 1, 0), ("bruteforce", 0.95, "alert")),
    (("beacon", "Misc", 1, 0), None),
    (("SSH Brute Force scan", "", 2, 0), ("bruteforce", 0.9, "alert")),      # map order before keywords
])
def test_label_alert_live(spark, row, expected):
    df = spark.createDataFrame([row], ALERT)
    got = df.select(L.label_alert_live("signature", "category", "severity")).first()[0]
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize("row,expected", [
    (("scan", "x", 1, 2016149), ("benign_info", 0.20, "alert-info")),
    (("scan", "x", None, 0), ("benign_info", 0.20, "alert-info")),           # severity missing counts as 3
    (("scan", " Misc Activity ", 1, 0), ("benign_info", 0.20, "alert-info")),
    (("ET INFO scan", "x", 1, 0), ("benign_info", 0.20, "alert-info")),
    (("scan", "x", 1, 0), ("scan", 0.96, "alert")),
    (("x", "a dos", 2, 0), ("dos", 0.92, "alert")),
    (("x", "bruteforce", 4, 0), ("bruteforce", 0.90, "alert")),
    (("x", "y", 1, 0), ("anomaly", 0.80, "alert")),
])
def test_label_alert_eval(spark, row, expected):
    df = spark.createDataFrame([row], ALERT)
    got = df.select(L.label_alert_eval("signature", "category", "severity", "signature_id")).first()[0]
    assert tuple(got) == expected
    none = df.select(L.label_alert_eval("signature", "category", "severity", "signature_id", F.lit(False))).first()[0]
    assert tuple(none) == ("benign", 0.50, "flow")
    assert one(spark, L.eval_binary("s"), s=expected[0]) == 1


@pytest.mark.parametrize("row,label", [
    ((1.0, 1, 9, 3555.0, 80), "benign"), ((1.0, 1, 9, 3555.1, 80), "dos"),
    ((1.0, 40, 9, 1.0, 80), "benign"), ((1.0, 41, 9, 1.0, 80), "dos"),
    ((0.19, 1, 2, 1.0, 80), "scan"), ((0.20, 1, 2, 1.0, 80), "benign"), ((0.19, 1, 3, 1.0, 80), "benign"),
    ((0.0, 1, 0, 1.0, 0), "benign"), ((0.0, 1, 0, 1.0, None), "benign"),
    ((1.0, 4, 3, 1.0, 22), "bruteforce"), ((1.0, 3, 3, 1.0, 22), "benign"), ((1.0, 4, 4, 1.0, 22), "benign"),
])
def test_label_flow_rules(spark, row, label):
    df = spark.createDataFrame([row], "d double, f long, b long, p double, port int")
    assert df.select(L.label_flow_rules("d", "f", "b", "p", "port")).first()[0]["label"] == label


@pytest.mark.parametrize("cands,expected", [
    ([("scan", 0.95, "alert"), ("dos", 0.70, "flow")], ("dos", 0.70, ["flow"])),
    ([("dos", 0.95, "alert"), ("dos", 0.70, "flow")], ("dos", 1.0, ["alert", "flow"])),
    ([("scan", 0.85, "alert"), ("scan", 0.65, "flow")], ("scan", 0.95, ["alert", "flow"])),
    ([None, ("benign", 0.50, "flow")], ("benign", 0.50, ["flow"])),
    ([("scan", 0.9, "alert"), ("benign", 0.50, "flow")], ("scan", 0.9, ["alert"])),
    ([("odd", 0.3, "alert"), ("other", 0.4, "flow")], ("other", 0.4, ["flow"])),
    ([("odd", 0.4, "alert"), ("odd", 0.3, "flow")], ("odd", 0.4, ["alert"])),
    ([None, None], ("benign", 0.40, [])),
])
def test_resolve(spark, cands, expected):
    c = L.CANDIDATE
    df = spark.createDataFrame([(cands[0], cands[1], cands)], f"a {c}, f {c}, many array<{c}>")
    for got in df.select(L.resolve_pair("a", "f"), L.resolve_candidates("many")).first():
        assert got["label"] == expected[0] and got["confidence"] == pytest.approx(expected[1])
        assert got["sources"] == expected[2]


def test_resolve_many_agreeing(spark):
    c = L.CANDIDATE
    cands = [("scan", 0.5, "a"), ("scan", 0.6, "b"), ("scan", 0.7, "a"), ("benign", 1.0, "c")]
    got = spark.createDataFrame([(cands,)], f"m array<{c}>").select(L.resolve_candidates("m")).first()[0]
    assert got["label"] == "scan" and got["confidence"] == pytest.approx(0.9) and got["sources"] == ["a", "b"]


@pytest.mark.parametrize("row,expected", [
    ((1, 0.8, "benign", 0.5), (1, "drl")), ((1, 0.6, "dos", 0.95), (1, "auto")), ((0, 0.75, "dos", 0.90), (1, "auto")),
    ((0, 0.75, "dos", 0.89), (0, "none")), ((0, 0.75, "benign", 1.0), (0, "none")), ((0, 0.75, None, None), (0, "none")),
])
def test_binary_label(spark, row, expected):
    df = spark.createDataFrame([row], "a int, c double, l string, lc double")
    assert tuple(df.select(L.binary_label("a", "c", "l", "lc")).first()[0]) == expected


@pytest.mark.parametrize("reason,expected", [
    ("Port.Scan", "scan"), ("ssh-BRUTE", "bruteforce"), ("syn_flood", "dos"), ("DoS", "dos"), ("drl", None), ("", None), (None, None),
])
def test_standardise_reason(spark, reason, expected):
    assert one(spark, L.standardise_reason("s"), s=reason) == expected


@pytest.mark.parametrize("sig,cat,proto,port,expected", [
    ("x", "info", "TCP", 1, True), ("a stun b", "x", "TCP", 1, True), ("Binding response", "x", "TCP", 1, True),
    ("x", "x", "udp", 3478, True), ("x", "x", "tcp", 3478, False), (None, None, None, None, False),
])
def test_is_allowlisted(spark, sig, cat, proto, port, expected):
    df = spark.createDataFrame([(sig, cat, proto, port)], "s string, c string, p string, d int")
    assert df.select(L.is_allowlisted("s", "c", "p", "d")).first()[0] is expected


def test_attack_type_rewrite(spark):
    df = spark.createDataFrame([("BRUTE",), ("DDoS",), ("SCAN",), ("brute",)], "k string")
    assert [r[0] for r in df.select(L.normalise_attack_type("k")).collect()] == ["BRUTEFORCE", "DOS", "SCAN", "brute"]


def test_runtime_features_from_stored_and_live_agree(spark):
    cols = "event_id long, timestamp string, proto string, src_port int, dest_port int, signature string, " + FLOW
    df = spark.createDataFrame(
        [(1, "2025-10-17T23:30:00+0700", "tcp", 4, 22, "ET SCAN", 10, 0, 2_000_000, 4, 2, 7, 8)], cols
    ).withColumn("ts_local", times.parse_local("timestamp"))
    live = C.runtime_features(df).first()
    stored = C.runtime_features_from_dataset(with_flow_features(df, "vector")).first()
    assert live == stored and live.hour == 23.0 and live.weekday == 4.0 and math.isclose(live.down_up_ratio, 0.5)
