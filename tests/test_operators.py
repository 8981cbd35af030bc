"""Edge tables of joins, windows, policy, preparation and evaluation."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import columns as C
from sentrylake.operators import evaluate as E
from sentrylake.operators import filters as B
from sentrylake.operators import joins as J
from sentrylake.operators import policy, prep, profile, windows
from sentrylake.params import ENV_COST, Params
from sentrylake.schema import DATASET_COLUMNS

SEC = 1_000_000
P = Params(whitelist=("10.0.0.1",))

EVENT = (
    "event_id long, t_us long, event_type string, src_ip string, dest_ip string, src_port int, dest_port int, proto string, "
    "flow_id long, community_id string, pkts_toserver long, pkts_toclient long, bytes_toserver long, bytes_toclient long, "
    "start_us long, end_us long, signature string, category string, severity int, has_flow boolean"
)


def event(i, t, kind="flow", src="10.0.0.5", dest="192.168.38.10", pkts=1, fid=None, cid=None, sig=None, cat=None, sev=1,
          sport=1, dport=80, proto="TCP", own=True):
    return (i, t, kind, src, dest, sport, dport, proto, fid, cid, pkts, 2, 100, 100, t, t, sig, cat, sev, own)


def table(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def enrich(spark, rows, **kw):
    flows, alerts = B.split_events(table(spark, rows))
    out = J.asof_flow_features(alerts, flows, replace(P, **kw))
    return {r.event_id: (r.hit_key if r.hit else None, r.fwd_pkts_tot) for r in out.collect()}


def alert(i, t, **kw):
    return event(i, t, "alert", **({"sig": "x", "pkts": 77} | kw))


def test_asof_ttl_bounds(spark):
    rows = [event(1, 0, pkts=5), alert(2, 900 * SEC), alert(3, 900 * SEC + 1)]
    assert enrich(spark, rows) == {2: (2, 5), 3: (None, 77)}


def test_asof_key_preference(spark):
    rows = [
        event(1, 10, pkts=1, fid=9), event(2, 20, pkts=2), alert(3, 30, fid=9),           # older flow id beats newer tuple
        event(4, 5, pkts=4, cid="c"), alert(5, 31, fid=9, cid="c"),                         # community id beats both
        alert(6, 32, fid=8, cid="d"),                                                      # falls through to the tuple
    ]
    assert enrich(spark, rows) == {3: (1, 1), 5: (0, 4), 6: (2, 2)}


def test_asof_expired_preferred_key_falls_through(spark):
    rows = [event(1, 0, pkts=1, fid=9), event(2, 50 * SEC, pkts=2), alert(3, 70 * SEC, fid=9)]
    assert enrich(spark, rows, flow_ttl_us=60 * SEC) == {3: (2, 2)}


def test_asof_ties_and_case(spark):
    rows = [event(1, 10, pkts=1), event(2, 10, pkts=2, proto="tcp"), alert(3, 10, proto="Tcp"), alert(4, 9)]
    assert enrich(spark, rows) == {3: (2, 2), 4: (None, 77)}


def test_asof_miss_without_own_flow_gives_zeros(spark):
    flows, alerts = B.split_events(table(spark, [alert(1, 10, own=False)]))
    row = J.asof_flow_features(alerts, flows, P).first()
    assert (row.hit, row.fwd_pkts_tot, row.flow_duration, row.flow_pkts_per_sec, row.down_up_ratio) == (False, 0, 0.0, 0.0, 0.0)


def test_asof_hot_key_and_copies(spark):
    """One source with most rows and many alerts at one instant; nothing is lost or repeated."""
    rows = [event(i, i * SEC, pkts=i) for i in range(300)] + [alert(1000 + i, 150 * SEC) for i in range(200)]
    rows += [alert(2000 + i, i * SEC + 1) for i in range(300)]
    got = enrich(spark, rows, slice_us=5 * SEC)
    assert len(got) == 500
    assert all(got[1000 + i] == (2, 150) for i in range(200))
    assert all(got[2000 + i] == (2, i) for i in range(300))


def rated(spark, rows):
    flows, alerts = B.split_events(table(spark, rows))
    return {r.event_id: r for r in windows.with_source_rates(alerts, flows, P).collect()}


def test_rates_bounds_and_no_cap(spark):
    rows = [event(1, 0), event(2, 10 * SEC), alert(3, 10 * SEC), alert(4, 10 * SEC + 1)]
    got = rated(spark, rows)
    assert (got[3].flows_per_sec, got[4].flows_per_sec) == (0.2, 0.1)
    rows = [event(i, i) for i in range(250)] + [alert(999, 300)] + [alert(1000, 300, src="10.9.9.9")]
    got = rated(spark, rows)
    assert got[999].flows_per_sec == 25.0 and got[1000].flows_per_sec == 0.0
    assert got[1000].alerts_count_5s == 1
    got = rated(spark, [alert(i, 100 + i, sig="syn" if i % 4 == 0 else "other") for i in range(1000)])
    assert (got[999].alerts_count_5s, got[999].syn_only_ratio, got[999].hits_30s) == (1000, 0.25, 1000)


def test_rates_syn_and_hits(spark):
    rows = [alert(1, 0, sig="SYN flood"), alert(2, SEC, sig="other"), alert(3, 2 * SEC, sig="flood of syn"),
            alert(4, 33 * SEC, sig="SYN flood"), alert(5, 40 * SEC, sig=None)]
    got = rated(spark, rows)
    assert [got[i].alerts_count_5s for i in (1, 2, 3, 4)] == [1, 2, 3, 1]
    assert [got[i].syn_only_ratio for i in (1, 2, 3, 4)] == [1.0, 0.5, pytest.approx(2 / 3), 1.0]
    assert [got[i].multi_hit for i in (1, 2, 3, 4)] == [False, False, True, False]
    assert [got[i].syn_flood_trigger for i in (1, 2, 3, 4)] == [False, False, True, False]
    assert [got[i].hits_2s for i in (3, 4)] == [3, 1]


def test_rates_without_source(spark):
    got = rated(spark, [alert(1, 0, src=None), alert(2, 0, src="")])
    assert {(r.flows_per_sec, r.alerts_count_5s, r.multi_hit) for r in got.values()} == {(0.0, 0, False)}


def test_admission(spark):
    rows = [
        alert(1, 0), alert(2, 0, dest="1.1.1.1"), alert(3, 0, sig=""), alert(4, 0, sig=None),
        alert(5, 0, sig="x SURICATA STREAM ESTABLISHED y"), alert(6, 0, sig="suricata stream established"), alert(7, 0, dest=None),
    ]
    assert {r.event_id for r in B.admit_alerts(table(spark, rows), P).collect()} == {1, 6}
    renamed = table(spark, rows).withColumn("dst_ip", F.lit("192.168.38.10")).withColumn(
        "dest_ip", F.when(F.col("event_id") == 7, F.lit("")).otherwise(F.col("dest_ip")))
    assert 7 in {r.event_id for r in B.admit_alerts(renamed, P).collect()}


def test_benign_flow_admission(spark):
    rows = [event(1, 0, pkts=2), event(2, 0, pkts=1), event(3, 0, pkts=9, dest="8.8.8.8"), event(4, 0, pkts=9, src=None),
            event(5, 0, pkts=9, src="192.168.38.10"), event(6, 0, pkts=9, dest=None)]
    flows = table(spark, rows).withColumn("bytes_toserver", F.lit(500).cast("long"))
    assert {r.event_id for r in B.admit_benign_flows(flows, P).collect()} == {1}
    assert B.admit_benign_flows(flows.withColumn("bytes_toserver", F.lit(499).cast("long")), P).count() == 0
    every = B.benign_sample(flows, replace(P, benign_sample_rate=1.0))
    assert every.count() == 6 and every.first().y_reason == "benign"


def flags(spark, rows, ips, spans):
    ips = None if ips is None else spark.createDataFrame([(i,) for i in ips], "ip string")
    spans = None if spans is None else spark.createDataFrame(spans, "start_s long, end_s long")
    out = J.attack_flags(table(spark, rows), ips, spans, bucket_s=10).collect()
    assert len(out) == len(rows)
    return [r.event_id for r in sorted(out) if r.in_attack]


def test_attack_flags(spark):
    rows = [event(1, 10 * SEC - 1), event(2, 10 * SEC), event(3, 25 * SEC + 999_999), event(4, 26 * SEC),
            event(5, 20 * SEC, src="9.9.9.9"), event(6, 20 * SEC, src="9.9.9.9", dest="10.0.0.5"), event(7, 47 * SEC)]
    spans = [(10, 20), (15, 25), (12, 13), (47, 47)]
    assert flags(spark, rows, ["10.0.0.5", " 10.0.0.5"], spans) == [2, 3, 6, 7]
    assert flags(spark, rows, None, spans) == [2, 3, 5, 6, 7]
    assert flags(spark, rows, ["10.0.0.5"], None) == [1, 2, 3, 4, 6, 7]
    assert flags(spark, rows, None, None) == []


DECISION = ("event_id long, src_ip string, t_us long, signature string, category string, proto string, dest_port int, "
            "action int, confidence double, auto_label string, auto_label_conf double, label_sources array<string>, "
            "multi_hit boolean, syn_flood_trigger boolean, flows_per_sec double, syn_only_ratio double, alerts_count_5s long")


def decision(i=1, action=1, conf=0.8, label="scan", lconf=0.95, srcs=("alert", "flow"), multi=False, syn=False, cat="x", src="a", t=0):
    return (i, src, t, "x", cat, "TCP", 80, action, conf, label, lconf, list(srcs), multi, syn, 0.3, 0.125, 4)


@pytest.mark.parametrize("kw,block", [
    ({}, True), ({"action": 0}, False), ({"conf": 0.69}, False), ({"conf": 0.70}, True),
    ({"srcs": ["alert"]}, False), ({"srcs": ["alert"], "multi": True}, True), ({"srcs": ["alert"], "syn": True}, True),
    ({"lconf": 0.89}, False), ({"label": "benign"}, False), ({"label": "benign", "multi": True}, True),
    ({"label": "benign", "multi": True, "cat": "info"}, False), ({"cat": "info"}, True),
])
def test_decide(spark, kw, block):
    df = spark.createDataFrame([decision(**kw)], DECISION)
    assert policy.decide(df, P).first().should_block is block
    assert policy.decide(df, replace(P, monitoring_on=False)).first().should_block is False


def test_reason_text(spark):
    df = spark.createDataFrame([decision(), decision(2, srcs=["alert"], multi=True), decision(3, srcs=["alert"], syn=True), decision(4, action=0)], DECISION)
    got = {r.event_id: r.reason for r in policy.decide(df, P).collect()}
    assert got == {
        1: "DRL=BLOCK fast-track (conf 0.80); auto=scan@0.95 from alert+flow",
        2: "DRL=BLOCK (conf 0.80); auto=scan@0.95; multi-hit OK; agg(fps=0.30, syn_ratio=0.13, alerts5s=4)",
        3: "DRL=BLOCK (conf 0.80); auto=scan@0.95; SYN-flood policy; agg(fps=0.30, syn_ratio=0.13, alerts5s=4)",
        4: "",
    }


def test_block_intervals(spark):
    rows = [decision(i, src=s, t=t) for i, (s, t) in enumerate([("a", 0), ("a", 9), ("a", 10), ("a", 19), ("a", 20), ("b", 5), ("b", 5)])]
    decided = policy.decide(spark.createDataFrame(rows, DECISION), P)
    blocks = policy.block_intervals(decided, 10, P)
    got = sorted((r.ip, r.block_us, r.unblock_us, r.event_id) for r in blocks.collect())
    assert got == [("a", 0, 10, 0), ("a", 10, 20, 2), ("a", 20, 30, 4), ("b", 5, 15, 5)]
    at = lambda t: sorted(r.ip for r in policy.active_blocks(blocks, t).collect())
    assert at(4) == ["a"] and at(5) == ["a", "b"] and at(14) == ["a", "b"] and at(15) == ["a"] and at(30) == []
    assert [r.ip for r in policy.list_blocked(policy.active_blocks(blocks, 6)).collect()] == ["b", "a"]
    assert E.blocked_count(policy.active_blocks(blocks, 6)).first().n_blocked == 2


def test_block_commands(spark):
    rows = [decision(i, src="a", t=t) for i, t in enumerate([0, 3, 4, 9, 13, 14, 30])]
    commands = spark.createDataFrame([("a", 4), ("a", 8), ("z", 1), ("a", 35)], "ip string, t_us long")
    blocks = policy.block_intervals(policy.decide(spark.createDataFrame(rows, DECISION), P), 10, P, commands)
    assert sorted((r.block_us, r.unblock_us) for r in blocks.collect()) == [(0, 4), (4, 8), (9, 19), (30, 35)]


def test_attack_flags_with_empty_tables(spark):
    rows = spark.createDataFrame([("a", "x", 5), ("b", "a", 50), ("b", "x", 5), (None, None, None)], "src_ip string, dest_ip string, t_s long")
    events = rows.select("src_ip", "dest_ip", (F.col("t_s") * 1_000_000).alias("t_us"))
    ips = spark.createDataFrame([(" a ",), ("",)], "ip string")
    windows = spark.createDataFrame([(0, 9), (4, 6), (9000, 8000)], "start_s long, end_s long")
    flags = lambda i, w: [r.in_attack for r in J.attack_flags(events, i, w).orderBy("src_ip", "dest_ip").collect()]
    none_ips, none_windows = ips.filter("ip = ''"), windows.filter("start_s > end_s")
    # order: (None), (a x 5), (b a 50), (b x 5); an unknown time counts as 0
    assert flags(ips, windows) == [False, True, False, False]
    assert flags(ips, None) == flags(ips, none_windows) == [False, True, True, False]
    assert flags(None, windows) == flags(none_ips, windows) == [True, True, False, True]
    assert flags(None, None) == flags(none_ips, none_windows) == [False] * 4
    plan = J.attack_flags(events, ips, windows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan  # small tables: events stay where they are


def test_whitelist(spark):
    df = spark.createDataFrame([(s,) for s in ("10.0.0.1", "192.168.38.10", "10.0.0.7", "10.0.0.8")], "src_ip string")
    extra = spark.createDataFrame([("10.0.0.8",)], "ip string")
    assert [r[0] for r in J.drop_whitelisted(df, P, extra).collect()] == ["10.0.0.7"]
    assert J.drop_already_blocked(df, extra).count() == 3


def test_minmax(spark):
    train = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "a double, c double")
    stats = prep.fit_minmax(train, ["a", "c"])
    test = spark.createDataFrame([(5.0, 5.0), (20.0, 9.0), (-3.0, 1.0), (float("nan"), 5.0), (float("inf"), 5.0), (float("-inf"), None)], "a double, c double")
    got = [tuple(r) for r in prep.apply_minmax(test, stats, ["a", "c"]).collect()]
    assert got == [(0.5, 0.0), (1.0, 1.0), (0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]


def test_constant_features(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 2, 4)], "a int, b int, c int")
    assert prep.drop_constant_features(df, ["a", "c"]).columns == ["b", "c"]


@pytest.mark.parametrize("counts,stratified", [({"a": 10, "b": 90}, True), ({"a": 1, "b": 99}, False), ({"a": 50}, False)])
def test_stratified_split(spark, counts, stratified):
    rows = [(i, c) for i, c in enumerate(c for c, n in counts.items() for _ in range(n))]
    marked = prep.stratified_split(spark.createDataFrame(rows, "event_id long, y string"), "y", per_class=stratified).collect()
    test = [r.y for r in marked if r.is_test]
    assert len(marked) == len(rows) and len(test) == len(rows) // 5
    if stratified:
        assert {c: test.count(c) for c in counts} == {c: n // 5 for c, n in counts.items()}
    assert E.can_stratify(E.class_counts(spark.createDataFrame(rows, "i long, y string"), "y")).first()[0] is stratified


def test_share_does_not_depend_on_the_size(spark):
    marked = prep.stratified_split(spark.createDataFrame([(i, "a") for i in range(4)], "event_id long, y string"), "y", 0.5)
    assert marked.filter("is_test").count() == 2


def test_split_is_repeatable_whatever_the_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "event_id")
    a = {r.event_id for r in prep.train_val_split(df).filter("is_train").collect()}
    b = {r.event_id for r in prep.train_val_split(df.repartition(7)).filter("is_train").collect()}
    assert a == b and len(a) == 400


def test_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "y string")
    assert {(r.y, round(r.weight, 6)) for r in prep.balanced_weights(df, "y").collect()} == {("a", round(4 / 6, 6)), ("b", 2.0)}


def test_scores(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 1), (2, 1)], "a int, y int")
    row = E.cost_score(df, "a", "y", ENV_COST).first()
    assert (row.total_reward, row.tp, row.tn, row.fp, row.fn) == (2.0 + 0.5 - 6.0 - 2.5 - 1.0, 1, 1, 1, 1)
    cats = spark.createDataFrame([(3, 3), (0, 2), (1, 2)], "p int, y int")
    assert E.category_cost_score(cats, "p", "y").first().total_reward == -5.0


def test_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    got = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in E.classification_report(df, "y", "p").collect()}
    assert got == {
        "a": (1.0, 0.5, 0.667, 2), "b": (0.333, 1.0, 0.5, 1), "c": (0.0, 0.0, 0.0, 1), "accuracy": (0.5, 0.5, 0.5, 4),
        "macro avg": (0.444, 0.5, 0.389, 4), "weighted avg": (0.583, 0.5, 0.458, 4),
    }


def test_hit_rate_of_nothing(spark):
    assert E.hit_rate(spark.createDataFrame([], "hit boolean")).first().hit_rate == 0.0


def test_infer_status_order(spark):
    def status(**cols):
        df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"`{c}` string" for c in cols))
        return profile.infer_status(df, "st").first()["st"]

    assert status(status="Blocked", y_attack="0") == "blocked"
    assert [status(is_attack=v, label="x") for v in ("0", "1", "3", "bad")] == ["benign", "attack", "3", "benign"]
    assert [status(kelas=v) for v in ("Normal", "BENIGN_FLOW", "bruteforce", "dos/hping3", "odd")] == ["benign", "benign", "brute", "dos", "odd"]
    assert [status(sig_x="1", signature=v) for v in ("benign_flow", "", "ET SCAN", "other")] == ["benign", "benign", "attack", "attack"]
    assert status(other="1") == "unknown"


def test_buckets(spark):
    rows = [("hydra", "22"), ("hydra", "80"), ("odd", "22"), ("odd", "80"), ("nmap", "22"), ("", "22")]
    df = profile.infer_status(spark.createDataFrame(rows, "signature string, dst_port string"))
    assert [r.bucket for r in profile.with_bucket(df).collect()] == ["bruteforce", None, "bruteforce", None, "scan", "benign"]
    no_ssh = df.withColumn("dst_port", F.lit("bad"))
    assert [r.bucket for r in profile.with_bucket(no_ssh).collect()] == ["bruteforce", "bruteforce", None, None, "scan", "benign"]


def test_thresholds_defaults_and_no_answer(spark):
    cols = "signature string, dst_port int, status string, flow_pkts_per_sec double, fwd_pkts_tot double, bwd_pkts_tot double, flow_duration double"
    benign = profile.with_bucket(spark.createDataFrame([("", 1, "benign", float(i), float(i), 0.0, 0.0) for i in range(101)], cols))
    row = profile.suggest_thresholds(benign).first()
    assert tuple(row) == (99.0, 99, 1.0, 2, 12, 4)
    attack = profile.with_bucket(spark.createDataFrame([("nmap", 1, "attack", 1.0, 1.0, 1.0, 1.0)], cols))
    assert profile.suggest_thresholds(attack).count() == 0


def test_approximate_profile_is_close(spark):
    cols = "signature string, dst_port int, status string, flow_pkts_per_sec double, fwd_pkts_tot double, bwd_pkts_tot double, flow_duration double"
    df = profile.with_bucket(spark.createDataFrame([("", 1, "benign", float(i), 0.0, 0.0, 0.0) for i in range(1001)], cols))
    row = profile.quantile_profile(df, ("flow_pkts_per_sec",), approximate=True).first()
    assert (row.p50, row.p99, row.max) == (500.0, 990.0, 1000.0)


def test_label_priority(spark):
    one = lambda **c: C.label_by_priority(spark.createDataFrame([tuple(c.values())], ", ".join(f"`{k}` string" for k in c))).first().y
    assert one(label="bad", y_attack="1") == 0 and one(label="2") == 2
    assert one(y_attack="0.5", status="blocked") == 1
    assert one(auto_label=" Benign ") == 0 and one(auto_label=None) == 1
    assert one(status="ALERT") == 1 and one(status="ok", action="1") == 0
    assert one(threat_score="70") == 0 and one(threat_score="70.5") == 1
    with pytest.raises(ValueError):
        one(other="1")


def test_dest_port_fallback(spark):
    df = spark.createDataFrame([(0, 22), (0, 80)], "dest_port int, dst_port int")
    assert [r.dest_port for r in C.dest_port_fallback(df).collect()] == [22, 80]
    df = spark.createDataFrame([(0, 22), (5, 80)], "dest_port int, dst_port int")
    assert [r.dest_port for r in C.dest_port_fallback(df).collect()] == [0, 5]
    assert C.dest_port_fallback(df.drop("dest_port")).first().dest_port == 22


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "signature int, junk int, timestamp int")
    out = C.conform_columns(df)
    assert out.columns == list(DATASET_COLUMNS) and out.first().src_ip == ""
    named = spark.createDataFrame([(1, 2, 3, 4)], "` Sig ` int, signature int, DPort int, dest_port int")
    assert C.normalise_columns(named).columns == ["sig", "signature", "dport", "dst_port"]
    rates = spark.createDataFrame([("1.5", "x")], "fwd_pkts_per_sec string, bwd_pkts_per_sec string")
    assert C.normalise_columns(rates).first().flow_pkts_per_sec == 1.5
    with pytest.raises(ValueError):
        B.valid_timestamps(df, "timestamp", ("nope",))
    with pytest.raises(ValueError):
        B.require_rows(df, 2)


def test_encode_order(spark):
    rows = [(3, 30, "b"), (1, 10, "z"), (2, 20, "b"), (4, 5, None)]
    df = spark.createDataFrame(rows, "event_id long, t_us long, category string")
    codes = {r.value: r.code for r in prep.category_codes(df, "category", "Unknown", ("t_us", "event_id")).collect()}
    assert codes == {"Unknown": 0, "z": 1, "b": 2}
    assert {r.value: r.code for r in prep.category_codes(df, "category", "na").collect()} == {"b": 0, "na": 1, "z": 2}
