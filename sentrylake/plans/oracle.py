"""Named DuckDB queries that the registered SQL is built from."""

from __future__ import annotations

import re

from .. import params as P
from .fixture import ATTACKERS, WINDOWS, duckdb_base, duckdb_event


def _lit(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def any_word(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {_lit(w)})" for w in words) + ")"


def d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def r6(expr: str, name: str | None = None) -> str:
    out = f"round(CAST({expr} AS DOUBLE), 6)"
    return f"{out} AS {name}" if name else out


def hash32(expr: str) -> str:
    return f"CAST(concat('0x', substr(sha256({expr}), 1, 8)) AS BIGINT)"


def by_severity(sev: str, table) -> str:
    scores, other = table
    return "CASE " + sev + " " + " ".join(f"WHEN {k} THEN {d(v)}" for k, v in scores.items()) + f" ELSE {d(other)} END"


def signature_class(sig: str) -> str:
    t = f"lower(coalesce({sig}, ''))"
    return "CASE " + " ".join(
        f"WHEN {any_word(t, w)} THEN {_lit(n.upper())}" for n, w in P.SIGNATURE_KEYWORDS.items()
    ) + " ELSE 'UNKNOWN' END"


def mapped(text: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {_lit(k)}) THEN {_lit(v)}" for k, v in P.ALERT_TEXT_MAP) + " END"


SEEDED_ID = "concat('42|', event_id)"
_LIVE_TEXT = "lower(CASE WHEN coalesce(category, '') <> '' THEN category ELSE coalesce(signature, '') END)"

ADMITTED = (
    "dest_ip = '192.168.38.10' AND signature <> '' AND NOT " + any_word("signature", P.IGNORED_SIGNATURES)
)

ALLOWLISTED = (
    "(upper(coalesce(category, '')) = 'INFO' OR "
    + any_word("upper(coalesce(signature, ''))", [w.upper() for w in P.ALLOW_SIGNATURE_WORDS])
    + " OR (upper(proto) = 'UDP' AND dest_port = 3478))"
)

FLOW_RULE = (
    "CASE WHEN flow_pkts_per_sec > 3555 OR fwd_pkts_tot > 40 THEN 'dos' "
    "WHEN flow_duration < 0.2 AND bwd_pkts_tot <= 2 AND dest_port <> 0 THEN 'scan' "
    "WHEN dest_port = 22 AND fwd_pkts_tot >= 4 AND bwd_pkts_tot <= 3 THEN 'bruteforce' ELSE 'benign' END"
)
FLOW_SCORE = (
    "CASE WHEN flow_pkts_per_sec > 3555 OR fwd_pkts_tot > 40 THEN 0.7::DOUBLE "
    "WHEN flow_duration < 0.2 AND bwd_pkts_tot <= 2 AND dest_port <> 0 THEN 0.65::DOUBLE "
    "WHEN dest_port = 22 AND fwd_pkts_tot >= 4 AND bwd_pkts_tot <= 3 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END"
)

_RANK = "CASE {x} WHEN 'dos' THEN 1 WHEN 'bruteforce' THEN 2 WHEN 'scan' THEN 3 WHEN 'anomaly' THEN 4 WHEN 'benign' THEN 5 ELSE 99 END"


def rank(x: str) -> str:
    return _RANK.replace("{x}", x)


def flow_features(rel: str, mode: str = "live", extra: str = "*") -> str:
    """SELECT that adds the nine flow features to a relation with raw flow columns."""
    ratio = {
        "live": "CASE WHEN coalesce(pkts_toserver, 0) = 0 THEN 0 ELSE coalesce(pkts_toclient, 0)::DOUBLE / pkts_toserver END",
        "eval": "coalesce(pkts_toclient, 0)::DOUBLE / greatest(1, coalesce(pkts_toserver, 0))",
        "vector": "CASE WHEN coalesce(pkts_toserver, 0) > 0 THEN coalesce(pkts_toclient, 0)::DOUBLE / pkts_toserver "
                  "WHEN coalesce(pkts_toclient, 0) > 0 THEN 999 ELSE 0 END",
    }[mode]
    return f"""SELECT {extra}, dur AS flow_duration,
      coalesce(pkts_toserver, 0) AS fwd_pkts_tot, coalesce(pkts_toclient, 0) AS bwd_pkts_tot,
      coalesce(bytes_toserver, 0) AS fwd_data_pkts_tot, coalesce(bytes_toclient, 0) AS bwd_data_pkts_tot,
      coalesce(pkts_toserver, 0) / den AS fwd_pkts_per_sec, coalesce(pkts_toclient, 0) / den AS bwd_pkts_per_sec,
      (coalesce(pkts_toserver, 0) + coalesce(pkts_toclient, 0)) / den AS flow_pkts_per_sec,
      CAST({ratio} AS DOUBLE) AS down_up_ratio
    FROM (SELECT *, CASE WHEN dur > 0 THEN dur ELSE 1.0::DOUBLE END AS den FROM (
      SELECT *, greatest(coalesce(end_us, t_us) - coalesce(start_us, t_us), 0)::DOUBLE / 1000000 AS dur FROM {rel}) q1) q2"""


def enriched(ttl_us: int) -> str:
    """Three as-of joins, the preferred key first."""
    def one(kind: str) -> str:
        return f"CASE WHEN {kind}.f_t IS NOT NULL AND b.t_us - {kind}.f_t <= {ttl_us}"

    def pick(c: str) -> str:
        return " ".join([
            f"{one('fc')} THEN fc.{c}", f"WHEN ff.f_t IS NOT NULL AND b.t_us - ff.f_t <= {ttl_us} THEN ff.{c}",
            f"WHEN ft.f_t IS NOT NULL AND b.t_us - ft.f_t <= {ttl_us} THEN ft.{c}",
        ])

    raw = ("start_us", "end_us", "pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient")
    keep = ("event_id, t_us, src_ip, dest_ip, src_port, dest_port, proto, signature, category, severity, "
            "flow_id, community_id, hit, hit_key")
    inner = f"""SELECT b.event_id, b.src_ip, b.dest_ip, b.src_port, b.dest_port, b.proto, b.signature, b.category, b.severity,
      b.flow_id, b.community_id, b.t_us,
      {one('fc')} THEN TRUE WHEN ff.f_t IS NOT NULL AND b.t_us - ff.f_t <= {ttl_us} THEN TRUE
        WHEN ft.f_t IS NOT NULL AND b.t_us - ft.f_t <= {ttl_us} THEN TRUE ELSE FALSE END AS hit,
      {one('fc')} THEN 0 WHEN ff.f_t IS NOT NULL AND b.t_us - ff.f_t <= {ttl_us} THEN 1
        WHEN ft.f_t IS NOT NULL AND b.t_us - ft.f_t <= {ttl_us} THEN 2 END AS hit_key,
      {', '.join(f"{pick(c)} ELSE b.{c} END AS {c}" for c in raw)}
    FROM admitted b
    ASOF LEFT JOIN flow_c fc ON b.community_id = fc.key AND b.t_us >= fc.f_t
    ASOF LEFT JOIN flow_f ff ON b.flow_id = ff.key AND b.t_us >= ff.f_t
    ASOF LEFT JOIN flow_t ft ON b.tkey = ft.key AND b.t_us >= ft.f_t"""
    return flow_features(f"({inner}) j", "live", keep)


def keyed_flows(key: str) -> str:
    return (
        f"SELECT {key} AS key, t_us AS f_t, start_us, end_us, pkts_toserver, pkts_toclient, bytes_toserver, bytes_toclient "
        f"FROM flows WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key}, t_us ORDER BY event_id DESC) = 1"
    )


_TKEY = "concat_ws('|', src_ip, dest_ip, src_port, dest_port, upper(proto))"


def chain(stamps: str, keys: list[str], gap: int) -> str:
    """Body of a recursive query: the first stamp of each key, then each next one a gap later."""
    k = ", ".join(keys)
    same = " AND ".join(f"s.{c} = c.{c}" for c in keys)
    first = ", ".join(f"c.{c}" for c in keys)
    return (
        f"SELECT {k}, min(t_us) AS t_us FROM {stamps} GROUP BY {k} UNION ALL "
        f"SELECT {first}, (SELECT min(s.t_us) FROM {stamps} s WHERE {same} AND s.t_us >= c.t_us + {gap}) AS t_us "
        f"FROM {{self}} c WHERE EXISTS (SELECT 1 FROM {stamps} s WHERE {same} AND s.t_us >= c.t_us + {gap})"
    )


_COUNT = "count(*) FILTER (WHERE {cond}) OVER (PARTITION BY src_ip ORDER BY t_us RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)"


def _count(cond: str, w: int) -> str:
    return _COUNT.format(cond=cond, w=w)


_REASON = """CASE WHEN NOT should_block THEN ''
  WHEN strong THEN concat('DRL=BLOCK fast-track (conf ', printf('%.2f', confidence), '); auto=', auto_label, '@', printf('%.2f', round(auto_label_conf, 2)), ' from alert+flow')
  ELSE concat('DRL=BLOCK (conf ', printf('%.2f', confidence), '); auto=', auto_label, '@', printf('%.2f', round(auto_label_conf, 2)), '; ',
    CASE WHEN multi_hit THEN 'multi-hit OK' ELSE 'SYN-flood policy' END,
    '; agg(fps=', printf('%.2f', round(flows_per_sec, 2)), ', syn_ratio=', printf('%.2f', round(syn_only_ratio, 2)), ', alerts5s=', alerts_count_5s, ')') END"""

_RATED_FROM = """SELECT e.*, n.n_flows / 10.0::DOUBLE AS flows_per_sec, n.n_alerts AS alerts_count_5s,
  n.n_syn::DOUBLE / greatest(n.n_alerts, 1) AS syn_only_ratio, n.n_hits >= 3 AS multi_hit,
  (contains(lower(signature), 'syn') AND contains(lower(signature), 'flood') AND (n.n_syn_hits >= 3 OR n.n_alerts >= 3)) AS syn_flood_trigger
  FROM {rel} e JOIN rates n USING (event_id)"""

CTES: dict[str, str] = {
    "r": duckdb_base(),
    "eve0": duckdb_event(),
    "eve": "SELECT *, make_timestamp(t_us + 25200000000) AS ts_local, "
           "concat(strftime(make_timestamp(t_us + 25200000000), '%Y-%m-%dT%H:%M:%S.%f'), '+0700') AS \"timestamp\" FROM eve0",
    "ev": "SELECT * REPLACE ("
          + ", ".join(f"CASE WHEN event_type = 'alert' THEN {c} END AS {c}" for c in ("signature", "category", "severity", "signature_id"))
          + ", "
          + ", ".join(f"CASE WHEN event_type <> 'dns' THEN {c} END AS {c}" for c in ("pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient", "start_us", "end_us"))
          + f"), {_TKEY} AS tkey FROM eve",
    "flows": "SELECT * FROM ev WHERE event_type = 'flow'",
    "alerts": "SELECT * FROM ev WHERE event_type = 'alert'",
    "admitted": f"SELECT * FROM alerts WHERE {ADMITTED}",
    "ffeat": flow_features("flows"),
    "evfeat": flow_features("eve"),
    "flow_c": keyed_flows("community_id"),
    "flow_f": keyed_flows("flow_id"),
    "flow_t": keyed_flows("tkey"),
    "enriched": enriched(900_000_000),
    "enriched60": enriched(60_000_000),
    "stamps": "SELECT event_id, src_ip, t_us, TRUE AS is_flow, FALSE AS is_syn FROM flows UNION ALL "
              "SELECT event_id, src_ip, t_us, FALSE, contains(lower(signature), 'syn') FROM admitted",
    "rates": "SELECT * FROM (SELECT event_id, src_ip, t_us, is_flow, "
             + _count("is_flow", 10_000_000) + " AS n_flows, "
             + _count("NOT is_flow", 5_000_000) + " AS n_alerts, "
             + _count("is_syn", 5_000_000) + " AS n_syn, "
             + _count("NOT is_flow", 30_000_000) + " AS n_hits, "
             + _count("NOT is_flow", 2_000_000) + " AS n_syn_hits FROM stamps) w WHERE NOT is_flow",
    "rated": _RATED_FROM.format(rel="enriched"),
    "rated_alerts": _RATED_FROM.format(rel="admitted"),
    "cands": "SELECT *, "
             f"coalesce({mapped(_LIVE_TEXT)}, nullif(lower({signature_class('signature')}), 'unknown')) AS a_label, "
             f"CASE WHEN {mapped(_LIVE_TEXT)} IS NOT NULL THEN {by_severity('coalesce(severity, 2)', P.LIVE_MAP_SCORES)} "
             f"WHEN {signature_class('signature')} <> 'UNKNOWN' THEN {by_severity('coalesce(severity, 2)', P.LIVE_KEYWORD_SCORES)} END AS a_score, "
             f"{FLOW_RULE} AS f_label, {FLOW_SCORE} AS f_score FROM rated",
    "labelled": "SELECT *, "
                f"CASE WHEN a_label IS NOT NULL AND {rank('a_label')} <= {rank('f_label')} THEN a_label ELSE f_label END AS auto_label, "
                "CASE WHEN a_label = f_label THEN least(1.0::DOUBLE, greatest(a_score, f_score) + 0.1::DOUBLE) "
                f"WHEN a_label IS NOT NULL AND {rank('a_label')} < {rank('f_label')} THEN a_score ELSE f_score END AS auto_label_conf, "
                "CASE WHEN a_label = f_label THEN 'alert;flow' "
                f"WHEN a_label IS NOT NULL AND {rank('a_label')} < {rank('f_label')} THEN 'alert' ELSE 'flow' END AS label_sources "
                "FROM cands",
    "acted": "SELECT *, CASE WHEN severity <= 2 THEN 1 ELSE 0 END AS action, "
             "CASE WHEN severity <= 2 THEN 0.8::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM labelled",
    "judged": "SELECT *, CASE WHEN action = 1 AND confidence >= 0.7 THEN 1 WHEN auto_label IN ('dos','bruteforce','scan','anomaly') AND auto_label_conf >= 0.9 THEN 1 ELSE 0 END AS y_attack, "
              "CASE WHEN action = 1 AND confidence >= 0.7 THEN 'drl' WHEN auto_label IN ('dos','bruteforce','scan','anomaly') AND auto_label_conf >= 0.9 THEN 'auto' ELSE 'none' END AS y_reason, "
              "(auto_label IN ('dos','bruteforce','scan','anomaly') AND auto_label_conf >= 0.9 AND label_sources = 'alert;flow') AS strong, "
              f"{ALLOWLISTED} AS allowed FROM acted",
    "decided0": "SELECT *, (action > 0 AND confidence >= 0.7 AND (strong OR (NOT allowed AND (multi_hit OR syn_flood_trigger)))) AS should_block FROM judged",
    "decided": f"SELECT *, {_REASON} AS reason FROM decided0",
    "requests": "SELECT src_ip AS ip, t_us, min(event_id) AS event_id FROM decided WHERE should_block AND src_ip NOT IN ('10.0.0.1', '192.168.38.10') GROUP BY 1, 2",
    "opened": chain("requests", ["ip"], 86_400_000_000).replace("{self}", "opened"),
    "opened60": chain("requests", ["ip"], 60_000_000).replace("{self}", "opened60"),
    "blocks": "SELECT o.ip, o.t_us AS block_us, o.t_us + 86400000000 AS unblock_us, x.event_id, x.reason, x.confidence FROM opened o JOIN requests q USING (ip, t_us) JOIN decided x USING (event_id)",
    "blocks60": "SELECT o.ip, o.t_us AS block_us, o.t_us + 60000000 AS unblock_us, x.event_id, x.reason, x.confidence FROM opened60 o JOIN requests q USING (ip, t_us) JOIN decided x USING (event_id)",
    "active60": "SELECT * FROM blocks60 WHERE block_us <= 1704067500000000 AND unblock_us > 1704067500000000",
    "nstamps": "SELECT src_ip, signature, t_us, min(event_id) AS event_id FROM admitted GROUP BY 1, 2, 3",
    "sent": chain("nstamps", ["src_ip", "signature"], 10_000_000).replace("{self}", "sent"),
    "detected": "SELECT d.*, b.event_id IS NOT NULL AS blocked, n.event_id IS NOT NULL AS notified FROM decided d "
                "LEFT JOIN blocks b USING (event_id) "
                "LEFT JOIN (SELECT event_id FROM nstamps JOIN sent USING (src_ip, signature, t_us)) n USING (event_id)",
    "attackers": "SELECT unnest([" + ", ".join(_lit(a) for a in ATTACKERS) + "]) AS ip",
    "windows": "SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in WINDOWS) + ") w(start_s, end_s)",
    "evalbase": "SELECT *, CASE WHEN event_type <> 'alert' THEN 'benign' "
                "WHEN signature_id IN (2016149, 2016150) OR coalesce(severity, 3) = 3 OR lower(trim(category)) = 'misc activity' OR starts_with(lower(trim(signature)), 'et info ') THEN 'benign_info' "
                f"ELSE coalesce({mapped('concat(lower(trim(signature)), chr(32), lower(trim(category)))')}, 'anomaly') END AS e_label, "
                "CASE WHEN event_type <> 'alert' THEN 0.5::DOUBLE "
                "WHEN signature_id IN (2016149, 2016150) OR coalesce(severity, 3) = 3 OR lower(trim(category)) = 'misc activity' OR starts_with(lower(trim(signature)), 'et info ') THEN 0.2::DOUBLE "
                f"WHEN {mapped('concat(lower(trim(signature)), chr(32), lower(trim(category)))')} IS NOT NULL THEN {by_severity('coalesce(severity, 3)', P.EVAL_SCORES)} ELSE 0.8::DOUBLE END AS e_conf, "
                "CASE WHEN event_type <> 'alert' THEN 'flow' "
                "WHEN signature_id IN (2016149, 2016150) OR coalesce(severity, 3) = 3 OR lower(trim(category)) = 'misc activity' OR starts_with(lower(trim(signature)), 'et info ') THEN 'alert-info' ELSE 'alert' END AS e_src, "
                "((src_ip IN (SELECT ip FROM attackers) OR dest_ip IN (SELECT ip FROM attackers)) "
                "AND EXISTS (SELECT 1 FROM windows w WHERE ev.t_us // 1000000 BETWEEN w.start_s AND w.end_s)) AS in_attack FROM ev",
    "evalrows": flow_features(
        "evalbase", "eval",
        "*, CASE WHEN in_attack THEN 'attacker_window' ELSE e_label END AS auto_label, "
        "CASE WHEN in_attack THEN 0.95::DOUBLE ELSE e_conf END AS auto_label_conf, "
        "CASE WHEN in_attack THEN 'attacker_ip_window' ELSE e_src END AS label_sources, "
        "CASE WHEN NOT in_attack AND e_label = 'benign' THEN 0 ELSE 1 END AS y_attack"),
    "vfeat": flow_features("ev", "vector"),
    "runtime": "SELECT event_id, event_type, src_port::DOUBLE AS src_port, dest_port::DOUBLE AS dest_port, "
               "CASE WHEN lower(proto) = 'tcp' THEN 1.0::DOUBLE ELSE 0 END AS proto_tcp, CASE WHEN lower(proto) = 'udp' THEN 1.0::DOUBLE ELSE 0 END AS proto_udp, "
               "flow_duration, fwd_pkts_tot::DOUBLE AS fwd_pkts_tot, bwd_pkts_tot::DOUBLE AS bwd_pkts_tot, "
               "fwd_data_pkts_tot::DOUBLE AS fwd_data_pkts_tot, bwd_data_pkts_tot::DOUBLE AS bwd_data_pkts_tot, "
               "fwd_pkts_per_sec, bwd_pkts_per_sec, flow_pkts_per_sec, down_up_ratio, "
               "hour(ts_local)::DOUBLE AS hour, (isodow(ts_local) - 1)::DOUBLE AS weekday, "
               "length(trim(coalesce(signature, '')))::DOUBLE AS sig_len, "
               f"(CASE WHEN trim(coalesce(signature, '')) = '' THEN 0 ELSE {hash32('trim(signature)')} % 1000 END)::DOUBLE AS sig_hash FROM vfeat",
    "split": f"SELECT *, row_number() OVER (ORDER BY {hash32(SEEDED_ID)}, event_id) <= floor(count(*) OVER () * 0.8::DOUBLE) AS is_train FROM runtime",
    # profiling input: all flow features with the signature of every row
    "prof": f"""SELECT *, CASE WHEN status = 'benign' THEN 'benign' {' '.join(
        f"WHEN {any_word('lower(signature)', w)} THEN {_lit('bruteforce' if n == 'brute' else n)}" for n, w in P.PROFILE_KEYWORDS.items())}
        ELSE 'unknown' END AS cls FROM (SELECT *, dest_port AS dst_port,
        CASE WHEN upper(signature) = 'BENIGN_FLOW' OR signature = '' THEN 'benign' ELSE 'attack' END AS status FROM evfeat) q""",
    "bucketed": "SELECT *, CASE WHEN cls IN ('benign', 'scan', 'dos') THEN cls "
                "WHEN cls IN ('bruteforce', 'unknown') AND dst_port = 22 THEN 'bruteforce' "
                "WHEN cls = 'bruteforce' AND NOT (SELECT coalesce(bool_or(cls IN ('bruteforce', 'unknown') AND dst_port = 22), FALSE) FROM prof) THEN 'bruteforce' END AS bucket FROM prof",
}

RECURSIVE = {"opened", "opened60", "sent", "chained"}


def _needs(sql: str, own: str | None = None) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", re.sub(r"'[^']*'", "", sql)))
    return [n for n in CTES if n in words and n != own]


def sql(select: str, extra: dict[str, str] | None = None) -> str:
    """``select`` preceded by the named queries it needs, directly or through others."""
    extra = extra or {}
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _needs(CTES[name], name):
            visit(dep)
        order.append(name)

    for body in [*extra.values(), select]:
        for name in _needs(body):
            visit(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({b})" for n, b in extra.items()]
    head = "WITH RECURSIVE " if RECURSIVE & {*order, *extra} else "WITH "
    return (head + ", ".join(parts) + " " if parts else "") + select
