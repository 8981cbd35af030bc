"""Labelling rules as conditional expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from .text import contains_any, starts_with_any

CANDIDATE = "struct<label:string,score:double,src:string>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _chain(pairs, default: Column) -> Column:
    out = None
    for cond, value in pairs:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return default if out is None else out.otherwise(default)


def _score(severity: Column, table) -> Column:
    by_severity, other = table
    return _chain([(severity == s, F.lit(v)) for s, v in by_severity.items()], F.lit(other))


def candidate(label: Column, score: Column, src: str) -> Column:
    return F.struct(label.alias("label"), score.cast("double").alias("score"), F.lit(src).alias("src"))


def classify_signature(sig) -> Column:
    """SCAN, BRUTEFORCE, DOS or UNKNOWN; the first class with a keyword in the text wins."""
    text = F.lower(F.coalesce(_c(sig), F.lit("")))
    pairs = [(contains_any(text, words), F.lit(name.upper())) for name, words in P.SIGNATURE_KEYWORDS.items()]
    return _chain(pairs, F.lit("UNKNOWN"))


def _map_text(text: Column) -> Column:
    # a phrase is skipped when an earlier one with the same class already covers it
    pairs = [
        (k, v) for i, (k, v) in enumerate(P.ALERT_TEXT_MAP)
        if not any(o in k and c == v for o, c in P.ALERT_TEXT_MAP[:i])
    ]
    return _chain([(text.contains(k), F.lit(v)) for k, v in pairs], F.lit(None).cast("string"))


def label_alert_live(signature, category, severity) -> Column:
    """Candidate label of an alert on the live path; NULL when no rule matches."""
    sig, cat = _c(signature), _c(category)
    sev = F.coalesce(_c(severity), F.lit(2))
    text = F.lower(F.coalesce(F.nullif(cat, F.lit("")), sig, F.lit("")))
    mapped = _map_text(text)
    keyword = F.lower(classify_signature(sig))
    return (
        F.when(mapped.isNotNull(), candidate(mapped, _score(sev, P.LIVE_MAP_SCORES), "alert"))
        .when(keyword != "unknown", candidate(keyword, _score(sev, P.LIVE_KEYWORD_SCORES), "alert"))
    )


def label_alert_eval(signature, category, severity, signature_id, has_alert=None) -> Column:
    """Candidate label for the evaluation table; rows without an alert are benign."""
    sig = F.lower(F.trim(F.coalesce(_c(signature), F.lit(""))))
    cat = F.lower(F.trim(F.coalesce(_c(category), F.lit(""))))
    sev = F.coalesce(_c(severity), F.lit(3))
    sid = F.coalesce(_c(signature_id), F.lit(0))
    has_alert = F.lit(True) if has_alert is None else has_alert
    info = (
        sid.isin(*P.INFO_SIGNATURE_IDS)
        | (sev == 3)
        | cat.isin(*P.INFO_CATEGORIES)
        | starts_with_any(sig, P.INFO_PREFIXES)
    )
    mapped = _map_text(F.concat_ws(" ", sig, cat))
    return (
        F.when(~has_alert, candidate(F.lit("benign"), F.lit(0.50), "flow"))
        .when(info, candidate(F.lit("benign_info"), F.lit(0.20), "alert-info"))
        .when(mapped.isNotNull(), candidate(mapped, _score(sev, P.EVAL_SCORES), "alert"))
        .otherwise(candidate(F.lit("anomaly"), F.lit(0.80), "alert"))
    )


def label_flow_rules(duration, fwd, bwd, pps, dest_port, params: P.Params = P.DEFAULTS) -> Column:
    """Candidate label from flow features alone."""
    duration, fwd, bwd, pps = _c(duration), _c(fwd), _c(bwd), _c(pps)
    port = F.coalesce(_c(dest_port), F.lit(0))
    dos = (pps > params.dos_pps) | (fwd > params.dos_fwd)
    scan = (duration < params.scan_duration) & (bwd <= params.scan_bwd) & (port != 0)
    brute = (port == 22) & (fwd >= params.brute_fwd_min) & (bwd <= params.brute_bwd_max)
    return (
        F.when(dos, candidate(F.lit("dos"), F.lit(0.70), "flow"))
        .when(scan, candidate(F.lit("scan"), F.lit(0.65), "flow"))
        .when(brute, candidate(F.lit("bruteforce"), F.lit(0.60), "flow"))
        .otherwise(candidate(F.lit("benign"), F.lit(0.50), "flow"))
    )


def _rank(label: Column) -> Column:
    """Position in the precedence list, 99 for anything else."""
    pos = F.array_position(F.array(*[F.lit(x) for x in P.LABEL_ORDER]), F.coalesce(label, F.lit("")))
    return F.when(pos > 0, pos).otherwise(F.lit(99).cast("bigint"))


def resolve_pair(alert: Column, flow: Column) -> Column:
    """Resolve one alert candidate (may be NULL) and one flow candidate.

    Gives ``struct<label, confidence, sources>``.  Same meaning as :func:`resolve_candidates`
    for this common case, without higher-order functions.
    """
    alert, flow = _c(alert), _c(flow)
    la, lf, sa, sf = alert["label"], flow["label"], alert["score"], flow["score"]
    ra, rf = _rank(la), _rank(lf)
    agree = F.coalesce(la == lf, F.lit(False))
    alert_wins = alert.isNotNull() & (flow.isNull() | (ra < rf) | ((ra == rf) & (sa >= sf)))
    boosted = F.when(ra < 99, F.least(F.lit(1.0), F.greatest(sa, sf) + F.lit(0.1))).otherwise(F.greatest(sa, sf))
    empty = F.array().cast("array<string>")
    label = F.when(alert_wins, la).when(flow.isNotNull(), lf).otherwise(F.lit("benign"))
    confidence = (
        F.when(agree, boosted).when(alert_wins, F.least(F.lit(1.0), sa))
        .when(flow.isNotNull(), F.least(F.lit(1.0), sf)).otherwise(F.lit(0.40))
    )
    sources = (
        F.when(agree & (ra < 99), F.array_sort(F.array_distinct(F.array(alert["src"], flow["src"]))))
        .when(alert_wins, F.array(alert["src"]))
        .when(flow.isNotNull(), F.array(flow["src"]))
        .otherwise(empty)
    )
    return F.struct(label.alias("label"), confidence.alias("confidence"), sources.alias("sources"))


def resolve_candidates(candidates) -> Column:
    """Resolve an ``ARRAY<STRUCT<label, score, src>>`` of any length.

    The best label in precedence order wins; each further agreeing candidate adds 0.1 to the
    best score (at most 1).  Labels outside the precedence list count only when no listed label
    occurs; then the highest score wins unchanged.
    """
    cands = F.filter(F.coalesce(_c(candidates), F.array().cast(f"array<{CANDIDATE}>")), lambda x: x.isNotNull())
    label = F.coalesce(
        *[F.when(F.array_contains(F.transform(cands, lambda x: x["label"]), n), F.lit(n)) for n in P.LABEL_ORDER]
    )
    agree = F.filter(cands, lambda x: x["label"] == label)
    scores = F.transform(agree, lambda x: x["score"])
    top = F.try_element_at(
        F.array_sort(cands, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)), F.lit(1)
    )
    empty = F.array().cast("array<string>")
    none = F.size(cands) == 0
    return F.struct(
        F.when(none, F.lit("benign")).when(label.isNotNull(), label).otherwise(top["label"]).alias("label"),
        F.when(none, F.lit(0.40))
        .when(label.isNotNull(), F.least(F.lit(1.0), F.array_max(scores) + F.lit(0.1) * (F.size(agree) - 1)))
        .otherwise(top["score"]).alias("confidence"),
        F.when(none, empty)
        .when(label.isNotNull(), F.array_sort(F.array_distinct(F.transform(agree, lambda x: x["src"]))))
        .otherwise(F.array(top["src"])).alias("sources"),
    )


def binary_label(action, action_conf, label, label_conf, params: P.Params = P.DEFAULTS) -> Column:
    """``struct<y_attack, y_reason>``: the model decides first, then a strong automatic label."""
    model = (_c(action) == 1) & (_c(action_conf) >= params.min_confidence)
    auto = _c(label).isin(*P.ATTACK_LABELS) & (_c(label_conf) >= params.auto_confidence)
    model, auto = F.coalesce(model, F.lit(False)), F.coalesce(auto, F.lit(False))
    return F.struct(
        (model | auto).cast("int").alias("y_attack"),
        F.when(model, F.lit("drl")).when(auto, F.lit("auto")).otherwise(F.lit("none")).alias("y_reason"),
    )


def eval_binary(label) -> Column:
    """0 only for the label 'benign' (so informational alerts count as 1)."""
    return (F.lower(F.coalesce(_c(label), F.lit(""))) != "benign").cast("int")


def standardise_reason(c) -> Column:
    r = F.translate(F.lower(F.coalesce(_c(c), F.lit(""))), ".-", "__")
    return (
        F.when(r.contains("scan"), F.lit("scan"))
        .when(r.contains("brute"), F.lit("bruteforce"))
        .when(r.contains("dos") | r.contains("flood"), F.lit("dos"))
    )


def is_allowlisted(signature, category, proto, dest_port) -> Column:
    sig = F.upper(F.coalesce(_c(signature), F.lit("")))
    cat = F.upper(F.coalesce(_c(category), F.lit("")))
    udp = (F.upper(F.coalesce(_c(proto), F.lit(""))) == "UDP") & F.coalesce(_c(dest_port), F.lit(0)).isin(*P.ALLOW_UDP_PORTS)
    return cat.isin(*P.ALLOW_CATEGORIES) | contains_any(sig, [w.upper() for w in P.ALLOW_SIGNATURE_WORDS]) | udp


def normalise_attack_type(c) -> Column:
    c = _c(c)
    return F.when(c == "BRUTE", F.lit("BRUTEFORCE")).when(c == "DDoS", F.lit("DOS")).otherwise(c)
