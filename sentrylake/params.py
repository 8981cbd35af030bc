"""Fixed values and run-time parameters."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Word lists, maps, limits and formats that results depend on.
# ---------------------------------------------------------------------------

# Signature keywords of the three attack classes, tested in this order.
SIGNATURE_KEYWORDS = {
    "scan": ("scan", "portscan", "masscan", "nmap", "xmas scan", "syn scan", "fin scan", "null scan"),
    "bruteforce": ("brute", "bruteforce", "dictionary", "credential stuffing",
                   "password guess", "hydra", "medusa", "patator"),
    "dos": ("dos", "denial of service", "ddos", "flood",
            "syn flood", "icmp flood", "udp flood", "slowloris", "slow http"),
}

# Keywords used for profiling; note the other order and the other words.
PROFILE_KEYWORDS = {
    "scan": ("scan", "portscan", "nmap", "masscan"),
    "dos": ("dos", "denial of service", "flood", "syn flood", "udp flood"),
    "brute": ("brute", "dictionary", "guess", "hydra", "ssh brute"),
}

# Alert text to class, tested in this order on lower-case text.
ALERT_TEXT_MAP = (
    ("ssh brute force", "bruteforce"),
    ("bruteforce", "bruteforce"),
    ("dos", "dos"),
    ("ddos", "dos"),
    ("scan", "scan"),
    ("port scan", "scan"),
)

# Scores by alert severity; the second entry is the score for any other severity.
LIVE_MAP_SCORES = ({1: 0.95, 2: 0.9, 3: 0.85}, 0.9)
LIVE_KEYWORD_SCORES = ({1: 0.95, 2: 0.9, 3: 0.85}, 0.85)
EVAL_SCORES = ({1: 0.96, 2: 0.92}, 0.90)

# Informational alerts in evaluation labelling.
INFO_SIGNATURE_IDS = (2016149, 2016150)
INFO_CATEGORIES = ("misc activity",)
INFO_PREFIXES = ("et info ",)

# Alerts that never lead to a block by repetition.
ALLOW_CATEGORIES = ("INFO",)
ALLOW_SIGNATURE_WORDS = ("STUN", "Session Traversal Utilities for NAT", "Binding Response")
ALLOW_UDP_PORTS = (3478,)

IGNORED_SIGNATURES = (
    "SURICATA Applayer Detector failed",
    "SURICATA STREAM ESTABLISHED",
    "SURICATA TLS invalid record",
    "SURICATA STREAM TIMEWAIT",
    "SURICATA UDPv4 invalid checksum",
    "SURICATA ICMPv6 unknown type",
)

# Label precedence and the labels that count as attacks.
LABEL_ORDER = ("dos", "bruteforce", "scan", "anomaly", "benign")
ATTACK_LABELS = ("dos", "bruteforce", "scan", "anomaly")

ICMP_NAMES = ("icmp", "ipv4-icmp", "ipv6-icmp", "icmpv6")

# Column precedence when a binary label is derived from a data set.
LABEL_PRIORITY = ("label", "y_attack", "auto_label", "status", "action", "threat_score")
POSITIVE_STATUS = ("blocked", "detected", "alert")

# Column aliases in profiling input (source name, target name).
COLUMN_ALIASES = (
    ("dest_port", "dst_port"),
    ("destination_port", "dst_port"),
    ("dport", "dst_port"),
    ("sport", "src_port"),
    ("source_port", "src_port"),
    ("alert.signature", "signature"),
    ("sig", "signature"),
    ("signatures", "signature"),
    ("proto", "protocol"),
)
LABEL_SYNONYMS = {
    "normal": "benign",
    "benign_flow": "benign",
    "bruteforce": "brute",
    "bruteforce-ssh": "brute",
    "dos/hping3": "dos",
    "attack": "attack",
}

PROFILE_FEATURES = ("flow_pkts_per_sec", "fwd_pkts_tot", "bwd_pkts_tot", "flow_duration", "dst_port")
PROFILE_QUANTILES = (0.50, 0.90, 0.95, 0.98, 0.99, 1.0)

HASH_BUCKETS_SIGNATURE = 1000
HASH_BUCKETS_IP = 10000


@dataclass(frozen=True)
class CostRecord:
    """Reward of each (action, label) pair; ``other`` is used for any other pair."""

    tp: float = 2.0
    tn: float = 0.5
    fp: float = -6.0
    fn: float = -2.5
    other: float = -1.0


ENV_COST = CostRecord()
TRAINING_COST = CostRecord(fp=-3.5, fn=-5.0)


@dataclass(frozen=True)
class Params:
    """Run-time parameters; the defaults are the published defaults of the pipeline."""

    local_ip: str = "192.168.38.10"
    home_net: str = "192.168.38.0/24"
    whitelist: tuple[str, ...] = ("127.0.0.1", "192.168.1.1")
    ignored_signatures: tuple[str, ...] = IGNORED_SIGNATURES

    # flow rules
    dos_pps: float = 3555.0
    dos_fwd: int = 40
    scan_duration: float = 0.20
    scan_bwd: int = 2
    brute_fwd_min: int = 4
    brute_bwd_max: int = 3

    # benign capture
    flow_min_pkts: int = 4
    flow_min_bytes: int = 600
    benign_sample_rate: float = 0.15

    # enrichment
    flow_ttl_us: int = 900_000_000

    # per-source windows
    flow_window_us: int = 10_000_000
    alert_window_us: int = 5_000_000
    hit_window_us: int = 30_000_000
    syn_hit_window_us: int = 2_000_000
    min_hits: int = 3

    # decisions
    min_confidence: float = 0.70
    auto_confidence: float = 0.90
    monitoring_on: bool = True
    notify_gap_us: int = 10_000_000
    block_us: int = 86_400_000_000

    # physical layout: width of the time slices that hot keys are split into
    slice_us: int = 10_000_000


DEFAULTS = Params()


@dataclass(frozen=True)
class ProfileDefaults:
    """Thresholds suggested when a bucket has no rows."""

    scan_dur: float = 1.0
    scan_bwd: int = 2
    bf_fwd_min: int = 12
    bf_bwd_max: int = 4


PROFILE_DEFAULTS = ProfileDefaults()
