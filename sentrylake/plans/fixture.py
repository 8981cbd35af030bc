"""Event records derived from the ``events`` table, with the same text for Spark and DuckDB."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros_to_ntz
from ..operators.scan import checkpoint_root, materialise
from ..params import DEFAULTS

_BASE = """event_id; user_id; event_type AS kind; CAST({K} AS BIGINT) AS k;
{EPOCH_US} AS orig_us;
{STEP} + 1704067200000000 AS t_us;
CAST(FLOOR(value) AS BIGINT) AS v"""

_EVENT = """event_id; t_us; orig_us; k;
CASE WHEN kind IN ('view','click') THEN 'flow' WHEN kind IN ('error','purchase') THEN 'alert' ELSE 'dns' END AS event_type;
CONCAT('10.', CAST({NET} AS STRING), '.', CAST({SUBNET} % 250 AS STRING), '.', CAST(user_id % 250 + 1 AS STRING)) AS src_ip;
CASE WHEN event_id % 5 = 0 THEN '203.0.113.7' WHEN event_id % 5 < 4 THEN '192.168.38.10' ELSE CONCAT('192.168.38.', CAST(20 + event_id % 100 AS STRING)) END AS dest_ip;
CAST(40000 + k % 2 AS INT) AS src_port;
CASE k % 7 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 3478 WHEN 4 THEN 22 WHEN 5 THEN 8080 ELSE 0 END AS dest_port;
CASE WHEN k % 4 < 2 THEN 'TCP' WHEN k % 4 = 2 THEN 'UDP' ELSE 'ICMP' END AS proto;
CASE WHEN k % 3 <> 0 THEN user_id * 10 + k % 10 END AS flow_id;
CASE WHEN k % 5 = 0 THEN CONCAT('1:', CAST(user_id AS STRING), ':', CAST(k % 10 AS STRING)) END AS community_id;
v AS pkts_toserver; k % 11 AS pkts_toclient; v * 60 AS bytes_toserver; k * 40 AS bytes_toclient;
t_us - CASE WHEN k % 10 = 0 THEN 0 WHEN k % 10 = 1 THEN v * 100 WHEN k % 10 < 5 THEN 50000 ELSE v * 10000 + 500000 END AS start_us;
t_us AS end_us;
CASE k % 12 WHEN 0 THEN 'ET SCAN Nmap TCP scan' WHEN 1 THEN 'SSH brute force attempt' WHEN 2 THEN 'GPL DOS SYN flood' WHEN 3 THEN 'ET INFO STUN Binding Response' WHEN 4 THEN 'SURICATA STREAM ESTABLISHED invalid ack' WHEN 5 THEN '' WHEN 6 THEN 'ET POLICY Unusual user agent' WHEN 7 THEN 'hydra dictionary login' WHEN 8 THEN 'UDP flood inbound' WHEN 9 THEN 'SYN flood detected' WHEN 10 THEN 'portscan sweep' ELSE 'ET TROJAN Beacon' END AS signature;
CASE k % 6 WHEN 0 THEN 'Detection of a Network Scan' WHEN 1 THEN 'Misc activity' WHEN 2 THEN 'Attempted DoS' WHEN 3 THEN '' WHEN 4 THEN 'INFO' ELSE 'Bruteforce' END AS category;
CAST(1 + k % 3 AS INT) AS severity;
CASE k % 25 WHEN 7 THEN 2016149 WHEN 19 THEN 2016150 ELSE 2000000 + k END AS signature_id"""

# Floor divisions: by whole numbers in Spark, where a decimal quotient a row costs more than the rest of the event.
SPARK_MACROS = {
    "STEP": "(({EPOCH_US} - 1704067200000000 - pmod({EPOCH_US} - 1704067200000000, 5000L)) div 5000L)",
    "NET": "((user_id - pmod(user_id, 62500L)) div 62500L)",
    "SUBNET": "((user_id - pmod(user_id, 250L)) div 250L)",
    "K": "get_json_object(props, '$.k')",
    "EPOCH_US": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))",
}
DUCKDB_MACROS = {
    "STEP": "CAST(FLOOR(({EPOCH_US} - 1704067200000000) / 5000.0) AS BIGINT)",
    "NET": "CAST(FLOOR(user_id/62500.0) AS BIGINT)",
    "SUBNET": "CAST(FLOOR(user_id/250.0) AS BIGINT)",
    "K": "json_extract_string(props, '$.k')",
    "EPOCH_US": "epoch_us(ts)",
}

LOCAL_OFFSET_US = 7 * 3600 * 1_000_000  # events carry wall clocks at +07:00

# Attack sources and windows (inclusive epoch seconds; they overlap on purpose).
ATTACKERS = ("10.0.0.9", "10.0.0.50")
WINDOWS = ((1704067200, 1704067320), (1704067300, 1704067400))
SNAPSHOT_US = 1704067200000000 + 300_000_000

FIXTURE_PARAMS = replace(DEFAULTS, whitelist=("10.0.0.1",))


def _exprs(template: str, macros: dict[str, str]) -> list[str]:
    text = template
    for name, value in macros.items():
        text = text.replace("{" + name + "}", value)
    return [part.strip() for part in text.split(";")]


def duckdb_base() -> str:
    return f"SELECT {', '.join(_exprs(_BASE, DUCKDB_MACROS))} FROM events"


def duckdb_event() -> str:
    return f"SELECT {', '.join(_exprs(_EVENT, DUCKDB_MACROS))} FROM r"


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``events`` as an event; alert and flow fields are set on all rows."""
    base = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_exprs(_BASE, SPARK_MACROS))
    local = micros_to_ntz(F.col("t_us") + LOCAL_OFFSET_US)
    return base.selectExpr(*_exprs(_EVENT, SPARK_MACROS)).withColumns({
        "ts_local": local,
        "timestamp": F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0700'"),
    })


_FLOW_FIELDS = ("pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient", "start_us", "end_us")
_ALERT_FIELDS = ("signature", "category", "severity", "signature_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with alert fields only on alerts and flow fields only on flows and alerts."""
    raw = raw_events(spark, sf_dir)
    limited = {c: f"CASE WHEN event_type = 'alert' THEN {c} END AS {c}" for c in _ALERT_FIELDS}
    limited |= {c: f"CASE WHEN event_type <> 'dns' THEN {c} END AS {c}" for c in _FLOW_FIELDS}
    return raw.selectExpr(
        *[limited.get(c, c) for c in raw.columns],
        "event_type = 'alert' AS has_alert", "event_type <> 'dns' AS has_flow",
    )


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` written once as a table, for plans that read the events several times."""
    return materialise(events(spark, sf_dir))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'flow'")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'alert'")


def model(df: DataFrame) -> DataFrame:
    """Stand-in for a trained detector: acts on severities 1 and 2."""
    act = F.coalesce(F.col("severity"), F.lit(3)) <= 2
    return df.withColumns({
        "action": act.cast("int"), "confidence": F.when(act, F.lit(0.80)).otherwise(F.lit(0.75)),
    })


def attackers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a,) for a in ATTACKERS], "ip string")


def windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(w) for w in WINDOWS], "start_s long, end_s long")


def as_nested(flat: DataFrame) -> DataFrame:
    """Flat events as nested records."""

    def iso(c: str):
        return F.date_format(micros_to_ntz(F.col(c) + LOCAL_OFFSET_US), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0700'")

    flow = F.struct(
        iso("start_us").alias("start"), iso("end_us").alias("end"),
        "pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient",
    )
    alert = F.struct("signature", "category", "severity", F.col("signature_id").cast("bigint").alias("signature_id"))
    return flat.select(
        "event_id", "timestamp", "event_type", "src_ip", "dest_ip", "src_port", "dest_port", "proto",
        "community_id", "flow_id",
        F.when(F.col("has_flow"), flow).alias("flow"),
        F.when(F.col("has_alert"), alert).alias("alert"),
    )


def scratch(spark: SparkSession) -> str:
    """New folder below the cluster's checkpoint folder."""
    return f"{checkpoint_root(spark)}/sentrylake-{uuid.uuid4().hex}"


def write_json_lines(spark: SparkSession, sf_dir: str, path: str, noise: bool = False) -> str:
    """All events as newline JSON; ``noise`` adds a malformed and a blank line for every event."""
    lines = as_nested(events(spark, sf_dir)).select(F.to_json(F.struct("*")).alias("value"))
    if noise:
        lines = lines.select(F.explode(F.array(
            F.concat(F.lit("{broken "), F.substring("value", 1, 40)), F.lit(""), F.col("value")
        )).alias("value"))
    lines.write.text(path)
    return path


def write_chunk(spark: SparkSession, sf_dir: str, path: str, number: int, chunks: int = 3) -> str:
    """One of several JSON chunks, each later in time than the ones before it, but for late rows.

    A tenth of the rows of the last four seconds of a chunk comes with the next one, which is
    within the delay that streams allow.
    """
    flat = events(spark, sf_dir)
    span, start, late = 520_000_000 // chunks + 1, 1704067200000000, 4_000_000
    place = F.least(F.greatest(F.call_function("div", F.col("t_us") - start, F.lit(span).cast("bigint")), F.lit(0)), F.lit(chunks - 1))
    held = (F.col("t_us") - start - place * span >= span - late) & (F.col("event_id") % 10 == 3) & (place < chunks - 1)
    as_nested(flat.filter(place + held.cast("int") == number)).write.mode("append").json(path)
    return path


#: Extent of the times of all events, and the rows that ``write_rows_chunk`` lets come too late.
START_US, SPAN_US = 1704067200000000, 520_000_000
LATE = "event_id % 50 = 7"


def write_rows_chunk(rows: DataFrame, path: str, number: int, chunks: int = 3) -> str:
    """One of several Parquet chunks by ``t_us``; of the first one, ``LATE`` rows come with the last, after any watermark."""
    place = F.least(F.greatest(F.floor((F.col("t_us") - START_US) / (SPAN_US / chunks)), F.lit(0)), F.lit(chunks - 1))
    place = F.when((place == 0) & F.expr(LATE), F.lit(chunks - 1)).otherwise(place)
    rows.filter(place == number).write.mode("append").parquet(path)
    return path


def write_chunks(spark: SparkSession, sf_dir: str, path: str, chunks: int = 3) -> str:
    for i in range(chunks):
        write_chunk(spark, sf_dir, path, i, chunks)
    return path
