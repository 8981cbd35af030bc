"""The detection pipeline on streams: the batch plan over final rows, with the past in four carry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import admit_alerts, split_events
from ..operators.joins import FLOW_CARRY, flow_keys
from ..operators.scan import materialise
from ..operators.windows import STAMPS, source_stamps
from ..params import DEFAULTS, Params
from ..plans.detect import OPENED, History, Model, detect_with
from .carry import CarryStream
from .dedup import last_sent


def latest_flows(flows: DataFrame, oldest_us: int) -> DataFrame:
    """Flows that are the latest of one of their look-up keys and not older than ``oldest_us``."""
    recent = flows.filter(F.col("t_us") >= oldest_us)
    keyed = recent.select("t_us", "event_id", F.explode(flow_keys()).alias("_k")).select("t_us", "event_id", "_k.key")
    newest = keyed.groupBy("key").agg(F.max("t_us").alias("_t")).withColumnRenamed("key", "_key")
    at_newest = keyed.join(newest, (F.col("key") == F.col("_key")) & (F.col("t_us") == F.col("_t")))
    ids = at_newest.groupBy("key").agg(F.max("event_id").alias("_id")).select("_id").distinct()
    return recent.join(ids, F.col("event_id") == F.col("_id"), "left_semi")


class DetectStream(CarryStream):
    """Decisions with block and notification flags; ``advance`` handles whatever has arrived."""

    held = {
        "flows": FLOW_CARRY,
        "stamps": STAMPS,
        "sent": "src_ip string, signature string, t_us long",
        "opened": OPENED,
    }

    def __init__(self, spark: SparkSession, landing: str, work: str, model: Model, params: Params = DEFAULTS, **options):
        super().__init__(spark, landing, work, **options)
        self.model, self.params = model, params

    def process(self, final, since, upto, held):
        p = self.params
        past = History(since, held["flows"], held["stamps"], held["sent"], held["opened"])
        found, opened, sent = detect_with(final, self.model, p, past)
        flows, alerts = split_events(final)
        names = [f.split()[0] for f in FLOW_CARRY.split(", ")]
        all_flows = materialise(flows.select(*names).unionByName(held["flows"]))
        stamps = source_stamps(flows, admit_alerts(alerts, p)).unionByName(held["stamps"])
        longest = max(p.flow_window_us, p.alert_window_us, p.hit_window_us, p.syn_hit_window_us)
        blocks = opened.unionByName(held["opened"]).filter(F.col("t_us") > upto - p.block_us)
        return found, {
            "flows": latest_flows(all_flows, upto - p.flow_ttl_us),
            "stamps": stamps.filter(F.col("t_us") >= upto - longest),
            "sent": last_sent(sent, held["sent"], upto, p.notify_gap_us),
            "opened": blocks,
        }
