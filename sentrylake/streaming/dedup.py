"""Notification suppression on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import admit_alerts, of_type
from ..operators.policy import dedup_notifications
from ..operators.scan import materialise
from ..params import DEFAULTS, Params
from .carry import CarryStream


def last_sent(sent: DataFrame, before: DataFrame, upto: int, gap_us: int) -> DataFrame:
    """The latest stamp announced per (src_ip, signature), as long as it can still suppress others."""
    both = sent.select("src_ip", "signature", "t_us").unionByName(before)
    return both.groupBy("src_ip", "signature").agg(F.max("t_us").alias("t_us")).filter(F.col("t_us") > upto - gap_us)


class DedupStream(CarryStream):
    """Stamps announced per (src_ip, signature) of the admitted alerts."""

    held = {"sent": "src_ip string, signature string, t_us long"}

    def __init__(self, spark: SparkSession, landing: str, work: str, params: Params = DEFAULTS, **options):
        super().__init__(spark, landing, work, **options)
        self.params = params

    def process(self, final, since, upto, held):
        admitted = admit_alerts(of_type(final, "alert"), self.params)
        stamps = admitted.select("src_ip", "signature", "t_us").unionByName(held["sent"])
        sent = materialise(dedup_notifications(stamps, params=self.params).filter(F.col("t_us") > since))
        return sent, {"sent": last_sent(sent, held["sent"], upto, self.params.notify_gap_us)}
