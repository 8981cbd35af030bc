"""Evaluation rows from a stream: stateless, append only."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.tables import eval_rows


def write_eval_stream(
    events: DataFrame, path: str, checkpoint: str,
    attackers: DataFrame | None = None, windows: DataFrame | None = None, all_events: bool = False, keep=(),
):
    """Stream writer that appends evaluation rows to a Parquet table; start it or drain it."""
    rows = eval_rows(events, attackers, windows, all_events, keep)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
