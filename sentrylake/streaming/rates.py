"""Per-source counts in sliding event-time windows; the same plan on tables and streams.

Events are first counted in panes, one per source and step.  Panes then meet in blocks of windows that
overlap by one window less a step, and each block adds its panes up to its windows.  So an event
is one row until its pane is counted, and a pane about one row after, where a sliding window makes
as many rows of each event as it has steps.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 60  # windows of a block
_UNITS = {"millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000}


def micros_of(duration: str) -> int:
    """Microseconds of a text such as "10 seconds"."""
    number, unit = duration.split()
    return int(number) * _UNITS[unit.rstrip("s")]


def windowed_source_rates(events: DataFrame, length: str = "10 seconds", step: str = "1 second",
                          watermark: str = "30 seconds") -> DataFrame:
    """Flows and alerts of each source per window (``window_start_us`` marks its begin).

    On a stream this is two aggregations in a row, for append mode: a block of ``BLOCK`` windows
    comes out, final, when the watermark has passed its end.  Rows without a time are left out.
    """
    size, stride = micros_of(length), micros_of(step)
    pane = math.gcd(size, stride)
    block = BLOCK * stride
    micros = lambda n: f"{n} microseconds"
    timed = (
        events.filter(F.col("event_type").isin("flow", "alert"))
        .select(F.timestamp_micros("t_us").alias("ts"), "src_ip", "event_type")
        .withWatermark("ts", watermark)
    )
    panes = timed.groupBy(F.window("ts", micros(pane)), "src_ip").agg(
        F.count_if(F.col("event_type") == "flow").alias("f"), F.count_if(F.col("event_type") == "alert").alias("a"),
    )
    # a block's windows reach over the panes of the block and of what its last window has beyond it
    blocks = panes.groupBy(F.window(F.window_time("window"), micros(block + size - stride), micros(block)).alias("block"), "src_ip").agg(
        F.collect_list(F.struct(F.unix_micros("window.start").alias("p"), "f", "a")).alias("panes")
    )
    rows = blocks.select("src_ip", F.unix_micros("block.start").alias("b"), "panes")
    # the windows that hold a pane: from the first that reaches it to the last that begins with it
    starts = f"""array_distinct(flatten(transform(panes, x -> sequence(
        greatest(b, x.p + {pane} - {size} + pmod({size} - {pane} - x.p, {stride}L)),
        least(b + {block - stride}, x.p - pmod(x.p, {stride}L)), {stride}L))))"""
    total = lambda c: f"aggregate(panes, 0L, (s, x) -> s + IF(x.p >= w AND x.p < w + {size}, x.{c}, 0L))"
    each = rows.select("src_ip", "panes", F.expr(f"explode({starts}) AS w"))
    return each.selectExpr("w AS window_start_us", "src_ip", f"{total('f')} AS n_flows", f"{total('a')} AS n_alerts")
