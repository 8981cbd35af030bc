"""Blocks on streams: requests open them, commands and time close them.

Two inputs, block requests and unblock commands, are merged per address in event time.  The joint
watermark is the lesser of both, so nothing is decided before either input has come that far,
whatever order rows arrive in.  Keyed state holds what still waits for the watermark and the open
block, with event-time timers for both; an address without either has no state.

Requests of one address are folded to one row per second in each task before they are dealt by
address, so a hot address costs the keyed operator rows by seconds and not by requests.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..params import DEFAULTS, Params
from .follow import drain

OUTPUT = "ip string, block_us long, unblock_us long, released boolean, reason string, confidence double, event_id long"
FOLD_US = 1_000_000
COMMAND, REQUEST = 0, 1
_COLUMNS = [f.split()[0] for f in OUTPUT.split(", ")]
_LISTS = "times array<long>, reasons array<string>, confidences array<double>, ids array<long>"
_BLOCK = "block_us long, unblock_us long, reason string, confidence double, event_id long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per address, kind and second: its distinct instants in order, each with the smallest event id."""
    for pdf in frames:
        pdf = pdf.sort_values(["ip", "kind", "t_us", "event_id"], kind="stable").drop_duplicates(["ip", "kind", "t_us"])
        rows = [
            (ip, kind, part["t_us"].iloc[-1], *[part[c].tolist() for c in ("t_us", "reason", "confidence", "event_id")])
            for (ip, kind, _), part in pdf.groupby(["ip", "kind", pdf["t_us"] // FOLD_US], sort=False)
        ]
        if rows:
            yield pd.DataFrame(rows, columns=["ip", "kind", "last_us", "times", "reasons", "confidences", "ids"])


def _input(df: DataFrame, kind: int, delay: str) -> DataFrame:
    """Folded rows with a watermark on their last instant; rows without an address or a time are left out."""
    known = df.filter("ip IS NOT NULL AND t_us IS NOT NULL")
    if kind == COMMAND:
        known = known.selectExpr("ip", "t_us", "CAST(NULL AS STRING) AS reason", "CAST(NULL AS DOUBLE) AS confidence", "0L AS event_id")
    rows = known.selectExpr("ip", "t_us", "reason", "confidence", "event_id", f"{kind} AS kind")
    folded = rows.mapInPandas(_fold, f"ip string, kind int, last_us long, {_LISTS}")
    return folded.withColumn("ts", F.timestamp_micros("last_us")).drop("last_us").withWatermark("ts", delay)


def follow_blocks(
    open_block: tuple | None, requests: list[tuple], commands: list[int], upto: int, length: int
) -> tuple[list[tuple], tuple | None]:
    """Blocks opened and released up to an instant, and the one still open.

    ``requests`` (t_us, reason, confidence, event_id) and ``commands`` are in order and not after
    ``upto``.  A command ends the block opened before it; a request at the same instant opens a new one.
    """
    out, at, since = [], 0, None
    times = [r[0] for r in requests]
    while True:
        if open_block is None:
            at = bisect_left(times, since, at) if since is not None else at
            if at == len(times):
                return out, None
            t, reason, confidence, event_id = requests[at]
            open_block = (t, t + length, reason, confidence, event_id)
            out.append((t, t + length, False, reason, confidence, event_id))
        start, end, *rest = open_block
        stop = bisect_right(commands, start)
        if stop < len(commands):
            end = min(end, commands[stop])
        if end > upto:
            return out, open_block
        out.append((start, end, True, *rest))
        open_block, since = None, end


class BlockProcessor(StatefulProcessor):
    """State of an address: ``pending`` rows after the watermark and the open ``block``."""

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", f"kind int, {_LISTS}")
        self.block = handle.getValueState("block", _BLOCK)

    def _wake(self, t_us: int) -> None:
        self.handle.registerTimer(-(-t_us // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, first = [], None
        for pdf in rows:
            for kind, *lists in pdf[["kind", "times", "reasons", "confidences", "ids"]].itertuples(index=False, name=None):
                lists = [list(x) for x in lists]
                late = bisect_right(lists[0], passed)  # of a folded row, what the watermark has passed
                if late < len(lists[0]):
                    first = lists[0][late] if first is None else min(first, lists[0][late])
                    waiting.append((int(kind), [int(t) for t in lists[0][late:]], lists[1][late:], lists[2][late:], [int(i) for i in lists[3][late:]]))
        if waiting:
            self.pending.appendList(waiting)
            self._wake(int(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        requests: dict[int, tuple] = {}
        commands, later = set(), []
        for kind, times, reasons, confidences, ids in self.pending.get() if self.pending.exists() else ():
            now = bisect_right(times, upto)
            if kind == COMMAND:
                commands.update(times[:now])
            else:
                for r in zip(times[:now], reasons, confidences, ids):
                    if r[0] not in requests or r[3] < requests[r[0]][3]:
                        requests[r[0]] = r
            if now < len(times):
                later.append((kind, list(times[now:]), list(reasons[now:]), list(confidences[now:]), list(ids[now:])))
        held = tuple(self.block.get()) if self.block.exists() else None
        out, block = follow_blocks(held, [requests[t] for t in sorted(requests)], sorted(commands), upto, self.length)
        if later:
            self.pending.put(later)
            self._wake(min(x[1][0] for x in later))
        else:
            self.pending.clear()
        if block is not None:
            self.block.update(block)
            self._wake(block[1])
        else:
            self.block.clear()
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=_COLUMNS)

    def close(self) -> None:
        pass


def block_events(
    requests: DataFrame, commands: DataFrame | None = None, block_us: int | None = None,
    params: Params = DEFAULTS, delay: str = "10 seconds",
) -> DataFrame:
    """A row for every block when it opens (``released`` false, with its planned end) and when it ends (true).

    ``requests`` is a stream of ``ip, t_us, reason, confidence, event_id`` without whitelisted
    addresses, ``commands`` one of ``ip, t_us``.  Rows come out when the joint watermark passes
    them, in any chunking the same as ``block_intervals`` gives for the table.  Rows at or before
    the watermark are late (it starts at 1970); Spark drops and counts them.  Without rows nothing
    comes out.  After a restart the joint watermark goes on once both inputs have brought rows.
    """
    both = _input(requests, REQUEST, delay)
    if commands is not None:
        both = both.unionByName(_input(commands, COMMAND, delay))
    length = params.block_us if block_us is None else block_us
    return both.groupBy("ip").transformWithStateInPandas(BlockProcessor(length), OUTPUT, "append", "eventTime")


def write_blocks(events: DataFrame, path: str, checkpoint: str) -> None:
    """Handles whatever has arrived, then stops: rows are added to a Parquet table, exactly once after a restart."""
    spark = events.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # timers need it; a query keeps the one that it has begun with
    try:
        writer = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        drain(writer.outputMode("append"))
    finally:
        spark.conf.set(_PROVIDER, before)


def active_at(events: DataFrame, at_us: int) -> DataFrame:
    """Blocks in force at an instant that the watermark has passed, from the table that ``write_blocks`` keeps."""
    ends = events.groupBy("ip", "block_us").agg(F.min("unblock_us").alias("unblock_us"))
    return ends.filter((F.col("block_us") <= at_us) & (F.col("unblock_us") > at_us))


def follow_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Block requests out of a growing Parquet table of decisions, such as ``DetectStream`` writes."""
    schema = "src_ip string, t_us long, should_block boolean, reason string, confidence double, event_id long"
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)
    return rows.filter("should_block").selectExpr("src_ip AS ip", "t_us", "reason", "confidence", "event_id")
