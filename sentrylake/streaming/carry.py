"""Streams as ordered micro-batches over the batch operators.

A micro-batch is joined by what the one before left over.  Its rows up to the watermark (the
latest time stamp seen less the allowed delay) are final: they are put through the same operators
as a table, together with small carry tables that stand for all earlier rows.  Rows after the
watermark wait.  Rows that come when the watermark has passed them are written to a side table, those
without a time stamp to another.

Everything is written under the number of the micro-batch and replaced if that is run again.  No
key is gathered in one task: a hot source is split as in a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.eve import with_event_id
from .follow import drain, follow_events

START = -(1 << 62)


class CarryStream:
    """A stream over a landing directory.  Subclasses name their carry tables and process final rows."""

    #: Schemas of the carry tables by name.
    held: dict[str, str] = {}

    def __init__(self, spark: SparkSession, landing: str, work: str, delay_us: int = 10_000_000,
                 files_per_trigger: int | None = None):
        self.spark, self.work, self.delay_us = spark, work, delay_us
        self.events = follow_events(spark, landing, files_per_trigger)

    def process(self, final: DataFrame, since: int, upto: int, held: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
        """Output rows and new carry tables for the rows with ``since < t_us <= upto``."""
        raise NotImplementedError

    def advance(self) -> None:
        """Handles whatever has arrived, then stops; an ended stream takes no more rows."""
        if self._ended():
            raise ValueError(f"the stream at {self.work} has ended")
        drain(self.events.writeStream.foreachBatch(self._step).option("checkpointLocation", f"{self.work}/offsets"))

    def finish(self) -> None:
        """Ends the stream: rows still waiting for the watermark are final now.  Ending it again changes nothing."""
        last = self._last()
        if last is not None and not self._ended():
            self._run(last, 1 << 62, "final", self._held("pending", last))
            end = self.spark.createDataFrame([(last,)], "number long")
            end.coalesce(1).write.mode("overwrite").parquet(f"{self.work}/ended")

    def _ended(self) -> bool:
        return self._path(f"{self.work}/ended/_SUCCESS", lambda fs, path: fs.exists(path))

    def _path(self, name: str, act):
        """``act`` on a path with its file system."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        return act(path.getFileSystem(context._jsc.hadoopConfiguration()), path)

    def _forget(self, number: int) -> None:
        """State of a micro-batch that no retry can ask for any more."""
        for kind in ("came", "seen", "mark", "state/pending", *[f"state/{name}" for name in self.held]):
            self._path(self._at(kind, number), lambda fs, path: fs.delete(path, True))

    def result(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.work}/out")

    def late(self) -> DataFrame:
        """Rows that came after the watermark had passed them."""
        return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.work}/late")

    def untimed(self) -> DataFrame:
        """Rows without a time stamp that can be read, as they came."""
        return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.work}/untimed")

    def _at(self, kind: str, number: int | str) -> str:
        return f"{self.work}/{kind}/{number if isinstance(number, str) else f'{number:09d}'}"

    def _last(self) -> int | None:
        """Number of the latest micro-batch done."""
        try:
            marks = self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.work}/mark")
        except AnalysisException:  # nothing has arrived yet
            return None
        return marks.agg(F.max("number")).first()[0]

    def _held(self, name: str, number: int | None) -> DataFrame:
        schema = self.events.schema if name == "pending" else self.held[name]
        if number is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._at(f"state/{name}", number))

    def _step(self, batch: DataFrame, number: int) -> None:
        before = number - 1 if number > 0 else None
        since = START if before is None else self.spark.read.parquet(self._at("mark", before)).first().upto
        batch.write.mode("overwrite").parquet(self._at("came", number))  # the input is parsed once
        came = self.spark.read.schema(self.events.schema).parquet(self._at("came", number))
        came.filter("t_us IS NULL").write.mode("overwrite").parquet(self._at("untimed", number))
        named = with_event_id(came.filter("t_us IS NOT NULL"), number)
        named.write.mode("overwrite").parquet(self._at("seen", number))
        seen = self.spark.read.schema(self.events.schema).parquet(self._at("seen", number))
        seen.filter(F.col("t_us") <= since).write.mode("overwrite").parquet(self._at("late", number))
        latest = seen.agg(F.max("t_us")).first()[0]
        upto = since if latest is None else max(since, latest - self.delay_us)
        rows = self._held("pending", before).unionByName(seen.filter(F.col("t_us") > since))
        rows.filter(F.col("t_us") > upto).write.mode("overwrite").parquet(self._at("state/pending", number))
        self._run(before, upto, number, rows.filter(F.col("t_us") <= upto), since)
        mark = self.spark.createDataFrame([(number, upto)], "number long, upto long")
        mark.coalesce(1).write.mode("overwrite").parquet(self._at("mark", number))
        if number > 1:
            self._forget(number - 2)

    def _run(self, before: int | None, upto: int, number: int | str, final: DataFrame, since: int | None = None) -> None:
        if since is None:
            since = self.spark.read.parquet(self._at("mark", before)).first().upto
        held = {name: self._held(name, before) for name in self.held}
        out, kept = self.process(final, since, upto, held)
        out.write.mode("overwrite").parquet(self._at("out", number))
        if number != "final":
            for name, table in kept.items():
                table.write.mode("overwrite").parquet(self._at(f"state/{name}", number))
