"""Following a landing directory of closed log chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.columns import normalise_event
from ..schema import EVE
from ..sources.eve import usable


def read_eve_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of nested records from JSON chunks.

    Rotated chunks are the contract: a file is read once, when it is complete.
    """
    reader = spark.readStream.schema(EVE).option("mode", "PERMISSIVE")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return usable(reader.json(path))


def follow_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same as flat event columns."""
    return normalise_event(read_eve_stream(spark, path, files_per_trigger))


def drain(writer, timeout_s: int | None = None) -> StreamingQuery:
    """Processes everything that is available now, then stops; without ``timeout_s`` however long that takes."""
    query = writer.trigger(availableNow=True).start()
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"stream did not finish in {timeout_s} s")
    return query

