"""Rows at rest on shelves, visitors streamed past them.

A shelf is a bounded set of rows, named by a key.  Its rows and the visitors sent to it are dealt
to one task, the shelf's rows first, so a task holds one shelf and a batch of visitors at a time
however many there are.  Visitors of a shelf can be spread over several copies of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SHELF_ROWS = 8192
VISITORS = 65_536


def matrix(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    column = batch.column(batch.schema.get_field_index(name))
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in chunks if len(c)]
    return np.concatenate(parts) if parts else np.zeros((0, 0))


def numbers(batch: pa.RecordBatch | pa.Table, name: str, null: float = 0) -> np.ndarray:
    """A column of numbers, ``null`` in place of nulls."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.fill_null(null).to_numpy() if isinstance(column, pa.ChunkedArray) else column.fill_null(null).to_numpy(zero_copy_only=False)


def missing(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name)).is_null()
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def shelved(rows: DataFrame, keys: Sequence[str], place: Column, shelf_rows: int = SHELF_ROWS) -> DataFrame:
    """``rows`` with ``shelf``: those of equal ``keys``, cut by the hash ``place`` into parts of about ``shelf_rows``."""
    sizes = stored(rows.groupBy(*keys).agg(F.ceil(F.count("*") / shelf_rows).cast("int").alias("parts")))
    sizes = sizes.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    part = F.pmod(place, F.col("parts")).cast("int")
    return rows.join(sizes, on).withColumn("shelf", F.concat_ws(":", *keys, part)).drop("parts", *[f"_{k}" for k in keys])


def _runs(keys: list) -> Iterator[tuple[int, int]]:
    at = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[at]:
            yield at, i
            at = i


def visit(
    at_rest: DataFrame,
    visitors: DataFrame,
    begin: Callable[[pa.Table], object],
    meet: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]],
    schema: str,
    order: Sequence[str] = (),
    spread: int = 1,
    ending: Callable[[object], Iterator[pa.RecordBatch]] | None = None,
) -> DataFrame:
    """What ``meet`` gives for all visitors; both tables have ``shelf`` (string) and columns of their own.

    ``begin`` makes of a shelf's rows what its visitors meet; visitors come in ``order``; those of a
    shelf without rows meet nothing.  With ``spread`` copies of each shelf, visitors are dealt by the
    hash of ``at`` (bigint) to one of them.  ``ending`` is called after a shelf's last visitor.
    """
    spark = at_rest.sparkSession
    copies = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    rest = at_rest.withColumn("_copy", copies if spread > 1 else F.lit(0)).withColumn("_kind", F.lit(0))
    copy = F.pmod(F.xxhash64("at"), F.lit(spread)).cast("int") if spread > 1 else F.lit(0)
    both = rest.unionByName(visitors.withColumn("_copy", copy).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(parts, "shelf", "_copy").sortWithinPartitions("shelf", "_copy", "_kind", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, shelf = None, [], None
        for b in batches:
            names = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("shelf", "_copy", "_kind")]
            for a, z in _runs(list(zip(*names))):
                key, kind = (names[0][a], names[1][a]), names[2][a]
                if key != now:
                    if shelf is not None and ending is not None:
                        yield from ending(shelf)
                    now, waiting, shelf = key, [], None
                part = b.slice(a, z - a)
                if kind == 0:
                    waiting.append(part)
                    continue
                if shelf is None and waiting:
                    shelf, waiting = begin(pa.Table.from_batches(waiting)), []
                if shelf is not None:
                    yield from meet(shelf, part)
        if shelf is not None and ending is not None:
            yield from ending(shelf)

    return dealt.mapInArrow(run, schema)


def spread_over(visitors: int, most: int = VISITORS) -> int:
    """Copies of each shelf, so that a copy meets about ``most`` visitors at the most."""
    return max(1, -(-visitors // most))
