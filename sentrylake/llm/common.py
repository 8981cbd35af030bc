"""What the operators share: Arrow text access, held-out rows, bounded samples, column handling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import materialise as stored  # noqa: F401  (re-exported)

#: ASCII white space of all word rules here; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


def remainder(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as the empty text."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def buffers(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows, without copies of single texts."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def pieces(text: bytes, limit: int = 1 << 22) -> Iterator[bytes]:
    """The text in parts of about ``limit`` bytes, cut at white space, so that no word is cut."""
    at, n = 0, len(text)
    while n - at > limit:
        cut = max(text.rfind(w, at + 1, at + limit) for w in WHITE)
        if cut < 0:
            after = [x for x in (text.find(w, at + limit) for w in WHITE) if x >= 0]
            cut = min(after, default=n)
        yield text[at:cut]
        at = cut
    yield text[at:]


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The columns an operator reads; those that clash or are extra stay out of its way."""
    return docs.select(*[docs[n] for n in names])


def by_hash(df: DataFrame, want: int, total: int, *keys: str) -> DataFrame:
    """A share of the rows, chosen by a hash of ``keys``, that holds about twice ``want`` of ``total`` (all, if fewer).

    Taken before the ``want`` rows of least hash are, so that tasks do not each send that many.
    """
    share = 1.0 if total <= 0 else min(1.0, 2.0 * want / total)
    place = F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 40))
    return df if share >= 1.0 else df.filter(place < int(share * (1 << 40)))


def bounded_sample(labels: DataFrame, label: str, per_class: int, key: str = "doc_id") -> DataFrame:
    """At most ``per_class`` labelled keys of each class 0 and 1, chosen by hash: (key, y, n).

    Keys that are null or carry both labels take no part.  ``n`` is the number of labelled keys
    of the class, for weights.  The result is bounded by ``2 * per_class`` rows.
    """
    clear = (
        labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .groupBy(key).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("y_max"))
        .filter("y = y_max").select(key, "y")
    )
    sizes = {r.y: r.n for r in clear.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    picked = [
        by_hash(clear.filter(F.col("y") == y), per_class, sizes.get(y, 0), key).orderBy(F.xxhash64(key), key).limit(per_class)
        .withColumn("n", F.lit(sizes.get(y, 0)).cast("bigint")) for y in (0, 1)
    ]
    return picked[0].unionByName(picked[1])


def with_columns_last(docs: DataFrame, *new: str) -> list[Column]:
    """All columns of ``docs`` but those that the operator itself returns under the same name."""
    return [docs[c] for c in docs.columns if c not in new]
