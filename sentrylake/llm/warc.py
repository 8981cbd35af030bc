"""WARC archives: writing, reading back, and an index merged from locally sorted runs.

Writing.  Payloads are digested (SHA-256); of records with equal payloads of at least ``least_bytes``
the one with the smallest id is a response and the others are revisits of it, without payload.  A
record is one string, and Spark's text writer puts the blank lines behind it that end a record, so
the files are plain WARC/1.1 in gzip, written by executors to any store that Spark can write.

Reading.  Whole files are read as bytes and cut by Content-Length, whatever the payload holds.  The
entries of a file, sorted by URL key and time, are a run.

Index.  Boundaries from a bounded sample cut every run into segments by (URL key, time, id), so one
URL with very many captures is spread as well.  The segments of a range meet in one task, where a
loser tree merges them; the ranges follow each other, which gives every capture its global position.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.scan import checkpoint_root
from ..functions.times import micros_to_ntz
from .common import by_hash, stored

LEAST_BYTES = 100
RECORDS_PER_FILE = 1000
RANGE_ROWS = 50_000
SAMPLE_ROWS = 20_000
END = "\r\n\r\n"
FIRST_SECOND = 1_704_067_200  # 2024-01-01T00:00:00Z, used where captures carry no time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column | str) -> Column:
    """A header line; line breaks in values are percent-encoded."""
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, html, at (epoch second) of ``pages``; where no time is given, the id after 2024-01-01."""
    at = F.lit(FIRST_SECOND) + F.coalesce(F.pmod(F.col("page_id"), F.lit(1_000_000_000)), F.lit(0))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), at.alias("at"))


def with_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``captures`` with payload_bytes, payload_digest, record_type and refers_to.

    Rows that repeat the id and payload of the response are responses again; a null id is never
    referred to.
    """
    rows = captures(pages).withColumns({
        "payload_bytes": F.octet_length("html").cast("bigint"), "payload_digest": F.sha2(F.col("html").cast("binary"), 256),
    })
    # only payloads that occur under several ids matter: what is joined stays small
    many = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("n")
    ).filter("n > 1 AND first_id IS NOT NULL").select(F.col("payload_digest").alias("of"), "first_id")
    again = stored(many)
    joined = rows.join(again, F.col("payload_digest") == F.col("of"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumns({
        "record_type": F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        "refers_to": F.when(revisit, F.col("first_id")),
    }).drop("of", "first_id")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(typed: DataFrame) -> DataFrame:
    """One column ``value``: the text of each record, without the blank lines at its end."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _line("Content-Type", "text/html; charset=utf-8"),
                    _line("Content-Length", F.col("payload_bytes")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", record_id(F.col("page_id"))),
        _line("WARC-Date", F.date_format(micros_to_ntz(F.col("at") * 1_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Target-URI", F.col("url")), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", record_id(F.col("refers_to"))), _line("WARC-Profile", PROFILE))).otherwise(F.lit("")),
        _line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", F.octet_length(block)), F.lit("\r\n"),
    )
    return typed.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archives of all pages below ``path``; a file holds at most ``records_per_file`` records."""
    typed = with_types(pages, least_bytes)
    records(typed).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


# ---------------------------------------------------------------------------
# reading
# ---------------------------------------------------------------------------


def url_key(url: str | None) -> str:
    """Sortable key: host labels reversed, then the rest; scheme, www, port and fragment are dropped."""
    rest = (url or "").strip().split("#", 1)[0]
    if "://" in rest:
        rest = rest.split("://", 1)[1]
    host, slash, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].split(":", 1)[0].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + slash + path


def parse(data: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """(headers, offset, length, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at offset {at}")
        head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        start = stop + 4
        size = int(head["content-length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at offset {at} does not end where it says")
        yield head, at, start + size - at, data[start : start + size]
        at = start + size + 4


FIELDS = (
    "page_id bigint, url_key string, at string, record_type string, payload_digest string, payload_bytes bigint, "
    "refers_to bigint, file string, offset bigint, length bigint"
)


def _id(text: str) -> int | None:
    text = text.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def _order(e: dict) -> tuple:
    return e["url_key"], e["at"], e["page_id"] is not None, e["page_id"] or 0, e["file"], e["offset"]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all archives below ``path``, each file's sorted; payload digests are computed anew and compared.

    Columns: FIELDS, and ``run`` (the file's number) and ``place`` in the run.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                file = name.as_py().rsplit("/", 1)[-1]
                out = []
                for head, offset, length, block in parse(gzip.decompress(content.as_py())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    if head["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
                    said = next(int(h.split(b": ")[1]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length: "))
                    out.append({
                        "page_id": _id(head["warc-record-id"]), "url_key": url_key(head.get("warc-target-uri")), "at": head["warc-date"],
                        "record_type": head["warc-type"], "payload_digest": digest,
                        "payload_bytes": len(payload) if head["warc-type"] == "response" else said,
                        "refers_to": _id(head["warc-refers-to"]) if "warc-refers-to" in head else None,
                        "file": file, "offset": offset, "length": length,
                    })
                out.sort(key=_order)
                kinds = [(f.split()[0], pa.int64() if f.endswith("bigint") else pa.string()) for f in FIELDS.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([e[n] for e in out], t) for n, t in kinds], pa.array(range(len(out)), pa.int64())],
                    names=[*[n for n, _ in kinds], "place"],
                )

    return files.mapInArrow(read, FIELDS + ", place bigint")


# ---------------------------------------------------------------------------
# merging
# ---------------------------------------------------------------------------


class LoserTree:
    """Merges sorted sequences: inner nodes hold the loser of each match, the root the overall winner.

    Taking the least element replays one path from its leaf to the root: log2(k) comparisons.
    """

    def __init__(self, sources: Sequence[Sequence], key):
        self.sources, self.key, self.k = sources, key, len(sources)
        self.at = [0] * self.k
        self.head = [key(s[0]) if len(s) else None for s in sources]  # None: used up, loses all matches
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._replay(leaf)

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and x is not None
        return x < y or (x == y and a < b)

    def _replay(self, leaf: int) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node > 0:
            other = self.losers[node]
            if other < 0:  # while the tree is built: wait here for the opponent
                self.losers[node] = winner
                return
            if self._wins(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k:
            w = self.losers[0]
            if self.head[w] is None:
                return
            source, at = self.sources[w], self.at[w]
            yield source[at]
            self.at[w] = at = at + 1
            self.head[w] = self.key(source[at]) if at < len(source) else None
            self._replay(w)


def boundaries(entries: DataFrame, parts: int, rows: int) -> list[tuple]:
    """At most ``parts - 1`` cuts (url_key, at, page_id, file, offset) from a bounded sample, for ranges of about equal size."""
    if parts < 2:
        return []
    own = ("url_key", "at", "page_id", "file", "offset")
    sample = by_hash(entries, SAMPLE_ROWS, rows, *own).orderBy(F.xxhash64(*own)).limit(SAMPLE_ROWS).select(*own)
    keys = sorted((r.url_key, r.at, -1 if r.page_id is None else r.page_id, r.file, r.offset) for r in sample.collect())
    cuts = [keys[len(keys) * i // parts] for i in range(1, parts)]
    return sorted(set(cuts))


def merged_index(entries: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``entries`` (of ``runs``, written) in global order: with ``range_id``, ``position`` from 0 over all, and FIELDS.

    Captures of one URL follow each other by time, which is their history.
    """
    n = entries.count()
    cuts = boundaries(entries, -(-n // range_rows), n)
    over = [
        F.struct(F.lit(u).alias("u"), F.lit(a).alias("a"), F.lit(p).cast("bigint").alias("p"), F.lit(f).alias("f"), F.lit(o).cast("bigint").alias("o"))
        for u, a, p, f, o in cuts
    ]
    own = F.struct(
        F.col("url_key").alias("u"), F.col("at").alias("a"), F.coalesce("page_id", F.lit(-1)).cast("bigint").alias("p"),
        F.col("file").alias("f"), F.col("offset").cast("bigint").alias("o"),
    )
    if over:
        bounds = F.array(*over)
        number = F.size(F.filter(bounds, lambda x: x <= own))
    else:
        number = F.lit(0)
    placed = entries.withColumn("range_id", number.cast("int"))
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def merge(table: pa.Table) -> pa.Table:
        """Segments of runs, each in its own order, merged."""
        table = table.sort_by([("file", "ascending"), ("place", "ascending")])  # each segment as its run has it
        u, a, p, f, o = (table.column(c).to_pylist() for c in ("url_key", "at", "page_id", "file", "offset"))
        segments: dict[str, list[int]] = {}
        for i, file in enumerate(f):
            segments.setdefault(file, []).append(i)
        keys = [(u[i], a[i], p[i] is not None, p[i] or 0, f[i], o[i]) for i in range(len(u))]
        order = list(LoserTree(list(segments.values()), keys.__getitem__))
        return table.take(pa.array(order)).select([*names, "range_id"]).append_column("local", pa.array(range(len(order)), pa.int64()))

    merged = stored(placed.groupBy("range_id").applyInArrow(merge, FIELDS + ", range_id int, local bigint"))
    sizes = merged.groupBy("range_id").agg(F.count("*").alias("m"))
    before = W.orderBy("range_id").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col("range_id").alias("of"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"))
    return merged.join(starts, F.col("range_id") == F.col("of")).select(
        *names, "range_id", (F.col("first") + F.col("local")).alias("position")
    )


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives of all pages, reads them back and returns the merged index.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, then url_key, at, file,
    offset, length and position.  A null html is an empty payload; null urls sort first; repeated rows
    are records of their own; an empty table gives an empty index.  ``path`` is a new folder of the
    shared store (default: below spark.checkpoint.dir).
    """
    spark = pages.sparkSession
    path = path or f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    index = merged_index(stored(runs(spark, path)))
    return index.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "at", "file", "offset", "length", "position"
    )
