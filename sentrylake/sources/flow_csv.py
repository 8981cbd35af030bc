"""Reading untidy CSV data sets.

Files are cut at line ends, so that large ones are read by many tasks, and a quoted field may hold
line breaks.  Whether a line begins inside quotes depends on all lines before it in its file: a line
keeps that state, changes it, or sets it whatever it was.  The state is carried over lines and
splits by running sums and last values; lines that belong together are then joined.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import extent_of, materialise, slice_of, sliced_scan

DELIMITERS = (",", ";", "\t", "|")
_SPARE = "_beyond_header"


def _fields(line: Column, delimiter: str) -> Column:
    """Delimiters outside quotes."""
    bare = F.regexp_replace(line, r'"(\\.|[^"\\])*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))


def _headers(lines: DataFrame) -> DataFrame:
    """file, header, at, n: the first line of each file that is not empty."""
    first = F.min(F.struct("at", "n", "value")).alias("_h")
    return lines.groupBy("file").agg(first).select("file", F.col("_h.value").alias("header"), F.col("_h.at").alias("at"), F.col("_h.n").alias("n"))


def find_delimiter(lines: DataFrame, headers: DataFrame) -> str:
    """Delimiter by which most of all lines have as many fields as the header of their file (counted in parallel)."""
    both = lines.join(headers.select(F.col("file").alias("_f"), "header"), F.col("file") == F.col("_f"))
    counts = both.agg(*[
        F.struct(
            F.count_if((_fields(F.col("header"), d) > 0) & (_fields(F.col("value"), d) == _fields(F.col("header"), d))).alias("n"),
            F.max(_fields(F.col("header"), d)).alias("width"),
        ).alias(f"c{i}") for i, d in enumerate(DELIMITERS)
    ]).first()
    return max(enumerate(DELIMITERS), key=lambda e: (counts[e[0]]["n"], counts[e[0]]["width"]))[1]


def _open_after(line: Column, delimiter: str) -> tuple[Column, Column]:
    """Whether a line ends inside quotes, where it begins outside of them and where it begins inside.

    A quote opens at the begin of a field and closes at the next one without a backslash.
    """
    d = re.escape(delimiter)
    quoted = r'"(?:\\.|[^"\\])*+'
    opens = rf'(?:(?:{quoted}"[^{d}]*+|[^"{d}][^{d}]*+|){d})*+{quoted}$'
    outside = line.rlike("^" + opens)
    closed = line.rlike(rf'^(?:\\.|[^"\\])*+"')
    again = line.rlike(rf'^(?:\\.|[^"\\])*+"[^{d}]*+{d}{opens}')
    return outside, ~closed | again


def _records(lines: DataFrame, delimiter: str) -> DataFrame:
    """``lines`` (file, at, n, value) with those of one record joined by line breaks.

    A quote that no later line of its file closes opens nothing: its lines stay as they are.
    """
    outside, inside = _open_after(F.col("value"), delimiter)
    marked = lines.select("file", "at", "n", outside.alias("_o"), inside.alias("_i"))
    if marked.filter("_o").isEmpty():  # no line leaves a field open
        return lines
    rows = marked.select(
        "file", "at", "n", "_o", "_i", slice_of("at", 1 << 20).alias("_slice"),
        # as it is before the line, then what the line does
        F.explode(F.array(F.lit(0), F.lit(1))).alias("_side"),
    )
    change = (F.col("_side") == 1) & F.col("_o") & ~F.col("_i")
    sets = (F.col("_side") == 1) & (F.col("_o") == F.col("_i"))
    extent = tuple(x // (1 << 20) for x in extent_of((lines, "at")))
    order = ["at", "n", "_side"]
    rows = rows.withColumn("_flips", change.cast("long"))
    flipped = sliced_scan(rows, ["file"], "_slice", order, sums=["_flips"], extent=extent)
    flipped = materialise(flipped.withColumn("_set", F.when(sets, F.pmod(F.col("_o").cast("long") + F.col("_flips"), F.lit(2)))))
    known = sliced_scan(flipped, ["file"], "_slice", order, lasts=["_set"], extent=extent)
    state = F.pmod(F.coalesce("_set", F.lit(0)) + F.col("_flips"), F.lit(2))
    place = F.struct("at", "n")
    known = known.withColumn("_open", state)
    begins = F.when((F.col("_side") == 0) & (F.col("_open") == 0), place)
    known = materialise(known.select("file", "_slice", *order, "_open", begins.alias("_record")))
    ends = known.filter("_side = 1").groupBy("file").agg(F.max_by("_open", place).alias("_last"))
    found = sliced_scan(known, ["file"], "_slice", order, lasts=["_record"], extent=extent).filter("_side = 0")
    last = found.groupBy("file").agg(F.max("_record").alias("_r")).join(ends, "file").filter("_last = 1")
    last = last.select(F.col("file").alias("_f"), "_r")  # records that are never closed
    found = found.join(last, (F.col("file") == F.col("_f")) & (F.col("_record") == F.col("_r")), "left")
    found = found.select("file", "at", "n", F.when(F.col("_f").isNull(), F.col("_record")).otherwise(place).alias("_record"))
    found = materialise(found)
    several = materialise(found.groupBy("file", "_record").agg(F.count("*").alias("_c")).filter("_c > 1").select("file", "_record"))
    parts = found.join(several, ["file", "_record"], "left_semi").select("file", "at", "n", "_record")
    parts = parts.withColumnsRenamed({"file": "_f", "at": "_a", "n": "_n"})
    same = (F.col("file") == F.col("_f")) & (F.col("at") == F.col("_a")) & (F.col("n") == F.col("_n"))
    joined = lines.join(parts, same).groupBy("file", "_record").agg(
        F.array_sort(F.collect_list(F.struct("at", "n", "value"))).alias("_lines"))
    joined = joined.select(
        "file", F.col("_record.at").alias("at"), F.col("_record.n").alias("n"), F.concat_ws("\n", "_lines.value").alias("value"))
    return lines.join(parts, same, "left_anti").select("file", "at", "n", "value").unionByName(joined)


def read_flow_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """All columns as text; lines with too many fields are skipped, short ones are padded.

    Empty and missing fields are '' and texts like 'NA' are kept.  Every file is read by its own
    header (one line) and aligned by column name; a column that a file lacks is ''.  Quoted fields
    may hold line breaks, read as a line feed.
    """
    lines = materialise(spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("n"),
    ))
    filled = lines.filter("trim(value) <> ''")
    headers = materialise(_headers(filled))
    delimiter = delimiter or find_delimiter(filled, headers)
    kinds = [r.header for r in headers.groupBy("header").agg(F.min("file").alias("first")).orderBy("first").collect()]
    if not kinds:
        raise ValueError(f"no rows in {path}")
    named = headers.withColumnsRenamed({"file": "_f"}).select("_f", "header", "at", "n").withColumnsRenamed({"at": "_a", "n": "_n"})
    rows = _records(lines, delimiter).filter("trim(value) <> ''").join(named, F.col("file") == F.col("_f"))
    rows = rows.filter((F.col("at") != F.col("_a")) | (F.col("n") != F.col("_n")))
    out = None
    for kind in kinds:
        header = next(csv.reader([kind], delimiter=delimiter, quotechar='"', escapechar="\\"))
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, _SPARE]])
        options = {"sep": delimiter, "quote": '"', "escape": "\\", "mode": "PERMISSIVE", "emptyValue": ""}
        ddl = ", ".join(f"`{f.name.replace('`', '``')}` STRING" for f in schema)
        table = rows.filter(F.col("header") == kind).select(F.from_csv("value", ddl, options).alias("_row")).select("_row.*")
        table = table.filter(F.col(_SPARE).isNull()).drop(_SPARE)
        out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    return out.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in out.columns])
