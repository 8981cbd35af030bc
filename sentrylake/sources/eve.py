"""Reading event records: newline JSON, text columns, dated files and partitions."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVE


def usable(df: DataFrame) -> DataFrame:
    """Malformed lines come out with every field NULL; one odd field does not lose its record."""
    return df.filter(F.coalesce(*[F.col(f.name).cast("string") for f in EVE.fields if not hasattr(f.dataType, "fields")],
                                *[F.to_json(f.name) for f in EVE.fields if hasattr(f.dataType, "fields")]).isNotNull())


def read_eve_json(spark: SparkSession, path) -> DataFrame:
    """Newline JSON with a fixed schema; blank and malformed lines are skipped.

    ``log_file`` holds the file each record came from.
    """
    raw = spark.read.schema(EVE).json(path, mode="PERMISSIVE")
    return usable(raw.select("*", F.col("_metadata.file_path").alias("log_file")))


def parse_eve_text(df: DataFrame, column: str = "value") -> DataFrame:
    """The same for JSON held in a text column (for instance a message payload)."""
    parsed = df.withColumn("_e", F.from_json(F.trim(F.col(column)), EVE, {"mode": "PERMISSIVE"}))
    others = [c for c in df.columns if c != column]
    return usable(parsed.select(*others, "_e.*"))


def with_event_id(eve: DataFrame, salt: int = 0) -> DataFrame:
    """Fills missing ids: a negative digest of the record, its occurrence among equal ones and ``salt``.

    The same records get the same ids however the files are cut, and none of the (non-negative)
    given ones.  Equal records are counted before the shuffle, so many copies do not meet in one
    task.  Two different records share an id with the chance of a 63-bit hash.
    """
    given = eve.filter(F.col("event_id").isNotNull())
    rest = [c for c in eve.columns if c != "event_id"]
    none = eve.filter(F.col("event_id").isNull()).groupBy(*rest).agg(F.count("*").alias("_n"))
    copies = none.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    digest = F.xxhash64(F.to_json(F.struct(*rest)), "_copy", F.lit(salt))
    filled = copies.select((-1 - F.pmod(digest, F.lit((1 << 63) - 1))).alias("event_id"), *rest)
    return given.unionByName(filled)


def read_dated_json(spark: SparkSession, pattern: str, day: date, fallback: str | None = None) -> DataFrame:
    """File of a day (``pattern`` as for strftime), else the fallback file."""
    try:
        return read_eve_json(spark, day.strftime(pattern))
    except AnalysisException as e:
        if fallback is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return read_eve_json(spark, fallback)


def write_daily(events: DataFrame, path: str, t_us: str = "t_us", mode: str = "append") -> None:
    """Parquet table partitioned by UTC ``event_date``.

    Rows are spread by day and by time within the day, so a busy day gets many files and no
    task holds a whole day.
    """
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(t_us) / 86_400_000_000).cast("int"))
    (
        events.withColumn("event_date", day)
        .repartitionByRange("event_date", t_us)
        .write.mode(mode).partitionBy("event_date").parquet(path)
    )


def read_daily(spark: SparkSession, path: str, first: date | str, last: date | str | None = None) -> DataFrame:
    """Days of a partitioned table; only their directories are listed and read."""
    lo, hi = str(first), str(last or first)
    return spark.read.parquet(path).filter(F.col("event_date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
