"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Targets.  Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the size of
the whole corpus; no target exceeds ``most`` times its source's size, and the excess is shared
again by weight.  That fixed point is a water level: target = min(most * size, weight * level).
Sorted by most * size / weight the sources below the level come first, so prefix sums give it.

Rates.  Among all document rates that meet the token constraints, entropy balancing takes those
of least relative entropy to rate 1, each document weighed by its tokens.  The dual is convex with
one variable per constraint, and the primal is an exponential tilt: rate = exp(lambda of the
source).  Newton steps on the dual run over the token sums by source until no constraint is
violated by more than ``tolerance`` of its target; gradient and Hessian are the tilted sums.

Copies.  A rate is rounded within its source along the documents sorted by size: the document of
rank r gets floor((r + 1) * rate) - floor(r * rate) copies, so the words taken differ from the
target by about the largest document.  Ranks come from prefix sums over (source, size) and
(source, size, block of ids), never from a window over a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, stored

WEIGHTS = (5, 2, 1)
MOST = 3
SCALE = 1_000_000_000  # rates are rounded to this many parts
ID_BLOCK = 65536


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: words of the text (null: 0)."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    return docs.select("doc_id", "source", words.cast("bigint").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target; one row per source (the null source is one)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").isNull(), "source")
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank.cast("int") + 1))
    per = per.withColumn("full", (most * F.col("source_size")).cast("double") / F.col("weight"))
    before = W.orderBy("full", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(W.partitionBy())
    per = per.withColumns({
        "held": F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)),
        "open": F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "total": total,
    })
    # the first source, by level at which it is full, whose own level is not reached gives the level;
    # the sources behind it would give lower ones
    level = (F.col("total") - F.col("held")) / F.col("open")
    per = per.withColumn("level", F.when(level <= F.col("full"), level))
    per = per.withColumn("level", F.max("level").over(W.partitionBy()))
    target = F.least((most * F.col("source_size")).cast("double"), F.col("weight") * F.col("level"))
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def rates(goals: DataFrame, tolerance: float = 1e-12, most_steps: int = 100) -> DataFrame:
    """``goals`` (source, source_size, target) with ``rate``: the exponential tilt of each source.

    A source without words or without target has rate 0.
    """
    state = stored(goals.withColumn("lam", F.lit(0.0)))
    for _ in range(most_steps):
        tilted = F.col("source_size") * F.exp("lam")
        live = (F.col("source_size") > 0) & (F.col("target") > 0)
        worst = state.filter(live).agg(F.max(F.abs(tilted - F.col("target")) / F.col("target"))).first()[0]
        if worst is None or worst <= tolerance:
            break
        # gradient over Hessian of the dual; a step is held to one unit while the tilt is far off
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (tilted - F.col("target")) / tilted))
        state = stored(state.withColumn("lam", F.when(live, F.col("lam") - step).otherwise(F.lit(0.0))))
    live = (F.col("source_size") > 0) & (F.col("target") > 0)
    return state.select("source", "source_size", "target", F.when(live, F.exp("lam")).otherwise(F.lit(0.0)).alias("rate"))


def ranked(sized: DataFrame) -> DataFrame:
    """Distinct (source, size, doc_id) with ``n`` rows each and ``rank``: rows of the source before them.

    Order within a source: size, then doc_id (null first).
    """
    rows = stored(
        sized.groupBy("source", "size", "doc_id").agg(F.count("*").alias("n"))
        .withColumn("block", F.expr(f"coalesce(doc_id, -9223372036854775808) div {ID_BLOCK}"))
        .withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    )
    keys = ["no_source", "source", "size", "block"]
    blocks = rows.groupBy(*keys).agg(F.sum("n").alias("m"))
    cells = blocks.groupBy(*keys[:3]).agg(F.sum("m").alias("m"))
    up = (W.unboundedPreceding, -1)
    cells = cells.select(*keys[:3], F.coalesce(
        F.sum("m").over(W.partitionBy(*keys[:2]).orderBy("size").rowsBetween(*up)), F.lit(0)).alias("cell_from"))
    blocks = blocks.select(*keys, F.coalesce(
        F.sum("m").over(W.partitionBy(*keys[:3]).orderBy("block").rowsBetween(*up)), F.lit(0)).alias("block_from"))
    within = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy(F.col("doc_id").asc_nulls_first()).rowsBetween(*up)), F.lit(0))
    placed = rows.withColumn("within", within).join(blocks, keys).join(cells, keys[:3])
    return placed.select(
        F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "doc_id", "n",
        (F.col("cell_from") + F.col("block_from") + F.col("within")).alias("rank"),
    )


def copies(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of ``sized``: doc_id, source, size, source_size, target, rate, copies.

    Rows with the same doc_id, source and size are told apart by their place only, so the copies
    of a group of repeated rows are dealt to them in turn.  Rates are at most ``most``, so are copies.
    """
    goals = rates(targets(sized, weights, most))
    goals = goals.withColumnRenamed("source", "goal_source")
    placed = ranked(sized)
    joined = placed.join(goals, F.col("source").eqNullSafe(F.col("goal_source")))
    parts = F.round(F.col("rate") * SCALE).cast("bigint")
    whole, part = F.expr(f"parts div {SCALE}L"), F.expr(f"parts % {SCALE}L")
    place = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))
    rows = joined.withColumn("parts", parts).withColumn("place", place).withColumn("at", F.col("rank") + F.col("place"))
    rows = rows.withColumns({"whole": whole, "part": part})
    # floor((r + 1) * part) - floor(r * part), in integers below 2^63 for ranks up to 9e9
    extra = F.expr(f"((at + 1) * part) div {SCALE}L - (at * part) div {SCALE}L")
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "rate", (F.col("whole") + extra).alias("copies")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), source, copies; a row per document.

    Null texts have size 0 and follow their source's rate, which takes no words; a null source is a
    source of its own, the last; equal rows stay rows of their own; an empty table gives an empty one.
    Columns other than doc_id, text and source are not read.
    """
    found = copies(stored(sizes(docs)), weights, most)
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


def repeat_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed corpus: each document as many times as it is taken, with its own columns."""
    own = docs.columns
    base = docs.withColumns({
        "_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"),
        "_row": F.monotonically_increasing_id(),
    })
    rows = stored(base)
    light = rows.select(F.col("_row").alias("doc_id"), "source", F.col("_size").alias("size"))
    taken = copies(light, weights, most).filter("copies > 0").select(F.col("doc_id").alias("_of"), F.col("copies").alias("_copies"))
    many = rows.join(taken, rows["_row"] == taken["_of"])
    return many.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*own)


#: The same rows in SQL; the rate in closed form, since the tilt meets each constraint exactly.
SQL = """
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM p),
f AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS full_at FROM w),
h AS (
  SELECT *, coalesce(sum(3 * source_size) OVER o, 0) AS held,
    sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open_weight, sum(source_size) OVER () AS total
  FROM f WINDOW o AS (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - held AS DOUBLE) / open_weight AS own_level FROM h),
t AS (
  SELECT source, source_size,
    coalesce(least(CAST(3 * source_size AS DOUBLE), weight * max(CASE WHEN own_level <= full_at THEN own_level END) OVER ()), 0) AS target
  FROM l),
r AS (
  SELECT *, CAST(CASE WHEN source_size > 0 AND target > 0 THEN round(target / source_size * 1000000000) ELSE 0 END AS BIGINT) AS parts
  FROM t),
k AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS pos FROM s)
SELECT doc_id, size, source_size, round(target, 4) AS target,
  size * (parts // 1000000000 + ((pos + 1) * (parts % 1000000000)) // 1000000000 - (pos * (parts % 1000000000)) // 1000000000) AS taken
FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source
"""
