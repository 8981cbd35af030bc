"""Order-dependent operators that stay parallel when one key holds most of the rows.

All of them follow one pattern.  A key's time line is cut into slices; a window runs inside
each ``(key, slice)``; one summary row per slice carries the state of the earlier slices in.
A hot key is therefore spread over as many tasks as it has slices.  The summary rows are added up
in a tree of blocks of ``FAN`` slices, blocks of blocks and so on, so no window sees a whole key,
however long its time line is.  Rows are reduced to distinct ``(key, time)``
pairs before the shuffle, since every answer depends on those alone; this also bounds a slice
by the number of microseconds in it.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates: the one the session names in ``spark.checkpoint.dir``.

    Where nothing is set, a session on one machine (master ``local``) uses a folder of its
    own; on a cluster that is an error, since executors do not share their disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        named = tempfile.mkdtemp(prefix="sentrylake-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_CODE_LIMIT = "spark.sql.codegen.hugeMethodLimit"
JIT_BYTES = 8000  # HotSpot leaves larger methods to its interpreter


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and goes on from there.

    This cuts the lineage, survives lost executors, computes ``df`` once, lets later steps read
    only the columns they need, and gives Spark the true size: a table is broadcast in a later
    join only if it measures below the broadcast threshold.  While it is written, stages whose
    generated code is beyond what the JVM compiles run operator by operator instead of interpreted.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/sentrylake-{uuid.uuid4().hex}"
    before = spark.conf.get(_CODE_LIMIT)
    spark.conf.set(_CODE_LIMIT, str(min(int(before), JIT_BYTES)))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CODE_LIMIT, before)
    return spark.read.schema(df.schema).parquet(path)


def slice_of(t, width: int) -> Column:
    """Number of the slice of ``width`` that ``t`` falls into (floor division, also below 0)."""
    if isinstance(t, str):
        return F.expr(f"(`{t}` - pmod(`{t}`, {width}L)) div {width}L")
    width = F.lit(width).cast("bigint")
    return F.call_function("div", t - F.pmod(t, width), width)


FAN = 1 << 14  # children of a node in the tree of slice totals


def extent_of(*columns: tuple[DataFrame, str]) -> tuple[int, int]:
    """Least and greatest value of 64-bit columns; (0, 0) where there is none."""
    both = reduce(DataFrame.union, [df.select(F.col(c).cast("bigint").alias("x")) for df, c in columns])
    low, high = both.agg(F.min("x"), F.max("x")).first()
    return (0, 0) if low is None else (low, high)


def _carried(totals: DataFrame, keys: list[str], at: str, sums: Sequence[str], lasts: Sequence[str],
             extent: tuple[int, int], fan: int) -> DataFrame:
    """What the slices before each slice add up to: ``keys, at`` with ``_c_`` columns, from ``_s_`` and ``_l_`` totals.

    An up-sweep adds totals up by blocks of ``fan`` neighbours until one block holds all of
    ``extent``; a down-sweep joins what comes before a block to what comes before a child within it.
    """
    low, high = extent
    levels = 1
    while fan**levels <= high - low:
        levels += 1
    tree = [totals.withColumn("_n", F.col(at) - F.lit(low).cast("bigint"))]
    for _ in range(1, levels):
        tree.append(tree[-1].groupBy(*keys, slice_of("_n", fan).alias("_n")).agg(
            *[F.sum(f"_s_{c}").alias(f"_s_{c}") for c in sums],
            *[F.max_by(F.col(f"_l_{c}"), F.when(F.col(f"_l_{c}").isNotNull(), F.col("_n"))).alias(f"_l_{c}") for c in lasts],
        ))
    above = None
    for level in reversed(tree):
        block = slice_of("_n", fan).alias("_b")
        before = W.partitionBy(*keys, "_b").orderBy("_n").rowsBetween(W.unboundedPreceding, -1)
        own = [at] if at in level.columns else []
        inside = level.withColumn("_b", block).select(
            *keys, *own, "_n", "_b",
            *[F.sum(f"_s_{c}").over(before).alias(f"_c_{c}") for c in sums],
            *[F.last(f"_l_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in lasts],
        )
        if above is not None:
            names = [*keys, "_n", *[f"_c_{c}" for c in (*sums, *lasts)]]
            up = above.select(*[F.col(c).alias(f"_u{c}") for c in names])
            same = [F.col(c) == F.col(f"_u{c}") for c in keys] + [F.col("_b") == F.col("_u_n")]
            total = lambda c: F.when(F.col(f"_c_{c}").isNull(), F.col(f"_u_c_{c}")).otherwise(F.col(f"_c_{c}") + F.coalesce(f"_u_c_{c}", F.lit(0)))
            inside = inside.join(up, same).select(
                *keys, *own, "_n", "_b", *[total(c).alias(f"_c_{c}") for c in sums],
                *[F.coalesce(f"_c_{c}", f"_u_c_{c}").alias(f"_c_{c}") for c in lasts],
            )
        above = inside
    return above.drop("_n", "_b")


def sliced_scan(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    order: Sequence[str],
    sums: Sequence[str] = (),
    lasts: Sequence[str] = (),
    extent: tuple[int, int] | None = None,
    fan: int = FAN,
) -> DataFrame:
    """Running sums (rows with equal order included) and last non-null values per key.

    Each column named in ``sums`` or ``lasts`` is replaced by its running value over all rows of
    the key up to and including the current one.  ``keys`` must not be NULL and the slice must
    not decrease along ``order``.  ``extent`` is the
    least and the greatest slice, looked up where it is not given.
    """
    keys = list(keys)
    # said here, so that Spark does not infer it for one of the two copies of ``df`` alone
    df = df.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in keys]))
    local = W.partitionBy(*keys, slice_col).orderBy(*order)
    first = F.struct(*order) if len(order) > 1 else F.col(order[0])
    totals = df.groupBy(*keys, slice_col).agg(
        *[F.sum(c).alias(f"_s_{c}") for c in sums],
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), first)).alias(f"_l_{c}") for c in lasts],
    )
    # Renamed keys keep the two sides of the join free of common attributes.  Spark then leaves
    # both copies of ``df`` alike and shuffles it once (ReusedExchange).
    on = [*keys, slice_col]
    extent = extent or extent_of((df, slice_col))
    carried = _carried(totals, keys, slice_col, sums, lasts, extent, fan)
    carried = carried.select(*[F.col(c).alias(f"_k_{c}") for c in on], *[f"_c_{c}" for c in (*sums, *lasts)])
    scanned = df.select(
        *[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in df.columns if c not in sums and c not in lasts],
        *[F.sum(c).over(local).alias(c) for c in sums],
        *[F.last(c, ignorenulls=True).over(local).alias(c) for c in lasts],
    )
    same = [F.col(f"_r_{c}") == F.col(f"_k_{c}") for c in on]
    joined = scanned.join(carried, same).withColumnsRenamed({f"_r_{c}": c for c in on})
    out = {c: F.col(c) for c in df.columns}
    out |= {c: (F.col(c) + F.coalesce(F.col(f"_c_{c}"), F.lit(0))).alias(c) for c in sums}
    out |= {c: F.coalesce(F.col(c), F.col(f"_c_{c}")).alias(c) for c in lasts}
    return joined.select(*out.values())


def window_counts(
    events: DataFrame,
    key: str,
    t: str,
    counters: dict[str, Column],
    frames: dict[str, tuple[str, int]],
    wanted: str | None = None,
    slice_us: int = 10_000_000,
) -> DataFrame:
    """Rows of the same key in the last ``width`` microseconds, both ends included.

    ``counters`` names boolean row conditions; ``frames`` maps an output column to a counter and
    a width.  One row comes back per distinct ``(key, t)``, or only for those where the counter
    ``wanted`` is not zero.  Rows without a key are left out.

    Every time stamp adds its counts at ``t`` and takes them away at ``t + width + 1``, so the
    answer is a running sum: linear work however dense a frame is, where a sliding RANGE frame
    re-reads the frame for each row.
    """
    per_t = (
        events.filter(F.col(key).isNotNull() & (F.col(key) != ""))
        .groupBy(key, t)
        .agg(*[F.count_if(cond).alias(f"_n_{name}") for name, cond in counters.items()])
    )
    outs = list(frames)
    real = "true" if wanted is None else f"_n_{wanted} > 0"

    def step(at: str, is_real: str, sign: str, active: set[str]) -> str:
        counts = [f"'{o}', {sign}_n_{frames[o][0]}" if o in active else f"'{o}', 0L" for o in outs]
        return f"named_struct('{t}', {at}, '_real', {is_real}, {', '.join(counts)})"

    steps = [step(f"`{t}`", real, "", set(outs))]
    for width in sorted({w for _, w in frames.values()}):
        ending = {o for o in outs if frames[o][1] == width}
        some = " OR ".join(f"_n_{c} > 0" for c in sorted({frames[o][0] for o in ending}))
        steps.append(f"CASE WHEN {some} THEN {step(f'`{t}` + {width + 1}L', 'false', '-', ending)} END")
    deltas = (
        per_t.select(key, F.expr(f"explode(array_compact(array({', '.join(steps)})))").alias("_d"))
        .select(key, "_d.*")
        .withColumn("_slice", slice_of(t, slice_us))
    )
    low, high = extent_of((events, t))
    extent = (low // slice_us, (high + 1 + max(w for _, w in frames.values())) // slice_us)
    return sliced_scan(deltas, [key], "_slice", [t], sums=outs, extent=extent).filter("_real").select(key, t, *outs)


def asof_last(
    requests: DataFrame,
    entries: DataFrame,
    keys: Sequence[str],
    t: str,
    payload: Sequence[str],
    tie: str | None = None,
    slice_us: int = 10_000_000,
    extent: tuple[int, int] | None = None,
) -> DataFrame:
    """Latest entry at or before each distinct requested ``(keys, t)``.

    Gives ``keys, t, _entry_t`` and the ``payload`` columns (NULL where there is no entry).
    Entries of one key and time are reduced to the one with the greatest ``tie``, a unique
    column that is needed when there is a payload.  ``extent`` holds the least and the greatest
    ``t`` of both, looked up where it is not given.
    """
    keys = list(keys)
    # column by column, so that Spark can aggregate by hash (a struct would need a sort)
    latest = entries.groupBy(*keys, t).agg(*[F.max_by(c, F.col(tie)).alias(c) for c in payload]) if payload else (
        entries.select(*keys, t).distinct()
    )
    latest = latest.select(*keys, t, F.struct(F.col(t).alias("_entry_t"), *payload).alias("_entry"))
    asked = requests.select(*keys, t).distinct()
    both = (
        latest.withColumn("_side", F.lit(0))
        .unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True)
        .withColumn("_slice", slice_of(t, slice_us))
    )
    low, high = extent or extent_of((requests, t), (entries, t))
    found = sliced_scan(both, keys, "_slice", [t, "_side"], lasts=["_entry"], extent=(low // slice_us, high // slice_us))
    return found.filter("_side = 1").select(*keys, t, "_entry.*")


def chained_gap(
    stamps: DataFrame,
    keys: Sequence[str],
    t: str,
    gap_us: int,
) -> DataFrame:
    """Stamps kept when the first is kept and each next one lies ``gap_us`` after the last kept.

    A stamp is surely kept if it comes ``gap_us`` or more after the stamp before it, so every key is
    cut into islands there; those shorter than a gap are done.  Inside the others chains are followed by
    pointer doubling over joins, in as many levels as the longest island needs.  No key or
    island is held in one task.  Keys must not be NULL.
    """
    keys = list(keys)
    distinct = stamps.select(*keys, t).distinct()
    placed = materialise(distinct.withColumn("_chunk", slice_of(t, gap_us)))
    # Of the stamps of a chunk, one gap long, only the first can begin an island.
    chunks = placed.groupBy(*keys, "_chunk").agg(F.min(t).alias("_from"), F.max(t).alias("_to"))
    before = placed.groupBy(*keys, "_chunk").agg(F.max(t).alias("_prev"))
    before = before.select(*[F.col(c).alias(f"_k_{c}") for c in keys], (F.col("_chunk") + 1).alias("_next"), "_prev")
    same = [F.col(c) == F.col(f"_k_{c}") for c in keys] + [F.col("_chunk") == F.col("_next")]
    begins = F.col("_prev").isNull() | (F.col("_from") - F.col("_prev") >= gap_us)
    marked = chunks.join(before, same, "left").select(
        *keys, "_chunk", "_from", "_to", F.when(begins, F.col("_from")).alias("_island"), slice_of("_chunk", CHUNKS).alias("_slice"))
    low, high = extent_of((placed, "_chunk"))
    extent = (low // CHUNKS, high // CHUNKS)
    marked = materialise(sliced_scan(marked, keys, "_slice", ["_chunk"], lasts=["_island"], extent=extent).drop("_slice"))
    first = marked.filter("_from = _island").select(*keys, F.col("_island").alias(t))
    ends = marked.groupBy(*keys, "_island").agg(F.max("_to").alias("_end")).filter(F.col("_end") - F.col("_island") >= gap_us)
    ends = materialise(ends)
    span = ends.agg(F.max(F.col("_end") - F.col("_island"))).first()[0]
    if span is None:  # nothing is left to follow
        return first
    inside = marked.select(*keys, "_chunk", "_island").join(ends.select(*keys, "_island"), [*keys, "_island"], "left_semi")
    rows = materialise(placed.join(inside, [*keys, "_chunk"]).select(*keys, "_island", t, F.col("_island").alias("_lo")))
    kept = _follow(rows, [*keys, "_island"], t, gap_us, span)
    return first.unionByName(kept.filter(F.col(t) > F.col("_island")).select(*keys, t))


CHUNKS = 1 << 12  # chunks of a gap to a slice


def _follow(large: DataFrame, keys: list[str], t: str, gap_us: int, span_us: int) -> DataFrame:
    """Pointer doubling.  ``large`` has the keys, ``t`` and ``_lo``, the key's first stamp.

    With time measured from the key's first stamp and cut into chunks of one gap, a chunk holds
    at most one kept stamp.  Level k looks at blocks of 2^k chunks and keeps, for every stamp at
    which a chain can enter a block, the stamp at which the chain leaves it.  Entries lie in a
    block's first chunk, or are the first stamp after it, so each level has about half the rows.
    Going back down from the root finds the kept stamps of ever smaller blocks.
    """
    rel = large.select(*keys, "_lo", (F.col(t) - F.col("_lo")).alias("_x"))
    # next stamp at or after x + gap: an as-of lookup on the reversed time line
    reverse = rel.select(*keys, (-F.col("_x")).alias("_r"))
    ask = rel.select(*keys, (-(F.col("_x") + gap_us)).alias("_r"))
    nxt = asof_last(ask, reverse, keys, "_r", [], slice_us=max(gap_us, 10_000_000), extent=(-span_us - gap_us, 0)).select(
        *keys, (-F.col("_r") - gap_us).alias("_x"), (-F.col("_entry_t")).alias("_y")
    )
    levels = [materialise(nxt)]
    depth = max(0, math.ceil(math.log2(span_us // gap_us + 1)))
    for k in range(1, depth + 1):
        below = levels[-1]
        width = gap_us * (1 << k)
        block = slice_of(F.col("_x"), width)
        inside = F.col("_x") - block * width
        head = below.filter(inside < gap_us)
        tail = below.filter(inside >= gap_us)
        firsts = tail.groupBy(*keys, block.alias("_b")).agg(F.min("_x").alias("_x")).select(*keys, "_x")
        entries = head.unionByName(tail.join(firsts, [*keys, "_x"], "left_semi"))
        hop = below.select(*keys, F.col("_x").alias("_y"), F.col("_y").alias("_z"))
        same = slice_of(F.col("_x"), width) == slice_of(F.col("_y"), width)
        levels.append(
            materialise(
                entries.join(hop, [*keys, "_y"], "left").select(
                    *keys, "_x", F.when(same, F.col("_z")).otherwise(F.col("_y")).alias("_y")
                )
            )
        )
    kept = rel.filter("_x = 0").select(*keys, "_lo", "_x")
    for k in range(depth, 0, -1):
        width = gap_us * (1 << k)
        same = slice_of(F.col("_x"), width) == slice_of(F.col("_y"), width)
        more = kept.join(levels[k - 1], [*keys, "_x"]).filter(same).select(*keys, "_lo", F.col("_y").alias("_x"))
        kept = materialise(kept.unionByName(more))
    return kept.select(*keys, (F.col("_x") + F.col("_lo")).alias(t))


def rolling_mean(df: DataFrame, key: str, order: Sequence[str], value: str, rows: int, out: str,
                 block_rows: int = 100_000) -> DataFrame:
    """Mean of the latest ``rows`` values of each key, the current row included.

    A range partitioning over (key, order) cuts the rows into even pieces, also inside a hot
    key; rows are numbered per piece, with the counts of the earlier pieces added.  Blocks of
    ``block_rows`` numbers then repeat the last ``rows - 1`` rows of the block before, so a plain
    ROWS frame is exact.
    """
    if rows > block_rows:
        raise ValueError("block_rows must be at least rows")
    pieces = df.repartitionByRange(key, *order).withColumn("_slice", F.spark_partition_id())
    sliced = materialise(pieces)  # fixes the piece of every row
    inner = W.partitionBy(key, "_slice").orderBy(*order)
    totals = sliced.groupBy(key, "_slice").agg(F.count("*").alias("_c"))
    before = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(key, "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c"))
    numbered = sliced.withColumn("_p", F.row_number().over(inner)).join(totals, [key, "_slice"])
    pos = F.col("_p") + F.col("_c") - 1
    block = slice_of(pos.cast("bigint"), block_rows)
    blocks = F.when(
        pos - block * block_rows > block_rows - rows, F.array(block, block + 1)
    ).otherwise(F.array(block))
    spread = numbered.withColumn("_home", block).withColumn("_block", F.explode(blocks))
    frame = W.partitionBy(key, "_block").orderBy(*order).rowsBetween(-(rows - 1), 0)
    return (
        spread.withColumn(out, F.avg(value).over(frame))
        .filter("_block = _home")
        .select(*df.columns, out)
    )


def fill_both_ways(df: DataFrame, key: str, row: str, value: str, out: str, slice_rows: int = 100_000) -> DataFrame:
    """Last non-null value up to the row, else the first one after it, per key in ``row`` order; NULL for a NULL key or row."""
    known = df.filter(F.col(key).isNotNull() & F.col(row).isNotNull())
    low, high = (x // slice_rows for x in extent_of((known, row)))
    forward = sliced_scan(
        known.select(key, row, F.col(value).alias("_f"), slice_of(row, slice_rows).alias("_slice")),
        [key], "_slice", [row], lasts=["_f"], extent=(low, high),
    ).drop("_slice")
    back = sliced_scan(
        known.select(key, (-F.col(row)).alias("_r"), F.col(value).alias("_g"),
                  slice_of(-F.col(row), slice_rows).alias("_slice")),
        [key], "_slice", ["_r"], lasts=["_g"], extent=(-high - 1, -low),
    ).select(key, (-F.col("_r")).alias(row), "_g")
    filled = forward.join(back, [key, row]).select(
        F.col(key).alias("_fk"), F.col(row).alias("_fr"), F.coalesce("_f", "_g").alias(out)
    )
    return df.join(filled, (F.col(key) == F.col("_fk")) & (F.col(row) == F.col("_fr")), "left").drop("_fk", "_fr")


def range_codes(values: DataFrame, order: str, out: str) -> DataFrame:
    """Codes 0.. for distinct rows in ``order``.

    A sampled range partitioning sorts them in even pieces, however alike they begin; a row's code is its
    place in its piece plus the counts of the pieces before, of which there are as many as tasks.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = materialise(values).repartitionByRange(parts, order).sortWithinPartitions(order)
    # Spark numbers rows by (piece, place within it); the written table fixes both
    placed = materialise(pieces.withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumn("_piece", F.expr("shiftright(_m, 33)")).withColumn("_p", F.expr("_m & ((1L << 33) - 1)"))
    counts = placed.groupBy("_piece").agg(F.count("*").alias("_c"))
    before = W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)  # one row per piece
    starts = counts.select(F.col("_piece").alias("_of"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    coded = placed.join(starts, F.col("_piece") == F.col("_of"))
    return coded.select(*values.columns, (F.col("_p") + F.col("_start")).cast("int").alias(out))


def exact_quantiles(long: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float],
                    steps: int = 4096) -> DataFrame:
    """Exact quantiles with linear interpolation: ``groups, prob, quantile``.

    Values are binned by a monotone function; running bin counts locate the one or two ranks of
    each quantile, and only the rows of those bins are looked at again.  Each such bin is cut once
    more into ``steps`` even parts, so tightly packed values do not end up in one task either.
    No group is held in one task, unlike the built-in exact percentile, whose state grows with
    the distinct values.
    """
    groups = list(groups)
    v = F.col(value)
    bin_of = F.floor(F.signum(v) * F.ln(F.lit(1.0) + F.abs(v)) * 1000).cast("bigint")
    # distinct values first: a value that fills a third of the rows becomes one row
    counted = long.groupBy(*groups, value).agg(F.count("*").alias("_n")).withColumn("_bin", bin_of)
    counted = materialise(counted)  # read three times below
    upto = W.partitionBy(*groups).orderBy("_bin")
    bins = (
        counted.groupBy(*groups, "_bin")
        .agg(F.sum("_n").alias("_bn"), F.min(value).alias("_from"), F.max(value).alias("_to"))
        .withColumn("_below", F.sum("_bn").over(upto) - F.col("_bn"))
        .withColumn("_total", F.sum("_bn").over(W.partitionBy(*groups)))
    )
    # wanted zero-based ranks: floor and ceiling of (n - 1) p
    place = (F.col("_total") - 1) * F.col("prob")
    ranks = F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place))))
    wanted = (
        bins.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .select(*groups, "_bin", "_below", "_bn", "_from", "_to", "prob", F.floor(place).alias("_lo"),
                (place - F.floor(place)).alias("_frac"), ranks.alias("_rank"))
        .filter((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_bn")))
    )
    # at most two rows per quantile and group; broadcast below only if they measure small
    wanted = materialise(wanted)
    span = F.col("_to") - F.col("_from")
    part = F.when(span > 0, F.floor((v - F.col("_from")) / span * steps)).otherwise(F.lit(0)).cast("int")
    near = counted.join(
        wanted.select(*groups, "_bin", "_below", "_from", "_to").distinct(), [*groups, "_bin"]
    ).select(*groups, "_bin", "_below", part.alias("_part"), value, "_n")
    parts = near.groupBy(*groups, "_bin", "_below", "_part").agg(F.sum("_n").alias("_pn"))
    before = F.sum("_pn").over(W.partitionBy(*groups, "_bin").orderBy("_part")) - F.col("_pn")
    parts = parts.select(*groups, "_bin", "_part", (F.col("_below") + before).alias("_start"), "_pn")
    spots = materialise(
        wanted.select(*groups, "_bin", "prob", "_frac", "_rank", "_lo").join(parts, [*groups, "_bin"])
        .filter((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_pn")))
    )
    inside = W.partitionBy(*groups, "_bin", "_part").orderBy(value)
    ranked = near.join(
        spots.select(*groups, "_bin", "_part", "_start").distinct(), [*groups, "_bin", "_part"]
    ).withColumn("_end", F.sum("_n").over(inside) + F.col("_start"))
    hits = (
        spots.select(*groups, "_bin", "_part", "prob", "_frac", "_rank", "_lo")
        .join(ranked.select(*groups, "_bin", "_part", value, "_n", "_end"), [*groups, "_bin", "_part"])
        .filter((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n")))
    )
    low = F.max(F.when(F.col("_rank") == F.col("_lo"), v))
    high = F.max(F.when(F.col("_rank") != F.col("_lo"), v))
    return hits.groupBy(*groups, "prob").agg(
        (low + F.coalesce((high - low) * F.max("_frac"), F.lit(0.0))).alias("quantile")
    )


def take_by_hash(df: DataFrame, hash_col: str, tie: str, take: Column, strata: Sequence[str] = ()) -> DataFrame:
    """Adds ``_taken``: true for exactly ``take`` rows (per stratum) in order of (hash, tie).

    ``take`` is an expression over ``_total``, the row count of the stratum.  A histogram of the
    hash locates the cut; only rows in the one bin that holds the cut are ranked.
    ``hash_col`` is a 32-bit number held in a BIGINT.  ``df`` is read once for the histogram and
    once per side of the cut, so it should be a stored table rather than a costly plan.
    """
    strata = list(strata)
    width = 1 << 16
    binned = df.withColumn("_bin", F.expr(f"shiftright({hash_col}, 16)"))
    hist = binned.groupBy(*strata, "_bin").agg(F.count("*").alias("_n"))
    # the window below sees at most 2^16 rows per stratum
    by = [*strata] or [F.lit(0)]
    upto = W.partitionBy(*by).orderBy("_bin")
    hist = hist.select(
        *strata, "_bin", "_n", (F.sum("_n").over(upto) - F.col("_n")).alias("_below"),
        F.sum("_n").over(W.partitionBy(*by)).alias("_total"),
    ).withColumn("_take", take.cast("bigint"))
    cut = hist.groupBy(*strata).agg(
        F.max(F.when(F.col("_below") <= F.col("_take"), F.col("_bin"))).alias("_cut"),
        F.max(F.when(F.col("_below") <= F.col("_take"), F.struct("_bin", (F.col("_take") - F.col("_below")).alias("left")))).getField("left").alias("_left"),
    )
    if strata:
        marked = binned.join(materialise(cut), strata)  # one row per stratum, of measured size
    else:
        one = cut.select(F.struct("_cut", "_left")).scalar()
        marked = binned.withColumn("_c", one).select("*", "_c._cut", "_c._left").drop("_c")
    sure = marked.filter(F.col("_bin") != F.col("_cut")).withColumn("_taken", F.col("_bin") < F.col("_cut"))
    rank = F.row_number().over(W.partitionBy(*strata, "_bin").orderBy(hash_col, tie))
    edge = marked.filter(F.col("_bin") == F.col("_cut")).withColumn("_taken", rank <= F.col("_left"))
    return sure.unionByName(edge).drop("_bin", "_cut", "_left")
