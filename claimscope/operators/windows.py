"""Window-style operators.

Where a window would put a whole (possibly hot) group into one task, the
operator is written otherwise: first row per key is a grouped aggregate
(partial aggregation before the shuffle), and duplicate flags and previous
rows set the keys of very many rows apart.  Top-k per group uses ``row_number`` with a ``<= k`` filter, which
Spark plans as a WindowGroupLimit that keeps only k rows per group in each
map task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.session import ensure_checkpoint_dir, short_methods, small_tasks

#: Rows of the set of repeated hashes (8 bytes each) up to which it is broadcast.
BROADCAST_ROWS = 1_000_000
COPY_BLOCK = 100_000
#: Size of the bitmap that stands for a larger set (32 MB).
BITMAP_BITS = 28
#: Rows of one key beyond which it is cut into ordered parts of this size.
HOT_ROWS = 1_000_000
#: Groups of keys that are counted first when keys of many rows are looked for.
BUCKETS = 1 << 20


def ordered_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    """``df`` with ``_b``, the number of its part in the order (keys, order):
    parts of about ``rows`` rows that cut a key wherever needed.  ``_t`` is a
    random tie-break, written before the bounds are drawn, so that rows equal
    in all columns are cut as well."""
    ensure_checkpoint_dir(df.sparkSession)
    drawn = df.withColumn("_t", F.rand()).checkpoint()
    number = max(1, -(-drawn.count() // rows))
    return drawn.repartitionByRange(number, *keys, *order, "_t").withColumn("_b", F.spark_partition_id()).checkpoint()


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """The keys with more than ``rows`` rows, as ``_k0``, ``_k1``, ...; null keys are one key.

    First the rows of ``BUCKETS`` groups of keys are counted, which shuffles at most so many counts a task; keys
    themselves are counted only in groups of more than ``rows`` rows."""
    ensure_checkpoint_dir(df.sparkSession)
    named = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)])
    names = named.columns
    grouped = named.withColumn("_g", F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).cast("int"))
    large = grouped.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select("_g").checkpoint()
    if large.isEmpty():
        return df.sparkSession.createDataFrame([], named.schema)
    counts = grouped.join(F.broadcast(large), "_g", "left_semi").groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > rows).drop("_n").checkpoint()


def _same_key(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str,
                  hot_rows: int = HOT_ROWS, hot: DataFrame | None = None) -> DataFrame:
    """Add ``value`` of the previous row of the same key (in ``order``; equal
    rows in any order), null for its first row; null keys are one key.

    A key of at most ``hot_rows`` rows is one window group.  Larger keys (at
    most rows / ``hot_rows`` of them, so their list is broadcast) are cut into
    ordered parts, and the last row of a part is handed to the next one.
    ``hot``: the larger keys, if ``hot_keys`` has found them already."""
    keys, order = list(keys), list(order)
    hot = hot_keys(df, keys, hot_rows) if hot is None else hot
    lag = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    if hot.isEmpty():
        return df.withColumn(name, lag)
    same = _same_key(keys)
    cold = df.join(F.broadcast(hot), same, "left_anti").withColumn(name, lag)
    parts = ordered_parts(df.join(F.broadcast(hot), same, "left_semi"), keys, order, hot_rows)
    last = parts.groupBy(*keys, "_b").agg(F.max_by(F.struct(value.alias("v")), F.struct(*order, "_t")).alias("_last"))
    handed = last.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_b").alias("_to"),
                         F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("_before"))
    within = Window.partitionBy("_b", *keys).orderBy(*order, "_t")
    rows = parts.withColumns({"_prev": F.lag(value).over(within), "_first": F.row_number().over(within) == 1})
    rows = rows.join(handed, (F.col("_b") == F.col("_to")) & same, "left")
    rows = rows.withColumn(name, F.when(F.col("_first"), F.col("_before.v")).otherwise(F.col("_prev")))
    return cold.unionByName(rows.select(*df.columns, name))


# W1
def overlap_flags(claims: DataFrame, order_ties: Sequence[str] = ("ClaimEndDt", "ClaimID"),
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """``Overlap`` = claim starts on/before the end of the patient's
    immediately previous claim (ordered by start, then the tie keys; the
    reference's tie order is load order)."""
    prev = with_previous(claims, ["BeneID"], ["ClaimStartDt", *order_ties], F.col("ClaimEndDt"), "PrevEndDt", hot_rows)
    return prev.withColumn("Overlap", F.coalesce(F.col("ClaimStartDt") <= F.col("PrevEndDt"), F.lit(False)))


def overlap_count(claims: DataFrame) -> DataFrame:
    """Number of claims starting on/before the end of the patient's previous
    claim, without ordering a patient's claims in one task.

    In the order (start, end, ClaimID) the claims of one (patient, start,
    end) group are consecutive: every member but the first has a predecessor
    with the same end, and the first one's predecessor is the last claim of
    the previous (start, end) group - whose end is that group's end.  So the
    count needs a partial aggregation per (patient, start, end) and a ``lag``
    over the distinct date pairs of a patient, which the calendar bounds
    (a patient with billions of claims still has at most days x days pairs).

    The groups are counted when the operator is applied, in tasks whose size
    does not grow with the claims; the result is one row."""
    g = claims.groupBy("BeneID", "ClaimStartDt", "ClaimEndDt").agg(F.count(F.lit(1)).alias("n"))
    prev_end = F.lag("ClaimEndDt").over(Window.partitionBy("BeneID").orderBy("ClaimStartDt", "ClaimEndDt"))
    g = g.withColumn("prev_end", prev_end)
    first = F.coalesce((F.col("ClaimStartDt") <= F.col("prev_end")).cast("bigint"), F.lit(0))
    rest = F.coalesce((F.col("ClaimStartDt") <= F.col("ClaimEndDt")).cast("bigint"), F.lit(0)) * (F.col("n") - 1)
    count = g.agg(F.coalesce(F.sum(first + rest), F.lit(0)).cast("bigint").alias("overlap_count"))
    ensure_checkpoint_dir(claims.sparkSession)
    with small_tasks(claims.sparkSession):
        return count.checkpoint()


def overlap_count_window(claims: DataFrame) -> DataFrame:
    """The same count from the per-claim flags (one window per patient)."""
    flags = overlap_flags(claims.select("BeneID", "ClaimStartDt", "ClaimEndDt", "ClaimID"))
    return flags.agg(F.count_if("Overlap").cast("bigint").alias("overlap_count"))


# W2
def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


# W3
def flag_duplicates(df: DataFrame, keys: Sequence[str], keep: str | bool = False,
                    order: Sequence[str] | None = None, name: str = "is_duplicate",
                    hot_rows: int = HOT_ROWS, hot: DataFrame | None = None) -> DataFrame:
    """``keep=False``: every member of a group of >1 rows is flagged.
    ``keep='first'``: all but the first row of each group (by ``order``), that
    is, rows with a previous one.  Null keys are one key.

    Both number a group of at most ``hot_rows`` rows in a window over ``keys``,
    so that rows flagged twice on the same keys are shuffled once.  The members
    of a larger group need no count: all are flagged.  ``hot``: the larger
    keys, if ``hot_keys`` has found them already."""
    hot_rows = max(hot_rows, 1)
    hot = hot_keys(df, keys, hot_rows) if hot is None else hot
    if keep is False:
        several = (F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1).alias(name)
        if hot.isEmpty():
            return df.select("*", several)
        same = _same_key(keys)
        cold = df.join(F.broadcast(hot), same, "left_anti").select(*df.columns, several)
        return cold.unionByName(df.join(F.broadcast(hot), same, "left_semi").withColumn(name, F.lit(True)))
    prev = with_previous(df, keys, order or keys, F.lit(True), "_prev", hot_rows, hot)
    return prev.withColumn(name, F.col("_prev").isNotNull()).drop("_prev")


# W4
def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by ``order`` as a min_by aggregation (partial
    aggregation; no whole group in one task)."""
    rest = [c for c in df.columns if c not in key]
    agg = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return agg.select(*key, "_r.*")


def _marked(df: DataFrame, col: str, values: DataFrame) -> DataFrame:
    """Adds ``_marked``: false only where the bigint ``col`` is surely not among ``values`` (same column).
    The values' low ``BITMAP_BITS`` bits are broadcast as a bitmap, in pieces of 4096 bytes."""
    low = F.pmod(F.col(col), F.lit(1 << BITMAP_BITS))
    pieces = values.select(low.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    at = df.withColumn("_at", low).withColumns({"_piece": F.bitmap_bucket_number("_at"), "_at": F.bitmap_bit_position("_at")})
    byte = "cast(conv(hex(substring(_bits, cast(_at div 8 as int) + 1, 1)), 16, 10) as int)"
    bit = F.expr(f"(shiftright({byte}, cast(_at % 8 as int)) & 1) = 1")
    found = at.join(F.broadcast(pieces), "_piece", "left")  # at most 2 ** (BITMAP_BITS - 15) pieces
    return found.select(*df.columns, F.coalesce(bit, F.lit(False)).alias("_marked"))


# W6
def with_row_id(df: DataFrame, keys: Sequence[str] | None = None, name: str = "RowID") -> DataFrame:
    """Stable unique row key: md5 of the key columns (all columns by default),
    each written as text with a marker for null, and of the row's copy number.

    Only 64-bit hashes of these texts are counted.  Rows whose hash occurs
    once have copy number 1 and are not shuffled; the others (copies, and what
    little shares a short hash) are grouped by md5 and expanded into numbered
    copies in blocks, so a row that is repeated very often builds no long
    array.  ``keys`` must determine the other columns.
    Unlike a position-based id it is the same on every recomputation, so joins
    on it survive task retries.  The set of repeated hashes is counted when
    the operator is applied: it is broadcast up to ``BROADCAST_ROWS`` rows.
    Beyond, a bitmap of fixed size is broadcast, and only rows whose bit is set
    are shuffled to be looked up."""
    keys = list(keys or df.columns)
    cols = df.columns
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("␀")) for k in keys]
    row_id = lambda copy: F.md5(F.concat_ws("|", *parts, copy))
    short = df.withColumn("_s", F.xxhash64(F.concat_ws("|", *parts)))
    ensure_checkpoint_dir(df.sparkSession)
    repeated = short.select("_s").groupBy("_s").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_s")
    with short_methods(df.sparkSession):
        repeated = repeated.checkpoint()
    found = repeated.count()
    if not found:
        return df.withColumn(name, row_id(F.lit("1")))
    if found <= BROADCAST_ROWS:
        side, alone = F.broadcast(repeated), None
    else:
        marked = _marked(short, "_s", repeated)
        side, alone, short = repeated, marked.where("not _marked").select(*short.columns), marked.where("_marked").select(*short.columns)
    single = short.join(side, "_s", "left_anti")
    single = (single if alone is None else single.select(*alone.columns).unionByName(alone)).withColumn(name, row_id(F.lit("1")))
    copied = short.join(side, "_s", "left_semi").withColumn("_h", F.md5(F.concat_ws("|", *parts)))
    groups = copied.groupBy("_h", *cols).agg(F.count(F.lit(1)).alias("_n"))
    # different rows whose text is the same go on numbering where the one before ended
    before = Window.partitionBy("_h").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    blocks = groups.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_n - 1) div {COPY_BLOCK})")))
    copies = blocks.withColumn("_copy", F.explode(F.expr(f"sequence(_block * {COPY_BLOCK} + 1, least(_n, (_block + 1) * {COPY_BLOCK}))")))
    copies = copies.withColumn(name, row_id((F.col("_first") + F.col("_copy")).cast("string")))
    return single.select(*cols, name).unionByName(copies.select(*cols, name))
