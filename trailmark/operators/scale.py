"""Join and window helpers that keep hot keys and growing sides in check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A side is broadcast only after it was counted to stay below this many rows.
BROADCAST_ROWS = 200_000
SPREAD = 32


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `max_rows` rows. Stops reading after `max_rows + 1`."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` in at least as many partitions as there are cores, for costly work per row.

    A scan of fewer files than cores is shuffled by `key`; other frames are left alone. The files are
    counted from the plan, so nothing runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 0 < len(df.inputFiles()) < cores else df


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    spread_by: Column | None = None,
    max_rows: int = BROADCAST_ROWS,
    small_fits: bool | None = None,
) -> DataFrame:
    """Join a large side with one that is usually small.

    The small side is counted, unless the caller has already checked a bound on it (`small_fits`);
    below `max_rows` it is broadcast. Above that both sides are
    shuffled, and with `spread_by` (a column expression on `big`) every key of the large side is
    spread over SPREAD sub-keys while the other side is copied to each of them, so that one hot key
    never lands in a single task. It is then a merge join: Spark takes the copies of a written table for
    as small as its files and would broadcast them, beyond what the driver's memory holds.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if is_small(small, max_rows) if small_fits is None else small_fits:
        return big.join(F.broadcast(small), keys, how)
    if spread_by is None:
        return big.join(small.hint("merge"), keys, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First `k` rows per key in `order`, numbered from 1.

    Spark plans this as a group limit: each task keeps k rows per key before the shuffle.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("long")).filter(F.col(rank) <= k)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_rows(df, keys, order, 1, "_first").drop("_first")


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    segment: Column,
    order: Sequence[str],
    value: Column,
    out: str,
) -> DataFrame:
    """Adds `out`: the latest non-null `value` among earlier rows of the same key.

    Rows of a key are processed per `segment`, an expression that never decreases along `order`
    (an hour, a block of turns). One key with a third of all rows is then a set of segments spread
    over the cluster. Only one row per segment, holding its last value, is combined per key.
    """
    work = df.withColumn("_seg", segment).withColumn("_val", value)
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = work.withColumn("_prev", F.last("_val", ignorenulls=True).over(inside))

    sort_key = F.struct(*[F.col(c) for c in order])
    # One row per segment, combined before the shuffle; a segment without a value still looks back.
    segments = work.groupBy(*keys, "_seg").agg(
        F.max_by("_val", F.when(F.col("_val").isNotNull(), sort_key)).alias("_tail")
    )
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    incoming = segments.select(
        *keys, "_seg", F.last("_tail", ignorenulls=True).over(before).alias("_incoming")
    ).filter(F.col("_incoming").isNotNull())
    return (
        local.join(incoming, [*keys, "_seg"], "left")
        .withColumn(out, F.coalesce("_prev", "_incoming"))
        .drop("_seg", "_val", "_prev", "_incoming")
    )
