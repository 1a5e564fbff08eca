"""Ordered operations (running totals, positions, carry-forward, previous value) without one task per group.

A plain window over ``partitionBy(key)`` puts a whole key in one task. Here every key is cut into blocks that
follow the order, the window runs inside ``(key, block)``, and a small table with one row per block carries the
state from block to block. A key that holds a third of all rows is spread over as many tasks as it has blocks.
The input is read twice (rows, block totals); give a checkpointed input when it is expensive.

``block`` is a column that is non-decreasing along ``order`` within a key, e.g. ``position div 100000``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000


def block_of(position: Column, size: int = BLOCK_ROWS) -> Column:
    return F.floor(position / F.lit(size)).cast("long")


def _with_block(df: DataFrame, block: Column) -> DataFrame:
    return df.withColumn("_blk", block)


def _attach(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of the per-block carry table. The rows are already partitioned by (keys, block), so only the small
    table moves. Keys must not be null."""
    return df.join(carry, [*keys, "_blk"], "left")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence, value: Column, block: Column, out: str, total: str | None = None
) -> DataFrame:
    """Inclusive running sum of ``value`` per key along ``order``; ``total`` names a column for the sum of the key."""
    b = _with_block(df.withColumn("_v", value), block)
    totals = b.groupBy(*keys, "_blk").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("_before", F.sum("_t").over(before))
    if total:
        carry = carry.withColumn(total, F.sum("_t").over(Window.partitionBy(*keys)))
    carry = carry.drop("_t")
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumn("_local", F.sum("_v").over(inside))
    return (
        _attach(local, carry, keys)
        .withColumn(out, F.coalesce(F.col("_before"), F.lit(0)) + F.coalesce(F.col("_local"), F.lit(0)))
        .drop("_v", "_blk", "_before", "_local")
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence, block: Column, out: str, total: str | None = None
) -> DataFrame:
    """1-based positions per key along ``order``, and the number of rows of the key when ``total`` is given."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), block, out, total)


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence, values: dict[str, Column], block: Column) -> DataFrame:
    """For each output name, the latest non-null value at or before the row."""
    b = _with_block(df, block)
    for name, col in values.items():
        b = b.withColumn(f"_v_{name}", col)
    point = F.struct(*order)
    last = b.groupBy(*keys, "_blk").agg(
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), point)).alias(f"_t_{n}")
            for n in values
        ]
    )
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(
        *keys, "_blk", *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values]
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = b.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(inside).alias(f"_l_{n}") for n in values])
    joined = _attach(local, carry, keys)
    for n in values:
        joined = joined.withColumn(n, F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")))
    return joined.drop("_blk", *[f"_{p}_{n}" for n in values for p in ("v", "l", "c")])


def previous(df: DataFrame, keys: Sequence[str], order: Sequence, value: Column, block: Column, out: str) -> DataFrame:
    """Value of the row before, per key along ``order`` (null for the first row; ``value`` must not be null)."""
    b = _with_block(df.withColumn("_v", value), block)
    last = b.groupBy(*keys, "_blk").agg(F.max_by("_v", F.struct(*order)).alias("_t"))
    carry = last.select(*keys, "_blk", F.lag("_t").over(Window.partitionBy(*keys).orderBy("_blk")).alias("_c"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order)
    local = b.withColumn("_l", F.lag("_v").over(inside))
    return _attach(local, carry, keys).withColumn(out, F.coalesce("_l", "_c")).drop("_v", "_l", "_c", "_blk")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key along ``order``: a map-side combined aggregate, so copies are never gathered."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
