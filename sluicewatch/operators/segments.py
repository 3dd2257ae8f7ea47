"""Ordered operators that never put a whole series into one task.

A plain ``Window.partitionBy(series).orderBy(...)`` sends each series to one task, and one
series may hold a third of all rows. Here order is split in two levels instead:

* a *segment* is any expression that does not decrease along the order (an hour of the
  timestamp, a file split, a value range). Work inside a segment is a window on
  (keys, segment); the carry between segments is a window over one row per segment.
* once rows have a position, a *block* is ``position div block_rows``. Windows with a bounded
  frame run per (keys, block) after the few rows around each block edge are copied into the
  neighbour, so every task gets the same number of rows however long the series is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK_ROWS = 65_536


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                 segment: Column, sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums along ``order`` within ``keys``.

    ``order`` must be unique within ``keys`` and ``segment`` monotone along it; neither may
    be NULL. ``segment`` ascending must agree with the order's direction.
    """
    on = [*keys, "_seg"]
    data = df.withColumn("_seg", segment)
    totals = data.groupBy(*on).agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = (Window.partitionBy(*keys).orderBy("_seg")
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(*on, *[
        F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = (Window.partitionBy(*on).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = data.select("*", *[F.sum(c).over(inside).alias(f"_s_{n}") for n, c in sums.items()])
    out = out.join(carry, on)
    return out.select(*df.columns, *[
        (F.col(f"_s_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                   segment: Column, pos: str = "rn") -> DataFrame:
    """Number the rows of each series from 0 along ``order`` (the row position)."""
    out = running_sums(df, keys, order, segment, {pos: F.lit(1).cast("long")})
    return out.withColumn(pos, F.col(pos) - 1)


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``df`` with ``_range``, a segment for ``running_sums`` where no column makes one: rows are dealt into ranges
    of (keys, order) by sampled bounds, each about as large, and written, which fixes the ranges."""
    dealt = cut_lineage(df).repartitionByRange(*keys, *order)
    return cut_lineage(dealt.withColumn("_range", F.spark_partition_id()))


def ranged_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column]) -> DataFrame:
    """``running_sums`` over sampled ranges, so also a group without keys or with one value of them is spread."""
    return running_sums(ranged(df, keys, order), keys, order, F.col("_range"), sums).drop("_range")


def halo_windows(df: DataFrame, keys: Sequence[str],
                 build: Callable[[WindowSpec], list[dict[str, Column]]],
                 before: int = 0, after: int = 0, pos: str = "rn",
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add window columns whose frame reaches at most ``before``/``after`` rows away.

    ``build(w)`` gets the (keys, block) window ordered by position and returns stages; a
    stage may use the columns of the stages before it, and ``before``/``after`` must cover
    the reach of all stages together. Positions must run without gaps from 0.
    """
    size = max(block_rows, before, after, 1)
    home, at = F.floor(F.col(pos) / F.lit(size)), F.col(pos) % F.lit(size)
    copies = [F.array(home)]
    if before:
        copies.append(F.when(at >= size - before, F.array(home + 1))
                      .otherwise(F.array().cast("array<bigint>")))
    if after:
        copies.append(F.when((at < after) & (home > 0), F.array(home - 1))
                      .otherwise(F.array().cast("array<bigint>")))
    block = F.explode(F.concat(*copies)) if len(copies) > 1 else home
    spread = df.select("*", block.alias("_blk"))
    for stage in build(Window.partitionBy(*keys, "_blk").orderBy(pos)):
        spread = spread.select("*", *[c.alias(n) for n, c in stage.items()])
    return spread.filter(F.col("_blk") == home).drop("_blk")


def carry_values(df: DataFrame, keys: Sequence[str], cols: Sequence[str], pos: str = "rn",
                 forward: bool = True, backward: bool = False,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fill NULLs with the last earlier value, then (optionally) the next later value."""
    on = [*keys, "_blk"]
    data = df.withColumn("_blk", F.floor(F.col(pos) / F.lit(block_rows)))
    aggs = []
    for c in cols:
        seen = F.when(F.col(c).isNotNull(), F.col(pos))
        aggs += [F.max_by(c, seen).alias(f"_l_{c}"), F.min_by(c, seen).alias(f"_f_{c}")]
    edges = data.groupBy(*on).agg(*aggs)
    w = Window.partitionBy(*keys).orderBy("_blk")
    prev, nxt = (w.rowsBetween(Window.unboundedPreceding, -1),
                 w.rowsBetween(1, Window.unboundedFollowing))
    edges = edges.select(
        *on,
        *[F.last(f"_l_{c}", ignorenulls=True).over(prev).alias(f"_p_{c}") for c in cols],
        *[F.first(f"_f_{c}", ignorenulls=True).over(nxt).alias(f"_n_{c}") for c in cols])
    wi = Window.partitionBy(*on).orderBy(pos)
    back = wi.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = wi.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    joined = data.join(edges, on)
    filled = {}
    for c in cols:
        options = []
        if forward:
            options += [F.last(c, ignorenulls=True).over(back), F.col(f"_p_{c}")]
        else:
            options += [F.col(c)]
        if backward:
            options += [F.first(c, ignorenulls=True).over(ahead), F.col(f"_n_{c}")]
        filled[c] = F.coalesce(*options)
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c)
                           for c in df.columns])
