"""Exact, linearly interpolated percentiles without gathering a group in one task.

The built-in ``percentile`` keeps every distinct value of a group in one reducer. Here one wide
aggregate finds each metric's range, a second pass counts all metrics in ``CELLS`` cells of their
ranges, which tasks merge before anything is shuffled, and only values in the cells that hold
a wanted rank are looked at again. Of those, a cell with more than ``CELLS`` different values is cut
again in the same way, else its values are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CELLS = 4_096


def percentiles(df: DataFrame, keys: Sequence[str], metrics: dict[str, Column],
                targets: dict[str, tuple[str, float]], cells: int = CELLS,
                more: Sequence[tuple[DataFrame, dict[str, Column]]] = ()) -> DataFrame:
    """One row per ``keys`` with a column per target; several metrics share each pass.

    ``metrics`` maps a metric to its value (NULL and NaN are left out), ``targets`` maps an
    output column to (metric, percentile 0..100). Also adds ``n_<metric>`` counts. ``more``
    brings metrics of other frames into the same passes.
    """
    group = [*keys, "metric"]
    frames, ranges = [], None
    for own, its in [(df, metrics), *more]:
        value = {m: c.cast("double") for m, c in its.items()}
        narrow = cut_lineage(own.select(*keys, *[F.when(~F.isnan(v), v + F.lit(0.0)).alias(m) for m, v in value.items()]))
        frames.append((narrow, list(its)))
        wide = narrow.groupBy(*keys).agg(*[x for m in its for x in (
            F.count(m).alias(f"n_{m}"), F.min(m).alias(f"lo_{m}"), F.max(m).alias(f"hi_{m}"))])
        told = wide.select(*keys, F.inline(F.array(*[F.struct(
            F.lit(m).alias("metric"), *[F.col(f"{x}_{m}").alias(x) for x in ("n", "lo", "hi")]) for m in its])))
        ranges = told if ranges is None else ranges.unionByName(told)
    stats = cut_lineage(ranges)
    wanted = F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(o).alias("target"), F.lit(p / 100.0).alias("q"))
        for o, (m, p) in targets.items()]))
    ranks = (stats.filter("n > 0").select(*group, "n", wanted.alias("t")).filter(F.col("t.m") == F.col("metric"))
             .select(*group, "t.target", ((F.col("n") - 1) * F.col("t.q")).alias("h"))
             .withColumn("r0", F.floor("h")).withColumn("r1", F.ceil("h")))

    def holds(rank: str) -> Column:
        return ((F.col(rank) >= F.col("start"))
                & (F.col(rank) < F.col("start") + F.col("cnt")))

    def cell_of(v: Column, lo: Column, hi: Column) -> Column:
        # infinite values count as the largest whose difference is finite; the least and largest part in any case
        v, lo, hi = (F.greatest(F.least(x, F.lit(8e307)), F.lit(-8e307)) for x in (v, lo, hi))
        return F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * cells), F.lit(cells - 1))).otherwise(F.lit(0)).cast("long")

    def wanted_cells(counts: DataFrame) -> DataFrame:
        """Of (group, rid, below, cell, cnt, clo, chi) the cells that hold a wanted rank, with the ranks below them."""
        earlier = (Window.partitionBy(*group, "rid").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
        placed = counts.withColumn("start", F.col("below") + F.coalesce(F.sum("cnt").over(earlier), F.lit(0)))
        return cut_lineage(placed.join(ranks, group).filter(holds("r0") | holds("r1"))
                           .select(*group, "rid", "cell", "start", "clo", "chi").distinct())

    def attached(side: DataFrame, names: Sequence[str], column: str, as_: str) -> DataFrame:
        """``side`` (group, column) with a column for each metric, one row a key."""
        wide = side.filter(F.col("metric").isin(*names)).groupBy(*keys).agg(*[
            F.first(F.when(F.col("metric") == m, F.col(column)), ignorenulls=True).alias(f"{as_}_{m}") for m in names])
        return wide if keys else F.broadcast(wide)

    # Level by level a range is cut into cells. The first level reads the rows: a task keeps a count for each metric and cell.
    spans = stats.select(*group, F.struct("lo", "hi").alias("span"))
    located, counts = [], None
    for narrow, names in frames:
        side = attached(spans, names, "span", "_s")
        joined = narrow.join(side, list(keys)) if keys else narrow.crossJoin(side)
        long = joined.select(*keys, F.inline(F.array(*[F.struct(
            F.lit(m).alias("metric"), F.col(m).alias("v"), cell_of(F.col(m), F.col(f"_s_{m}.lo"), F.col(f"_s_{m}.hi")).alias("cell"))
            for m in names]))).filter("v IS NOT NULL")
        located.append(long)
        own = long.groupBy(*group, "cell").agg(F.count(F.lit(1)).alias("cnt"), F.min("v").alias("clo"), F.max("v").alias("chi"))
        counts = own if counts is None else counts.unionByName(own)
    zero = F.lit(0).cast("long")
    kept = wanted_cells(counts.select(*group, zero.alias("rid"), zero.alias("below"), "cell", "cnt", "clo", "chi"))
    rows = None
    for long in located:  # only rows in a wanted cell are looked at again
        held = long.join(kept if keys else F.broadcast(kept), [*group, "cell"]).groupBy(*group, "start", "v").agg(F.count(F.lit(1)).alias("c"))
        rows = held if rows is None else rows.unionByName(held)
    rows = cut_lineage(rows.select(*group, "v", "c", F.col("start").alias("rid"), F.col("start").alias("below")))
    ranges = kept.select(*group, F.col("start").alias("rid"), F.col("clo").alias("lo"), F.col("chi").alias("hi"))
    while True:
        # a range with more different values than one sort shall hold is cut again
        many = rows.groupBy(*group, "rid").agg(F.count(F.lit(1)).alias("values")).filter(F.col("values") > cells)
        many = cut_lineage(many.select(*group, "rid"))
        if many.isEmpty():
            break
        open_ = rows.join(many, [*group, "rid"], "left_semi")
        inside = open_.join(ranges, [*group, "rid"]).withColumn("cell", cell_of(F.col("v"), F.col("lo"), F.col("hi")))
        kept = wanted_cells(inside.groupBy(*group, "rid", "below", "cell").agg(
            F.sum("c").alias("cnt"), F.min("v").alias("clo"), F.max("v").alias("chi")))
        finer = inside.join(kept, [*group, "rid", "cell"]).select(
            *group, "v", "c", F.col("start").alias("rid"), F.col("start").alias("below"))
        rows = cut_lineage(rows.join(many, [*group, "rid"], "left_anti").unionByName(finer))
        ranges = cut_lineage(ranges.join(many, [*group, "rid"], "left_anti").unionByName(kept.select(
            *group, F.col("start").alias("rid"), F.col("clo").alias("lo"), F.col("chi").alias("hi"))))
    earlier = (Window.partitionBy(*group, "rid").orderBy("v")
               .rowsBetween(Window.unboundedPreceding, -1))
    exact = rows.withColumn("cnt", F.col("c")).withColumn(
        "start", F.col("below") + F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    picked = (exact.join(ranks, group).filter(holds("r0") | holds("r1"))
              .groupBy(*group, "target", "h", "r0")
              .agg(F.max(F.when(holds("r0"), F.col("v"))).alias("x0"),
                   F.max(F.when(holds("r1"), F.col("v"))).alias("x1"))
              .withColumn("val", F.when(F.col("x0") == F.col("x1"), F.col("x0")).otherwise(
                  F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("h") - F.col("r0")))))
    wide = picked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("target") == o, F.col("val"))).alias(o) for o in targets])
    every = {**metrics, **{m: c for _, its in more for m, c in its.items()}}
    counts = stats.groupBy(*keys).agg(*[
        F.coalesce(F.max(F.when(F.col("metric") == m, F.col("n"))), F.lit(0)).alias(f"n_{m}")
        for m in every])
    if not keys:  # both sides are one row
        return wide.crossJoin(F.broadcast(counts))
    return counts.join(wide, list(keys), "left")
