"""What several operators share: reading tables, running sums in order, components of links."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir

__all__ = ["components", "cut_lineage", "holding", "read", "release", "running_sums", "shared_path", "without"]

#: Size of the filter of keys that is broadcast, the same for tables of any size.
KEY_BITS = 26


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path below the checkpoint folder, which driver and executors share."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so once the driver's JVM has
    collected the frames that stood for them."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence, values: Sequence[str],
                 also: Sequence[str] = ()) -> DataFrame:
    """Adds ``before_<v>``: the sum of v over the rows of the same group that stand earlier.

    Two levels, so that a group of any size is spread: rows are dealt into ranges of (group,
    order) and written once, which fixes the ranges; sums run inside each range, and the sums of
    whole ranges, one row per range and group, give the offsets. ``order`` names columns or
    gives ``(name, column)`` pairs; NULLs sort first. Rows equal in group and order take their
    places in no given order. ``also`` names further columns to keep.
    """
    names = [o if isinstance(o, str) else o[0] for o in order]
    keyed = df.withColumns({o[0]: o[1] for o in order if not isinstance(o, str)})
    keep = list(dict.fromkeys([*group, *names, *values, *also]))
    # written first: ranges are sampled, and what is read twice for it shall not be computed twice
    ranged = cut_lineage(keyed.select(*keep)).repartitionByRange(*group, *names)
    placed = cut_lineage(ranged.withColumn("range", F.spark_partition_id()))
    whole = placed.groupBy(*group, "range").agg(*[F.sum(v).alias(f"whole_{v}") for v in values])
    earlier = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select(
        *[F.col(g).alias(f"of_{g}") for g in group], F.col("range").alias("of_range"),
        *[F.coalesce(F.sum(f"whole_{v}").over(earlier), F.lit(0)).alias(f"offset_{v}") for v in values])
    inside = Window.partitionBy(*group, "range").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumns(
        {f"inside_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    on = F.col("range") == F.col("of_range")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    return summed.join(offsets, on).select(
        *keep, *[(F.col(f"offset_{v}") + F.col(f"inside_{v}")).alias(f"before_{v}") for v in values])


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b) as (node, component), named by their smallest node.

    Large-star and small-star rounds: each node hands its larger neighbours to its smallest one,
    then each node's smaller neighbours to their smallest. Rounds go on until no link changes;
    their number grows with the logarithm of a component's width. Each round is written, so a
    lost executor re-reads files.
    """
    both = F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                            F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a != b").distinct())

    def size(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())

    before = size(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        around = edges.select(both)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        edges = cut_lineage(small.filter("a != b").distinct())
        after = size(edges)
        if after == before:
            break
        before = after
    inner = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return inner.unionByName(inner.select(F.col("component").alias("node"), "component").distinct())


def keyed(docs: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """(key, doc_id, text, *also): a number of its own for every row, in doc_id order, NULL ids last.

    Where the ids are all there and all different, the key is the id. Otherwise rows are numbered
    by doc_id and a hash of the text, and written once; equal rows take their numbers in no given order.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also)
    twice = docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1")
    if twice.isEmpty():
        return docs.select(F.col("doc_id").alias("key"), "doc_id", "text", *also)
    rows = docs.withColumns({"one": F.lit(1), "none": F.col("doc_id").isNull(), "text_hash": F.xxhash64("text")})
    numbered = running_sums(rows, [], ["none", "doc_id", "text_hash"], ["one"], ["text", *also])
    return cut_lineage(numbered.select(F.col("before_one").cast("long").alias("key"), "doc_id", "text", *also))


def among(keys: DataFrame) -> Column:
    """Whether the column ``key`` may be one of ``keys`` (key): true for all of them and for few others.

    One bit for each value of the hashed keys, 2 ** KEY_BITS in all; the more keys there are, the more
    others pass, so a join has to follow.
    """
    def hashed():
        return F.pmod(F.xxhash64("key"), F.lit(1 << KEY_BITS))

    told = keys.select(hashed().alias("h")).groupBy(F.shiftright("h", 6).cast("int").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(h & 63 AS INT)))").alias("bits")).toArrow()
    bits = np.zeros((1 << KEY_BITS) + 63 >> 6, np.int64)
    bits[told.column("at").to_numpy()] = told.column("bits").to_numpy()
    sent = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def marked(h: pd.Series) -> pd.Series:
        at = h.to_numpy(np.int64)
        return pd.Series((sent.value[at >> 6] >> (at & 63)) & 1 > 0)

    return marked(hashed())


def holding(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` may be among ``keys``, found where they are: a join that follows moves them only."""
    return rows.filter(among(keys))


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is not among ``keys``, of which only those that may be are moved."""
    maybe = among(keys)
    return rows.filter(~maybe).unionByName(rows.filter(maybe).join(keys.select("key").distinct(), "key", "left_anti"))
