"""Mixing sources to target weights.

Every source gets a budget of words by its weight. Its documents are put into a random but
repeatable order by a hash of their ids, their sizes are summed along that order in ranges, and
the source is cut at its exact budget. A budget above the source's size repeats whole epochs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read, running_sums

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def hash_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from ``sizes`` (source, source_size), one row a source.

    Sources in code-point order, NULL last, take the weights in turn. The budgets share the sum of
    all sizes by weight; where one is above ``most`` times its source it stops there and the rest
    is shared again. With sources sorted by capacity per weight the capped ones come first, so
    running sums of capacities and weights decide each source, without rounds. Sums are exact
    decimals; only the target itself is a double. Sources without words get 0.
    """
    sizes = sizes.withColumns({"one": F.lit(1), "none": F.col("source").isNull()})
    ranked = running_sums(sizes, [], ["none", "source"], ["one"], ["source_size"])
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          (F.col("before_one") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(ranked.select(
        "source", "source_size", weight.cast("decimal(12,0)").alias("weight"),
        (F.lit(most) * F.col("source_size")).cast("decimal(25,0)").alias("most")))
    whole = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, all_weights = int(whole[0] or 0), int(whole[1] or 0)
    filled = running_sums(ranked, [], [("fill", F.col("most").cast("double") / F.col("weight").cast("double")), "source"],
                          ["most", "weight"], ["source_size"])
    capped = (F.col("most") * (F.lit(all_weights).cast("decimal(12,0)") - F.col("before_weight"))
              <= (F.lit(total).cast("decimal(25,0)") - F.col("before_most")) * F.col("weight"))
    decided = cut_lineage(filled.withColumn("capped", capped))
    rest = decided.agg(F.sum(F.when(F.col("capped"), F.col("most"))),
                       F.sum(F.when(~F.col("capped"), F.col("weight")))).first()
    left, shares = total - int(rest[0] or 0), int(rest[1] or 1)
    shared = (F.col("weight") * F.lit(left).cast("decimal(25,0)")).cast("double") / F.lit(float(shares))
    return decided.select("source", "source_size", "weight",
                          F.when(F.col("capped"), F.col("most").cast("double")).otherwise(shared).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS,
        also: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    ``taken`` counts words: each whole epoch takes the document's size, the last, partial epoch
    takes the documents in hash order until the budget is spent, the one at the cut in part. So a
    source's taken words are its target rounded to whole words, and no document is above ``most``
    times its size. NULL texts and texts of white space have size 0; NULL sources form one source;
    rows with one doc_id are separate documents with one key (equal ones stand in no given order, which
    leaves the multiset of results the same). An empty table gives no rows. Other columns,
    whatever their names, are ignored unless named in ``also``.
    """
    sized = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), *also)
    placed = cut_lineage(running_sums(sized, ["source"], [("hash_key", hash_key(F.col("doc_id"))), "doc_id", "size"],
                                      ["size"], also))
    goals = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    goals = goals.select(F.col("source").alias("of_source"), "source_size", "target",
                         F.round("target").cast("long").alias("budget"))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    cut = F.when(F.col("source_size") > 0, F.col("budget") % F.col("source_size")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), cut - F.col("before_size")))
    return placed.join(goals, F.col("source").eqNullSafe(F.col("of_source"))).select(
        "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"),
        *also)


def expand(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with the columns of ``docs``.

    The document at a source's cut ends after its last word inside the budget; ``n_chars``, where
    there is one, follows. Documents without words are in no budget and leave. Rows that share
    a doc_id stay separate rows.
    """
    twins = Window.partitionBy("doc_id", "text_hash").orderBy("text_hash")
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text", "source").alias("text_hash"))
    whole = whole.withColumn("twin", F.row_number().over(twins))
    keyed = docs.select("doc_id", "source", "text", F.xxhash64("text", "source").alias("text_hash"))
    mixed = mix(keyed, weights, most, also=["text_hash"]).select(
        F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "size", "taken",
        F.row_number().over(twins).alias("of_twin"))
    mixed = whole.join(mixed.filter("taken > 0"), F.col("doc_id").eqNullSafe(F.col("of_id"))
                       & (F.col("text_hash") == F.col("of_hash")) & (F.col("twin") == F.col("of_twin")))
    copies = F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)
    each = mixed.withColumn("copy", F.explode(copies))
    left = F.col("taken") - F.col("copy") * F.col("size")
    pieces = F.slice(F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), left.cast("int"))
    text = F.when(left >= F.col("size"), F.col("row.text")).otherwise(F.array_join(pieces, ""))
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return each.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, 3 * source_size AS most,
         coalesce(sum(3 * source_size) OVER o, 0) AS m0, coalesce(sum(w) OVER o, 0) AS w0,
         sum(source_size) OVER () AS total, sum(w) OVER () AS ws
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, most * (ws - w0) <= (total - m0) * w AS capped FROM f),
r AS (
  SELECT max(total) - coalesce(sum(CASE WHEN capped THEN most END), 0) AS rest,
         coalesce(sum(CASE WHEN NOT capped THEN w END), 1) AS shares FROM c
), t AS (
  SELECT source, source_size::BIGINT AS source_size,
         CASE WHEN capped THEN most::DOUBLE ELSE (w * rest)::DOUBLE / shares::DOUBLE END AS target
  FROM c, r
), p AS (
  SELECT doc_id, size, source_size, target, round(target)::BIGINT AS budget,
         (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS b4
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
             + greatest(0, least(size, budget % source_size - b4)) END)::BIGINT AS taken
FROM p
"""

QUERIES = {"op6_mixing": op6_mixing}
ORACLES = {"op6_mixing": SQL}
