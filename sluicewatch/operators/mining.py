"""Association rules per composite state.

The rules come from a deterministic search: every feature is cut at its exact quartiles within the
state, the bins that occur together often enough are found level by level, and each way to split
such a set into antecedent and consequent is scored by support, confidence and lift.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import number
from ..session import cut_lineage
from .quantiles import percentiles

# Quality gates.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_OBSERVATIONS = 0.1, 0.7, 50
QUARTILES = (25, 50, 75)


def state_support(df: DataFrame, min_observations: int = MIN_OBSERVATIONS) -> DataFrame:
    return df.groupBy("state").agg(F.count(F.lit(1)).alias("observations")).withColumn(
        "status", F.when(F.col("observations") < min_observations, "insufficient_data")
        .otherwise("ok"))


def bin_vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(state, bins, n): the different rows of bins and how many rows have them.

    ``bins`` holds (f, b, lo, hi), a quartile bin of the state and the range of its values here, for each
    feature that has a value, in the order of the names. This is all that the search reads.
    """
    cuts = percentiles(df, ["state"], {f: number(F.col(f)) for f in features}, {
        f"_{f}_{q}": (f, float(q)) for f in features for q in QUARTILES})
    joined = df.select("state", *features).join(cuts, "state")
    names = sorted(features)
    bins = [F.when(number(F.col(f)).isNotNull(), sum(
        ((number(F.col(f)) > F.col(f"_{f}_{q}")).cast("int") for q in QUARTILES), F.lit(0))).alias(f"b{i}")
        for i, f in enumerate(names)]
    values = [number(F.col(f)).alias(f"v{i}") for i, f in enumerate(names)]
    counted = joined.select("state", *bins, *values).groupBy("state", *[f"b{i}" for i in range(len(names))]).agg(
        F.count(F.lit(1)).alias("n"), *[g(f"v{i}").alias(f"{c}{i}") for i in range(len(names)) for g, c in ((F.min, "lo"), (F.max, "hi"))])
    items = [F.when(F.col(f"b{i}").isNotNull(), F.struct(F.lit(f).alias("f"), F.col(f"b{i}").alias("b"), F.col(f"lo{i}").alias("lo"),
                                                         F.col(f"hi{i}").alias("hi"))) for i, f in enumerate(names)]
    return counted.select("state", F.filter(F.array(*items), lambda x: x.isNotNull()).alias("bins"), "n")


def frequent_sets(vectors: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """(state, items, n): the sets of up to ``most`` bins (f, b) that at least ``least`` (state, least) rows hold.

    Level by level: two frequent sets that differ in their last bin make a candidate if all its subsets are
    frequent, and only rows that hold the first of the two and the last bin of the other count for it. Rows that are
    the same in their bins are one row with a weight.
    """
    vectors = cut_lineage(vectors.join(least, "state").select(
        "state", "n", "least", F.monotonically_increasing_id().alias("vid"), F.transform("bins", lambda x: F.struct(x["f"], x["b"])).alias("bins")))
    told = vectors.select("vid", "state", "n", "least", F.explode("bins").alias("item"))
    level = cut_lineage(told.groupBy("state", "item").agg(F.sum("n").alias("n"), F.first("least").alias("least")).filter(
        "n >= least").select("state", F.array("item").alias("items"), "n", "least"))
    single = cut_lineage(told.join(level.select("state", F.col("items")[0].alias("item")), ["state", "item"], "left_semi"))
    held = single.select("vid", "state", "n", F.array("item").alias("items"))
    found = level.select("state", "items", "n")
    for size in range(2, most + 1):
        ends = level.select("state", "least", F.slice("items", 1, size - 2).alias("start"), F.col("items")[size - 2].alias("last"))
        other = ends.select("state", "start", F.col("last").alias("item"))
        made = ends.join(other, ["state", "start"]).filter(F.col("last.f") < F.col("item.f")).select(
            "state", "least", F.concat("start", F.array("last")).alias("first"), "item")
        parts = made.withColumn("items", F.concat("first", F.array("item"))).withColumn(
            "part", F.explode(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.filter("items", lambda x, k: k != i - 1))))
        whole = parts.join(level.select("state", F.col("items").alias("part")), ["state", "part"], "left_semi").groupBy(
            "state", "items").agg(F.count(F.lit(1)).alias("parts"), F.first("least").alias("least"), F.first("first").alias("first"),
                                  F.first("item").alias("item")).filter(F.col("parts") == size)
        wanted = cut_lineage(whole.select("state", "least", "first", "item"))
        if wanted.isEmpty():
            break
        may = held.join(wanted.select("state", F.col("first").alias("items"), "item", "least"), ["state", "items"])
        held = cut_lineage(may.join(single.select("vid", "item"), ["vid", "item"]).select(
            "vid", "state", "n", "least", F.concat("items", F.array("item")).alias("items")))
        level = cut_lineage(held.groupBy("state", "items").agg(F.sum("n").alias("n"), F.first("least").alias("least")).filter("n >= least"))
        held = held.select("vid", "state", "n", "items").join(level.select("state", "items"), ["state", "items"], "left_semi")
        found = found.unionByName(level.select("state", "items", "n"))
    return found


def mine_rules(df: DataFrame, features: Sequence[str], most_antecedents: int = 3, most_consequents: int = 1,
               min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               min_observations: int = MIN_OBSERVATIONS) -> DataFrame:
    """Rules ``bins => bins`` per state that has enough rows.

    (state, id, antecedent, consequent, n_both, n_antecedent, support, confidence, lift); both sides are arrays of
    (f, b, lo, hi), a feature's quartile bin and the range of its values in the state, in the order of the names.
    """
    support = cut_lineage(state_support(df, min_observations).filter("status = 'ok'"))
    vectors = cut_lineage(bin_vectors(df, features))
    # support as a share of rows: the smallest count that reaches it
    least = support.select("state", F.greatest(F.lit(1), F.ceil(F.col("observations") * min_support - 1e-9)).alias("least"))
    sets = cut_lineage(frequent_sets(vectors, least, most_antecedents + most_consequents))
    ranges = vectors.select("state", F.explode("bins").alias("x")).groupBy("state", "x.f", "x.b").agg(
        F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
    # each set in all ways of two sides: the bits of a number say which side a bin is on
    sides = sets.filter(F.size("items") > 1).select("state", "items", F.col("n").alias("n_both"), F.explode(
        F.expr("sequence(1, cast(shiftleft(1, size(items)) as int) - 2)")).alias("bits"))
    sides = sides.select("state", "n_both", F.expr("filter(items, (x, i) -> (shiftright(bits, i) & 1) = 1)").alias("antecedent"),
                         F.expr("filter(items, (x, i) -> (shiftright(bits, i) & 1) = 0)").alias("consequent"))
    sides = sides.filter((F.size("antecedent") <= most_antecedents) & (F.size("consequent") <= most_consequents))
    counts = [sets.select("state", F.col("items").alias(c), F.col("n").alias(f"n_{c}")) for c in ("antecedent", "consequent")]
    scored = (sides.join(counts[0], ["state", "antecedent"]).join(counts[1], ["state", "consequent"]).join(support, "state")
              .withColumn("support", F.col("n_both") / F.col("observations"))
              .withColumn("confidence", F.col("n_both") / F.col("n_antecedent"))
              .withColumn("lift", F.col("confidence") * F.col("observations") / F.col("n_consequent"))
              .filter((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)))
    name = F.array_join(F.transform(F.concat("antecedent", "consequent"), lambda x: F.concat_ws("_", x["f"], x["b"].cast("string"))), "_")
    name = F.concat(name, F.when(F.size("antecedent") > 1, F.concat(F.lit("/"), F.size("antecedent").cast("string"))).otherwise(""))
    ranged = ranges.groupBy("state").agg(F.map_from_entries(F.collect_list(F.struct(  # features x bins entries
        F.struct("f", "b"), F.struct("lo", "hi")))).alias("_ranges"))

    def atoms(c: str):
        return F.transform(c, lambda x: F.struct(x["f"].alias("f"), x["b"].alias("b"), F.element_at("_ranges", x)["lo"].alias("lo"),
                                                 F.element_at("_ranges", x)["hi"].alias("hi")))

    return scored.join(ranged, "state").select("state", name.alias("id"), atoms("antecedent").alias("antecedent"), atoms("consequent").alias("consequent"),
                                               "n_both", "n_antecedent", "support", "confidence", "lift")


def mine_pairs(df: DataFrame, features: Sequence[str], min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE,
               min_observations: int = MIN_OBSERVATIONS) -> DataFrame:
    """Rules ``f1 in bin => f2 in bin`` per state, with the observed range of each bin."""
    rules = mine_rules(df, features, 1, 1, min_support, min_confidence, min_observations)
    a, c = F.col("antecedent")[0], F.col("consequent")[0]
    return rules.select("state", *[x[k].alias(f"{k}{i}") for i, x in ((1, a), (2, c)) for k in ("f", "b", "lo", "hi")],
                        F.col("n_both").alias("both"), "support", "confidence", "lift")


def rule_sets(rules: DataFrame, support: DataFrame) -> DataFrame:
    """(state, observations, status, rules) with ``mine_rules`` as data; states without rules stay.

    The rules of a state number at most 1 / support for each antecedent, whatever its rows.
    """
    def side(c: str):
        return F.transform(c, lambda x: F.struct(x["f"].alias("col"), F.lit("in").alias("op"), x["lo"].alias("lo"), x["hi"].alias("hi"))).alias(c)

    sets = rules.groupBy("state").agg(F.array_sort(F.collect_list(F.struct(
        "id", side("antecedent"), side("consequent"), "support", "confidence", "lift"))).alias("rules"))
    full = support.join(sets, "state", "left")
    empty = F.array().cast(full.schema["rules"].dataType)
    return full.withColumn("rules", F.coalesce("rules", empty))
