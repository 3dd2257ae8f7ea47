"""State signatures: under which conditions an automaton gets from its start to each state.

A path asks for one term of every guard on it. The signature of a state is the OR of what its paths
ask for. ``path_signatures`` lists all simple paths, for small graphs. ``state_signatures`` folds
terms along the edges instead and keeps, for each state, only those that no other implies: a path
with a loop asks for all that the path without it does, so the least terms over all walks are those
over the simple paths, and the fold ends on cyclic graphs too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import DNF_TYPE
from ..session import cut_lineage
from .graph import chains, simple_paths

INITIAL = "[initial]"


def term_texts(dnf: Column) -> Column:
    """array<array<string>>: each term's conditions as text, sorted, without repeats."""
    return F.array_distinct(F.transform(dnf, lambda t: F.array_sort(F.array_distinct(
        F.transform(t, lambda c: F.concat_ws(" ", c["var"], c["op"], c["val"]))))))


def conditions_text(terms: Column) -> Column:
    """Terms as text, in the order of that text: one as it is, several in brackets; an empty one is the start's mark."""
    each = F.transform(terms, lambda t: F.when(F.size(t) == 0, INITIAL).otherwise(F.array_join(t, " AND ")))
    several = F.array_join(F.array_sort(F.transform(each, lambda x: F.concat(F.lit("("), x, F.lit(")")))), " OR ")
    return F.when(F.size(terms) == 1, each[0]).otherwise(several)


def _joined(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def _not_implied(new: DataFrame, by: DataFrame, on: Sequence[str], equal: bool) -> DataFrame:
    """The rows (on, term) of ``new`` that hold no term of ``by`` of the same node, but maybe (not ``equal``) their own.

    A smaller term is looked up by its first condition among those of the larger one; an empty term implies all.
    """
    known = by.select(*on, F.col("term").alias("less"), F.when(F.size("term") > 0, F.try_element_at("term", F.lit(1))).otherwise("").alias("c"))
    looked = new.select(*on, "term", F.explode(F.concat(F.array(F.lit("")), "term")).alias("c"))
    smaller = F.size(F.array_except("less", "term")) == 0
    smaller = smaller if equal else smaller & (F.size("less") < F.size("term"))
    implied = looked.join(known, [*on, "c"]).filter(smaller).select(*on, "term").distinct()
    return new.join(implied, [*on, "term"], "left_anti")


def state_signatures(edges: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, term): the least terms of every state that the starts reach, an empty one for a start.

    ``edges`` have (frm, to, dnf); a NULL guard is TRUE, one without terms can't be passed. Chains of states
    are passed in one step, with their guards joined by doubling, so the turns follow the branching.
    """
    on = [*keys, "node"]
    true = F.array(F.array()).cast(DNF_TYPE)
    first = cut_lineage(starts.select(*on).distinct())
    ways = edges.filter(F.col("frm") != F.col("to")).select(
        *keys, "frm", "to", F.explode(term_texts(F.coalesce("dnf", true))).alias("ask")).distinct()
    ways = cut_lineage(_not_implied(ways.withColumnRenamed("ask", "term"), ways.withColumnRenamed("ask", "term"), [*keys, "frm", "to"], False)
                       .withColumnRenamed("term", "ask"))
    inner = cut_lineage(chains(ways, keys, first).filter("head IS NOT NULL"))
    # what a chain's node asks for from its head on: spans of 1, 2, 4, ... hops joined end to end
    reach = cut_lineage(ways.join(inner.select(*keys, F.col("node").alias("to")), [*keys, "to"], "left_semi").select(
        *keys, "frm", F.col("to").alias("node"), F.col("ask").alias("term")))
    while True:
        longer = reach.select(*keys, F.col("node").alias("frm"), F.col("frm").alias("before"), F.col("term").alias("earlier"))
        open_ = reach.join(longer, [*keys, "frm"])
        if open_.isEmpty():
            break
        grown = open_.select(*keys, F.col("before").alias("frm"), "node", _joined(F.col("term"), F.col("earlier")).alias("term"))
        still = reach.join(longer.select(*keys, "frm").distinct(), [*keys, "frm"], "left_anti")
        reach = cut_lineage(still.unionByName(_least(grown.distinct(), [*keys, "frm", "node"]).select(*still.columns)))
    outer = ways.join(inner.select(*keys, F.col("node").alias("to")), [*keys, "to"], "left_anti")
    from_inner = outer.join(reach.select(*keys, F.col("node").alias("frm"), F.col("frm").alias("head"), "term"), [*keys, "frm"]).select(
        *keys, F.col("head").alias("frm"), "to", _joined(F.col("ask"), F.col("term")).alias("ask"))
    plain = outer.join(inner.select(*keys, F.col("node").alias("frm")), [*keys, "frm"], "left_anti").select(*keys, "frm", "to", "ask")
    steps = cut_lineage(plain.unionByName(from_inner).filter(F.col("frm") != F.col("to")).distinct())

    known = cut_lineage(first.withColumn("term", F.array().cast("array<string>")))
    fresh = known
    while True:
        found = fresh.withColumnRenamed("node", "frm").join(steps, [*keys, "frm"]).select(
            *keys, F.col("to").alias("node"), _joined(F.col("term"), F.col("ask")).alias("term")).distinct()
        found = cut_lineage(_not_implied(found, known, on, True))
        fresh = cut_lineage(_least(found, on))
        if fresh.isEmpty():
            break
        known = cut_lineage(_not_implied(known, fresh, on, True).unionByName(fresh))
    passed = reach.select(*keys, "node", F.col("frm").alias("head"), F.col("term").alias("ask")).join(
        known.withColumnRenamed("node", "head"), [*keys, "head"]).select(*on, _joined(F.col("term"), F.col("ask")).alias("term")).distinct()
    return known.unionByName(_least(cut_lineage(passed), on))


def _least(terms: DataFrame, on: Sequence[str]) -> DataFrame:
    return _not_implied(terms, terms, on, False).select(*terms.columns)


def path_signatures(edges: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, paths, terms): all different terms of a state's simple paths, and how many paths there are.

    ``edges`` have (frm, to, ord, dnf) with a number of its own for each edge. Their number may grow exponentially.
    """
    asked = edges.select(*keys, F.col("ord").cast("long").alias("ord"), term_texts("dnf").alias("ask"))
    paths = simple_paths(edges, starts, keys).withColumn("pid", F.xxhash64("path"))
    steps = paths.select(*keys, "node", "pid", "path", F.posexplode_outer("steps").alias("at", "ord")).join(asked, [*keys, "ord"], "left")
    each = steps.groupBy(*keys, "node", "path").agg(F.array_sort(F.collect_list(F.struct("at", "ask"))).alias("asks"))
    none = F.array(F.array().cast("array<string>"))
    terms = F.aggregate("asks", none, lambda acc, step: F.when(step["ask"].isNull(), acc).otherwise(F.array_distinct(F.flatten(
        F.transform(acc, lambda t: F.transform(step["ask"], lambda u: F.array_sort(F.array_union(t, u))))))))
    told = each.select(*keys, "node", "path", F.explode(terms).alias("term"))
    return told.groupBy(*keys, "node").agg(F.count_distinct("path").alias("paths"), F.collect_set("term").alias("terms"))
