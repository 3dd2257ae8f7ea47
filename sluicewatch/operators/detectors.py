"""State-based detectors and flag fusion.

Automaton states, transitions and rule sets are joined without hints: their size decides at
run time whether Spark broadcasts them, and hot keys on the trace side are split by AQE.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import values_map, violation_count_data
from .segments import halo_windows


def previous_state(df: DataFrame, keys: Sequence[str], state: str = "state",
                   out: str = "prev") -> DataFrame:
    return halo_windows(df, keys, lambda w: [{out: F.lag(state).over(w)}], before=1)


def observed_transitions(df: DataFrame, keys: Sequence[str], state: str = "state") -> DataFrame:
    """Distinct state changes (prev, state) seen in any series; stutters are left out."""
    moves = previous_state(df, keys, state).filter(F.col("prev") != F.col(state))
    return moves.select("prev", state).distinct()


def with_known(df: DataFrame, known: DataFrame, state: str = "state",
               out: str = "known") -> DataFrame:
    """Add whether the row's state is one of ``known`` (a one-column frame)."""
    marks = known.select(F.col(known.columns[0]).alias(state)).distinct().withColumn(
        out, F.lit(True))
    return df.join(marks, state, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def transition_flags(df: DataFrame, keys: Sequence[str], known: DataFrame, allowed: DataFrame,
                     state: str = "state", out: str = "y_pred_gfsm") -> DataFrame:
    """1 for an unknown state, or a state change the automaton does not have.

    The first row of a series flags only when unknown; a change back from an unknown state
    flags too. ``allowed`` has (prev, state).
    """
    marked = with_known(previous_state(df, keys, state, "_prev"), known, state, "_known")
    pairs = allowed.select(F.col(allowed.columns[0]).alias("_prev"),
                           F.col(allowed.columns[1]).alias(state)).distinct()
    marked = marked.join(pairs.withColumn("_ok", F.lit(True)), ["_prev", state], "left")
    moved = (F.col("rn") > 0) & (F.col("_prev") != F.col(state))
    flag = ~F.col("_known") | (moved & F.col("_ok").isNull())
    return marked.select(*df.columns, flag.cast("int").alias(out))


def rule_counts(df: DataFrame, phi: DataFrame, features: Sequence[str],
                state: str = "state") -> DataFrame:
    """Add ``absent`` (state not in ``phi``) and ``violations`` (broken rules of the state).

    ``phi`` has (state, rules) with ``rules`` of ``functions.rules.RULES_TYPE``.
    """
    sets = phi.select(F.col("state").alias(state), F.col("rules").alias("_rules"),
                      F.lit(True).alias("_in"))
    joined = df.join(sets, state, "left")
    return joined.select(
        *df.columns, F.col("_in").isNull().alias("absent"),
        violation_count_data(F.col("_rules"), values_map(features)).alias("violations"))


def phi_flags(df: DataFrame, phi: DataFrame, features: Sequence[str], k: int,
              state: str = "state", out: str = "y_pred_invariants") -> DataFrame:
    """1 where the state is absent from the rules or at least ``k`` rules are broken."""
    c = rule_counts(df, phi, features, state)
    flag = F.col("absent") | (F.col("violations") >= max(1, k))
    return c.withColumn(out, flag.cast("int")).drop("absent", "violations")


def violation_threshold(counts: DataFrame, budget: float) -> DataFrame:
    """Smallest k >= 1 with mean(absent or violations >= k) <= budget, as one row (k, note).

    The rate only changes just above a count that occurs, so the histogram of counts (at most
    one row per possible count) holds every candidate.
    """
    if not 0.0 < budget < 1.0:
        raise ValueError(f"fp-budget must be in (0, 1), got {budget!r}")
    # A row that counts for nothing makes k = 1 a candidate even when no row has zero violations.
    zero = counts.sparkSession.range(1).select(F.lit(0).alias("violations"), F.lit(0).alias("n"), F.lit(0).alias("gone"))
    hist = counts.select("violations", F.lit(1).alias("n"), F.col("absent").cast("int").alias("gone")).unionByName(zero)
    hist = hist.groupBy("violations").agg(F.sum("n").alias("n"), F.sum("gone").alias("gone"))
    above = Window.orderBy(F.desc("violations")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    all_rows = F.sum("n").over(everything)
    steps = hist.select(
        (F.col("violations") + 1).alias("k"), F.when(all_rows > 0, F.max("violations").over(everything)).alias("top"),
        F.try_divide(F.coalesce(F.sum(F.col("n") - F.col("gone")).over(above), F.lit(0))
                     + F.sum("gone").over(everything), all_rows).alias("rate"))
    both = steps.agg(F.min(F.when(F.col("rate") <= budget, F.col("k"))).alias("met"),
                     F.max("top").alias("top"), F.min("rate").alias("floor"))
    return both.select(
        F.coalesce("met", F.col("top") + 1, F.lit(1)).cast("int").alias("k"),
        F.when(F.col("met").isNull() & F.col("top").isNotNull(), F.format_string(
            "no threshold keeps clean rows within %s: rows without a known state already flag %.4f of them, "
            "so rules are set to flag nothing", F.lit(str(budget)), "floor")).alias("note"))


def _any(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [f.cast("int") != 0 for f in flags])


def fuse_or(flags: Sequence[Column]) -> Column:
    if not flags:
        raise ValueError("fuse_or needs at least one flag column")
    return _any(flags).cast("int")


def fuse_intersection(logical: Sequence[Column], physical: Sequence[Column]) -> Column:
    """(any logical) and (any physical); 0 when a side has no detector."""
    if not logical or not physical:
        return F.lit(0)
    return (_any(logical) & _any(physical)).cast("int")
