"""The hybrid monitor: three detectors fitted on clean frames, fused and scored.

Fitting leaves behind profile-sized limits (driver) and three small frames: known states,
allowed moves and rule sets. Prediction is one plan per split.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import synthesize
from ..functions.rules import RULES_TYPE
from ..operators import detectors, metrics, mining
from ..operators.calibrate import calibrate
from ..operators.signals import stl_flags
from ..profiles import Network
from ..session import cut_lineage

FP_BUDGET = 0.01


@dataclass
class Fitted:
    profile: Network
    params: dict[str, Any]
    specs: dict[str, str]
    known: DataFrame
    allowed: DataFrame
    phi: DataFrame
    k: int
    note: str | None
    features: list[str]


def mine(clean: DataFrame, features: Sequence[str], fp_budget: float = FP_BUDGET,
         min_observations: int = mining.MIN_OBSERVATIONS, most_antecedents: int = 1) -> tuple[DataFrame, int, str | None]:
    """Rule sets per state of clean rows (with a ``state`` column) and the threshold K."""
    support = mining.state_support(clean, min_observations)
    if not features:  # nothing to state rules about
        return cut_lineage(support.withColumn("rules", F.array().cast(RULES_TYPE))), 1, None
    phi = cut_lineage(mining.rule_sets(
        mining.mine_rules(clean, features, most_antecedents, min_observations=min_observations), support))
    chosen = detectors.violation_threshold(
        detectors.rule_counts(clean, phi, features), fp_budget).first()
    return phi, chosen["k"], chosen["note"]


def fit(clean: DataFrame, profile: Network, features: Sequence[str], frame: str,
        keys: Sequence[str], frame_segment: Column | None = None,
        unordered: DataFrame | None = None, automaton: tuple[DataFrame, DataFrame] | None = None,
        fp_budget: float = FP_BUDGET) -> Fitted:
    """Learn limits, rules and (without a given automaton) the moves clean rows show."""
    clean = cut_lineage(clean)  # read by several passes below
    rows = clean if unordered is None else unordered
    params = calibrate(clean, profile, frame, frame_segment, rows)
    known, allowed = automaton or (
        rows.select("state").distinct(), detectors.observed_transitions(clean, keys))
    phi, k, note = mine(rows, features, fp_budget)
    return Fitted(profile, params, synthesize(profile, params), known, allowed, phi, k, note,
                  list(features))


def predict(df: DataFrame, keys: Sequence[str], m: Fitted,
            fusion: str = "intersection") -> DataFrame:
    """Add y_pred_stl, score, y_pred_gfsm, y_pred_invariants and the fused y_pred."""
    out = stl_flags(df, keys, m.profile, m.params, m.specs)
    out = detectors.transition_flags(out, keys, m.known, m.allowed)
    out = detectors.phi_flags(out, m.phi, m.features, m.k)
    g, v, s = (F.col(f"y_pred_{n}") for n in ("gfsm", "invariants", "stl"))
    fused = (detectors.fuse_intersection([g, v], [s]) if fusion == "intersection"
             else detectors.fuse_or([s, g, v]))
    return out.withColumn("y_pred", fused)


def score(predictions: DataFrame, keys: Sequence[str], y: str = "label") -> DataFrame:
    """Metrics per key; the temporal-logic score ranks even when another detector decides."""
    return metrics.detection_metrics(predictions, keys, y, "y_pred", "score")


def ablation(predictions: DataFrame, keys: Sequence[str] = (), y: str = "label") -> DataFrame:
    """Metrics of the arms gfsm (or rules), stl, and both joined, on their 0/1 decisions."""
    g = detectors.fuse_or([F.col("y_pred_gfsm"), F.col("y_pred_invariants")])
    s = F.col("y_pred_stl").cast("int")
    arms = F.array(*[F.struct(F.lit(n).alias("arm"), c.alias("y_pred")) for n, c in (
        ("gfsm", g), ("stl", s), ("gfsm_or_stl", detectors.fuse_or([g, s])))])
    long = predictions.select(*keys, F.col(y).alias("y_true"), F.inline(arms))
    long = long.withColumn("score", F.col("y_pred").cast("double"))
    scored = metrics.detection_metrics(long, [*keys, "arm"])
    sizes = long.groupBy(*keys, "arm").agg(F.count(F.lit(1)).alias("n"),
                                           F.sum("y_true").alias("attack_rows"))
    return sizes.join(scored, [*keys, "arm"])
