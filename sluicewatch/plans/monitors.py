"""Monitors as Spark ML stages: fitted on clean rows, applied to others, saved and loaded.

A saved monitor is a folder: ``known``, ``allowed`` and ``phi`` are tables, ``monitor`` holds the profile, the limits,
the formulas and the settings as one line of JSON. All of it goes through Spark, so the folder may lie in any store.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import is_dataclass
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession

from .. import profiles
from . import hybrid

TABLES = ("known", "allowed", "phi")


def packed(x: Any) -> Any:
    """A value as JSON that gives the same value back: keys keep their type, pairs stay pairs."""
    if is_dataclass(x):
        return {"record": type(x).__name__, "of": packed(vars(x))}
    if isinstance(x, dict):
        return {"dict": [[packed(k), packed(v)] for k, v in x.items()]}
    if isinstance(x, tuple):
        return {"tuple": [packed(v) for v in x]}
    return [packed(v) for v in x] if isinstance(x, list) else x


def unpacked(x: Any) -> Any:
    if isinstance(x, dict):
        if "record" in x:
            return getattr(profiles, x["record"])(**unpacked(x["of"]))
        if "dict" in x:
            return {unpacked(k): unpacked(v) for k, v in x["dict"]}
        return tuple(unpacked(v) for v in x["tuple"])
    return [unpacked(v) for v in x] if isinstance(x, list) else x


class HybridMonitor(Estimator):
    """Learns limits, rules and known moves from clean rows with ``state``, ``rn`` and the profile's columns.

    ``frame`` names the runs of the clean rows, ``keys`` the series of the rows to be watched. ``automaton`` brings known
    states and allowed moves; without it those that the clean rows show are taken.
    """

    def __init__(self, profile: profiles.Network, features: Sequence[str], frame: str, keys: Sequence[str], fusion: str = "intersection",
                 fp_budget: float = hybrid.FP_BUDGET, frame_segment: Column | None = None,
                 automaton: tuple[DataFrame, DataFrame] | None = None):
        super().__init__()
        self.profile, self.features, self.frame, self.keys = profile, list(features), frame, list(keys)
        self.fusion, self.fp_budget, self.frame_segment, self.automaton = fusion, fp_budget, frame_segment, automaton

    def _fit(self, dataset: DataFrame) -> HybridMonitorModel:
        fitted = hybrid.fit(dataset, self.profile, self.features, self.frame, self.keys, self.frame_segment,
                            automaton=self.automaton, fp_budget=self.fp_budget)
        return HybridMonitorModel(fitted, self.keys, self.fusion)


class HybridMonitorModel(Model):
    """Adds y_pred_stl, score, y_pred_gfsm, y_pred_invariants and the fused y_pred to rows with ``state`` and ``rn``."""

    def __init__(self, fitted: hybrid.Fitted, keys: Sequence[str], fusion: str = "intersection"):
        super().__init__()
        self.fitted, self.keys, self.fusion = fitted, list(keys), fusion

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return hybrid.predict(dataset, self.keys, self.fitted, self.fusion)

    def save(self, path: str) -> None:
        """Writes the folder ``path`` anew."""
        m = self.fitted
        for name in TABLES:
            getattr(m, name).write.mode("overwrite").parquet(f"{path}/{name}")
        told = {"profile": m.profile, "params": m.params, "specs": m.specs, "k": m.k, "note": m.note, "features": m.features,
                "keys": self.keys, "fusion": self.fusion}
        line = m.known.sparkSession.createDataFrame([(json.dumps(packed(told)),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{path}/monitor")

    @staticmethod
    def load(spark: SparkSession, path: str) -> HybridMonitorModel:
        told = unpacked(json.loads(spark.read.text(f"{path}/monitor").first()["value"]))
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
        fitted = hybrid.Fitted(told["profile"], told["params"], told["specs"], *[tables[t] for t in TABLES],
                               told["k"], told["note"], told["features"])
        return HybridMonitorModel(fitted, told["keys"], told["fusion"])
