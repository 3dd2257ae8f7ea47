"""Derived signals and run-length filters over positioned traces."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.formulas import fire_count
from ..functions.rules import number
from ..profiles import CONFIRM, SMOOTH, Network
from .segments import halo_windows


def step(x: Column, w: WindowSpec) -> Column:
    """x minus its previous row; NULL on the first row."""
    return x - F.lag(x).over(w)


def step0(x: Column, w: WindowSpec, pos: str = "rn") -> Column:
    """x minus its previous row, 0 on the first row of the series."""
    return F.when(F.col(pos) == 0, 0.0).otherwise(step(x, w))


def total(cols: Sequence[str]) -> Column:
    """Row-wise sum of the named columns; 0 when there are none."""
    return reduce(lambda a, b: a + b, [number(F.col(c)) for c in cols], F.lit(0.0))


def rolling_sum(x: Column, w: WindowSpec, rows: int, full_only: bool) -> Column:
    """Sum over the last ``rows`` rows; partial windows are NULL or summed as they are."""
    frame = w.rowsBetween(-(rows - 1), 0)
    if full_only:
        return F.when(F.count(x).over(frame) == rows, F.sum(x).over(frame))
    return F.coalesce(F.sum(x).over(frame), F.lit(0.0))


def centered_max(x: Column, w: WindowSpec, width: int) -> Column:
    """Maximum over a centred window; partial windows count."""
    return F.max(x).over(w.rowsBetween(-(width // 2), (width - 1) // 2))


def run_stages(raw: Column, k: int, w: WindowSpec, pos: str = "rn",
               out: str = "confirmed") -> list[dict[str, Column]]:
    """Confirm every run of at least ``k`` consecutive raw hits, from the run's first row."""
    if k <= 1:
        return [{out: raw}]
    full = F.when(F.col(pos) >= k - 1, F.min(raw).over(w.rowsBetween(-(k - 1), 0)))
    return [{f"_{out}_full": F.coalesce(full, F.lit(0))},
            {out: F.max(f"_{out}_full").over(w.rowsBetween(0, k - 1))}]


def hysteresis(df: DataFrame, keys: Sequence[str], raw: str, k: int,
               out: str = "confirmed") -> DataFrame:
    done = halo_windows(df, keys, lambda w: run_stages(F.col(raw), k, w, out=out),
                        before=k - 1, after=k - 1)
    return done.drop(f"_{out}_full")


def signal_stages(profile: Network, params: dict[str, Any], columns: Sequence[str],
                  w: WindowSpec) -> list[dict[str, Column]]:
    """Run-time signals of a profile: differences, mass-balance residuals, pump heads."""
    have = set(columns)
    first: dict[str, Column] = {}
    for c in [*(t.level for t in profile.tanks), *profile.pressures]:
        if c in have:
            first[f"d{c}"] = step0(number(F.col(c)), w)
    for pump in profile.pumps:
        down, up = pump.lift or (None, None)
        if {down, up} <= have:
            first[f"HEAD_PU{pump.unit}"] = number(F.col(down)) - number(F.col(up))
    resid, rolls = {}, {}
    for tank, mb in params["mb"].items():
        feeders = [f for f in mb["feeders"] if f in have]
        if f"d{tank}" not in first:
            first[f"d{tank}"] = step0(number(F.col(tank)), w)
        r = f"MB_RESID_{tank}"
        resid[r] = F.col(f"d{tank}") - F.lit(mb["alpha"]) * total(feeders) - F.lit(mb["offset"])
        for name in params["mb_window"].get(tank, {}):
            rolls[f"MB_ROLL_{tank}_{name}"] = rolling_sum(
                F.col(r), w, int(name.lstrip("w")), full_only=False)
    return [s for s in (first, resid, rolls) if s]


def signal_reach(params: dict[str, Any]) -> int:
    """How many earlier rows the signals look at."""
    return max([int(n.lstrip("w")) for ws in params["mb_window"].values() for n in ws] + [1])


def build_signals(df: DataFrame, keys: Sequence[str], profile: Network,
                  params: dict[str, Any]) -> DataFrame:
    return halo_windows(df, keys, lambda w: signal_stages(profile, params, df.columns, w),
                        before=signal_reach(params))


def stl_flags(df: DataFrame, keys: Sequence[str], profile: Network, params: dict[str, Any],
              specs: dict[str, str]) -> DataFrame:
    """Add ``fires`` (violated formulas), ``y_pred_stl`` (confirmed flag) and ``score``.

    Signals, formulas, run-length filter and smoothing share one shuffle.
    """
    k, width = CONFIRM, SMOOTH

    def stages(w: WindowSpec) -> list[dict[str, Column]]:
        signals = signal_stages(profile, params, df.columns, w)
        names = [*df.columns, *[n for s in signals for n in s]]
        raw = (F.col("fires") >= profile.fires).cast("int")
        return [*signals, {"fires": fire_count(specs, names)},
                *run_stages(raw, k, w, out="y_pred_stl"),
                {"score": centered_max(F.col("fires"), w, width).cast("double")}]

    reach = max(k - 1, width // 2)
    flagged = halo_windows(df, keys, stages, before=signal_reach(params) + reach,
                           after=max(k - 1, (width - 1) // 2))
    return flagged.select(*df.columns, "fires", "y_pred_stl", "score")
