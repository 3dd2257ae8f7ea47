"""Limits learned from clean frames: each function returns one lazy row of limits."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import number
from ..profiles import BALANCE_ROWS, LIMITS, MARGIN, Limit, Network
from .quantiles import percentiles
from .segments import halo_windows, ranged, with_positions
from .signals import rolling_sum, step, total


def with_steps(df: DataFrame, frame: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Add ``d<col>``: difference to the previous row of the frame, NULL on its first row."""
    return halo_windows(df, frame, lambda w: [
        {f"d{c}": step(number(F.col(c)), w) for c in cols}], before=1)


def boundary_steps(df: DataFrame, frame: str, cols: Sequence[str],
                   frame_segment: Column | None = None) -> DataFrame:
    """Differences between each frame's first row and the last row of the frame before.

    Frames are chained in the order of ``frame``; only one row per frame is looked at.
    """
    edges = df.groupBy(frame).agg(*[x for c in cols for x in (
        F.min_by(number(F.col(c)), "rn").alias(f"_first_{c}"),
        F.max_by(number(F.col(c)), "rn").alias(f"_last_{c}"))])
    if frame_segment is None:
        edges = ranged(edges, [], [frame])
    edges = with_positions(edges, [], [frame], F.col("_range") if frame_segment is None else frame_segment)
    linked = halo_windows(edges, [], lambda w: [{
        f"d{c}": F.col(f"_first_{c}") - F.lag(f"_last_{c}").over(w) for c in cols}], before=1)
    return linked.select(*[f"d{c}" for c in cols])


def chained_steps(df: DataFrame, frame: str, cols: Sequence[str],
                  frame_segment: Column | None = None) -> DataFrame:
    """Row-to-row differences of all frames laid end to end."""
    inside = with_steps(df, [frame], cols).select(*[f"d{c}" for c in cols])
    return inside.unionByName(boundary_steps(df, frame, cols, frame_segment))


def on(status: str) -> Column:
    return number(F.col(status)) > 0.5


def off(status: str) -> Column:
    return number(F.col(status)) <= 0.5


def tank_bounds(df: DataFrame, tank: str, low: float, high: float, margin: float = MARGIN) -> DataFrame:
    x = number(F.col(tank))
    return df.agg(
        F.greatest(F.lit(low), F.min(x) - margin).alias("h_min"),
        F.least(F.lit(high), F.max(x) + margin).alias("h_max"))


def slew_limit(steps: DataFrame, col: str, limit: Limit) -> DataFrame:
    p = percentiles(steps, [], {"d": F.abs(F.col(f"d{col}"))}, {"p": ("d", limit.percentile)})
    return p.select(limit.of(F.col("p")).alias("slew_max"))


def flow_envelope(df: DataFrame, status: str, flow: str, pct: float) -> DataFrame:
    """Flow percentiles while on and while off, with counts and the on fraction."""
    f = number(F.col(flow))
    p = percentiles(df, [], {"on": F.when(on(status), f), "off": F.when(off(status), F.abs(f))},
                    {"on_lo": ("on", 100 - pct), "on_hi": ("on", pct), "off_hi": ("off", pct)})
    frac = df.agg(F.avg(F.coalesce(on(status), F.lit(False)).cast("double")).alias("frac"))
    return p.crossJoin(F.broadcast(frac))  # one row each


def pump_mode(df: DataFrame, status: str, flow: str | None, pct: float) -> DataFrame:
    if flow is None:
        return df.agg(F.lit("status_only").alias("mode"),
                      F.avg(F.coalesce(on(status), F.lit(False)).cast("double")).alias("on_fraction"))
    e = flow_envelope(df, status, flow, pct)
    mode = (F.when(F.col("frac") < 0.005, "always_off").when(F.col("frac") > 0.995, "always_on")
            .otherwise("varying"))
    varies = F.col("mode") != "always_off"
    return e.withColumn("mode", mode).select(
        "mode",
        F.when(varies, F.coalesce(F.col("on_lo") - 1.0, F.lit(0.0))).alias("f_on_min"),
        F.when(varies, F.coalesce(F.col("on_hi") + 1.0, F.lit(0.0))).alias("f_on_max"),
        F.when(F.col("n_off") > 5, F.col("off_hi") + 0.5).otherwise(0.5).alias("f_off_max"))


def valve_envelope(df: DataFrame, status: str, flow: str, pct: float) -> DataFrame:
    return flow_envelope(df, status, flow, pct).select(
        F.coalesce(F.col("on_lo") - 1.0, F.lit(0.0)).alias("f_on_min"),
        F.coalesce(F.col("on_hi") + 1.0, F.lit(0.0)).alias("f_on_max"),
        F.coalesce(F.col("off_hi") + 0.5, F.lit(0.5)).alias("f_off_max"))


def head_envelope(df: DataFrame, status: str, down: str, up: str) -> DataFrame:
    """Pump head limits; no row unless the pump was on more than 100 times."""
    head = F.when(on(status), number(F.col(down)) - number(F.col(up)))
    runs = F.sum(F.coalesce(on(status), F.lit(False)).cast("int")).alias("n_on")
    p = percentiles(df, [], {"h": head}, {"lo": ("h", 0.5), "hi": ("h", 99.5)})
    return (p.crossJoin(F.broadcast(df.agg(runs))).filter(F.col("n_on") > 100)
            .select((F.col("lo") - 2.0).alias("h_min"), (F.col("hi") + 2.0).alias("h_max")))


def pressure_limits(df: DataFrame, junction: str, low: float, high: float) -> DataFrame:
    p = percentiles(df, [], {"p": number(F.col(junction))}, {"lo": ("p", low), "hi": ("p", high)})
    return p.select((F.col("lo") - 1.0).alias("p_min"), (F.col("hi") + 1.0).alias("p_max"))


def symmetry_limit(df: DataFrame, c1: str, c2: str, limit: Limit = LIMITS["gap"]) -> DataFrame:
    """Limit on the gap between two signals; no row below 100 usable rows."""
    p = percentiles(df, [], {"d": F.abs(number(F.col(c1)) - number(F.col(c2)))},
                    {"p": ("d", limit.percentile)})
    return p.filter(F.col("n_d") >= 100).select(limit.of(F.col("p")).alias("threshold"))


def mass_balance_fit(steps: DataFrame, tank: str, feeders: Sequence[str],
                     keys: Sequence[str] = ()) -> DataFrame:
    """Least squares of the level step on the feeder flow (slope 0 for a constant flow)."""
    return mass_balance_fits(steps, {tank: feeders}, keys).toDF(
        *keys, "alpha", "offset", "r2", "n")


def mass_balance_fits(steps: DataFrame, feeder_map: dict[str, Sequence[str]],
                      keys: Sequence[str] = ()) -> DataFrame:
    aggs = []
    for tank, feeders in feeder_map.items():
        y = F.col(f"d{tank}")
        x = F.when(y.isNotNull(), total(feeders))
        y = F.when(x.isNotNull(), y)
        aggs += [F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias(f"alpha_{tank}"),
                 F.coalesce(F.regr_intercept(y, x), F.avg(y)).alias(f"offset_{tank}"),
                 F.coalesce(F.regr_r2(y, x), F.lit(0.0)).alias(f"r2_{tank}"),
                 F.count(y).alias(f"n_{tank}")]
    return steps.groupBy(*keys).agg(*aggs)


def residual(tank: str, feeders: Sequence[str]) -> Column:
    """Level step minus its fit; needs the one-row fit joined on."""
    return F.col(f"d{tank}") - F.col(f"alpha_{tank}") * total(feeders) - F.col(f"offset_{tank}")


def residual_rows(steps: DataFrame, frame: Sequence[str], feeder_map: dict[str, Sequence[str]],
                  windows: Sequence[int]) -> DataFrame:
    """Add resid_<tank> and roll_<tank>_w<k>; ``steps`` carries the fit's columns.

    Inside the rolling sums a frame's first row counts as residual 0.
    """
    rows = steps.select("*", *[residual(t, f).alias(f"resid_{t}") for t, f in feeder_map.items()])

    def rolls(w):
        start = {t: F.when(F.col("rn") == 0, 0.0).otherwise(F.col(f"resid_{t}"))
                 for t in feeder_map}
        return [{f"roll_{t}_w{k}": rolling_sum(x, w, k, full_only=True)
                 for t, x in start.items() for k in windows}] if windows else []

    return halo_windows(rows, frame, rolls, before=max(windows, default=1))


def residual_metrics(tanks: Sequence[str], profile: Network):
    """(metrics, targets) of the residual percentiles."""
    metrics, targets = {}, {}
    for t in tanks:
        metrics[f"r_{t}"] = F.abs(F.col(f"resid_{t}"))
        targets[f"p_{t}"] = (f"r_{t}", LIMITS["balance"].percentile)
        for k in BALANCE_ROWS:
            metrics[f"{t}_w{k}"] = F.abs(F.col(f"roll_{t}_w{k}"))
            targets[f"p_{t}_w{k}"] = (f"{t}_w{k}", LIMITS["balance_window"].percentile)
    return metrics, targets


MIN_POOL = 100  # steps a tank needs, and full windows a window length needs


def mass_balance_limits(df: DataFrame, frame: Sequence[str], feeder_map: dict[str, Sequence[str]],
                        profile: Network) -> DataFrame:
    """One row: alpha, offset, r2, n, eps and eps_w<k> per tank, suffixed with the tank."""
    steps = with_steps(df, frame, list(feeder_map))
    fit = mass_balance_fits(steps, feeder_map)
    rows = residual_rows(steps.crossJoin(F.broadcast(fit)), frame, feeder_map,  # one row
                         BALANCE_ROWS)
    both = fit.crossJoin(F.broadcast(percentiles(rows, [], *residual_metrics(list(feeder_map), profile))))
    out = []
    for t in feeder_map:
        enough = F.col(f"n_{t}") >= MIN_POOL
        out += [F.when(enough, F.col(f"{c}_{t}")).alias(f"{c}_{t}") for c in ("alpha", "offset", "r2")]
        out += [F.col(f"n_{t}"), F.when(enough, LIMITS["balance"].of(F.col(f"p_{t}")))
                .alias(f"eps_{t}")]
        out += [F.when(enough & (F.col(f"n_{t}_w{k}") >= MIN_POOL),
                       LIMITS["balance_window"].of(F.col(f"p_{t}_w{k}"))).alias(f"eps_{t}_w{k}")
                for k in BALANCE_ROWS]
    return both.select(*out)


def calibrate(df: DataFrame, profile: Network, frame: str = "frame",
              frame_segment: Column | None = None,
              unordered: DataFrame | None = None) -> dict[str, Any]:
    """All limits of a profile as a nested dict; only profile-sized rows reach the driver.

    ``unordered`` may give the same rows without positions for the order-free limits.
    """
    have = set(df.columns)
    out: dict[str, Any] = {k: {} for k in (
        "mb", "mb_window", "tank", "pump", "valve", "head", "pressure", "pslew", "symmetry")}
    feeders = {t: [f for f in fs if f in have] for t, fs in profile.feeders().items() if t in have}
    feeders = {t: fs for t, fs in feeders.items() if fs}
    more, targets, fit = [], {}, None
    if feeders:
        steps = with_steps(df, [frame], list(feeders))
        fit = mass_balance_fits(steps, feeders).first()
        fitted = steps.select("*", *[F.lit(fit[f"{c}_{t}"]).cast("double").alias(f"{c}_{t}")
                                     for t in feeders for c in ("alpha", "offset")])
        metrics, targets = residual_metrics(list(feeders), profile)
        more.append((residual_rows(fitted, [frame], feeders, BALANCE_ROWS), metrics))
    tanks = [t.level for t in profile.tanks if t.level in have]
    joints = [j for j in profile.pressures if j in have]
    if tanks or joints:
        steps = chained_steps(df, frame, [*tanks, *joints], frame_segment)
        more.append((steps, {f"d_{c}": F.abs(F.col(f"d{c}")) for c in [*tanks, *joints]}))
        targets |= {f"step_{t}": (f"d_{t}", LIMITS["level_step"].percentile) for t in tanks}
        targets |= {f"step_{j}": (f"d_{j}", LIMITS["pressure_step"].percentile) for j in joints}

    # Everything that does not depend on row order: one aggregate; all percentiles share passes.
    aggs, values = [], {}
    pct = LIMITS["flow"].percentile
    for t in tanks:
        aggs += [F.min(number(F.col(t))).alias(f"min_{t}"), F.max(number(F.col(t))).alias(f"max_{t}")]
    flows = {}
    for pump in profile.pumps:
        if pump.status in have:
            flows[("pump", pump.unit)] = (pump.status, pump.flow if pump.flow in have else None)
    for valve in profile.valves:
        if {valve.status, valve.flow} <= have:
            flows[("valve", valve.unit)] = (valve.status, valve.flow)
    for (kind, i), (status, flow) in flows.items():
        name = f"{kind}_{i}"
        is_on = F.coalesce(on(status), F.lit(False))
        aggs.append(F.avg(is_on.cast("double")).alias(f"frac_{name}"))
        if flow is not None:
            values[f"{name}_on"] = F.when(on(status), number(F.col(flow)))
            values[f"{name}_off"] = F.when(off(status), F.abs(number(F.col(flow))))
            targets[f"{name}_lo"] = (f"{name}_on", 100 - pct)
            targets[f"{name}_hi"] = (f"{name}_on", pct)
            targets[f"{name}_off"] = (f"{name}_off", pct)
    heads = {}
    for pump in profile.pumps:
        pid, status, (down, up) = pump.unit, pump.status, pump.lift or (None, None)
        if {down, up, status} <= have:
            heads[pid] = status
            aggs.append(F.sum(F.coalesce(on(status), F.lit(False)).cast("long")).alias(f"runs_{pid}"))
            values[f"head_{pid}"] = F.when(on(status), number(F.col(down)) - number(F.col(up)))
            targets[f"head_{pid}_lo"] = (f"head_{pid}", 0.5)
            targets[f"head_{pid}_hi"] = (f"head_{pid}", 99.5)
    for j in joints:
        values[f"at_{j}"] = number(F.col(j))
        targets[f"at_{j}_lo"] = (f"at_{j}", LIMITS["pressure_low"].percentile)
        targets[f"at_{j}_hi"] = (f"at_{j}", LIMITS["pressure_high"].percentile)
    pairs = [(a, b) for a, b in profile.twins if {a, b} <= have]
    for a, b in pairs:
        values[f"gap_{a}_{b}"] = F.abs(number(F.col(a)) - number(F.col(b)))
        targets[f"gap_{a}_{b}"] = (f"gap_{a}_{b}", LIMITS["gap"].percentile)
    rows = df if unordered is None else unordered
    a = rows.agg(*aggs).first() if aggs else None
    if values:
        more.insert(0, (rows, values))
    p = percentiles(more[0][0], [], more[0][1], targets, more=more[1:]).first() if more else None

    for t, fs in feeders.items():
        if fit[f"n_{t}"] >= MIN_POOL:
            out["mb"][t] = {**{c: fit[f"{c}_{t}"] for c in ("alpha", "offset", "r2")},
                            "eps": LIMITS["balance"].of(p[f"p_{t}"]), "feeders": fs}
            out["mb_window"][t] = {
                f"w{k}": {"eps": LIMITS["balance_window"].of(p[f"p_{t}_w{k}"])}
                for k in BALANCE_ROWS if p[f"n_{t}_w{k}"] >= MIN_POOL}
    for t in tanks:
        low, high = profile.bounds(t)
        out["tank"][t] = {"h_min": max(low, a[f"min_{t}"] - MARGIN), "h_max": min(high, a[f"max_{t}"] + MARGIN),
                          "slew_max": LIMITS["level_step"].of(p[f"step_{t}"])}
    for (kind, i), (status, flow) in flows.items():
        name = f"{kind}_{i}"
        frac = a[f"frac_{name}"]
        if flow is None:
            out["pump"][i] = {"mode": "status_only", "on_fraction": frac}
            continue
        some_on, n_off = p[f"n_{name}_on"] > 0, p[f"n_{name}_off"]
        limits = {"f_on_min": p[f"{name}_lo"] - 1.0 if some_on else 0.0,
                  "f_on_max": p[f"{name}_hi"] + 1.0 if some_on else 0.0,
                  "f_off_max": p[f"{name}_off"] + 0.5
                  if n_off > (5 if kind == "pump" else 0) else 0.5}
        if kind == "valve":
            out["valve"][i] = {"status": status, "flow": flow, **limits}
        elif frac < 0.005:
            out["pump"][i] = {"mode": "always_off", "f_off_max": limits["f_off_max"]}
        else:
            out["pump"][i] = {"mode": "always_on" if frac > 0.995 else "varying", **limits}
    for pid in heads:
        if a[f"runs_{pid}"] > 100:
            out["head"][pid] = {"h_min": p[f"head_{pid}_lo"] - 2.0, "h_max": p[f"head_{pid}_hi"] + 2.0}
    for j in joints:
        out["pressure"][j] = {"p_min": p[f"at_{j}_lo"] - 1.0, "p_max": p[f"at_{j}_hi"] + 1.0}
        out["pslew"][j] = {"slew_max": LIMITS["pressure_step"].of(p[f"step_{j}"])}
    for c1, c2 in pairs:
        if p[f"n_gap_{c1}_{c2}"] >= 100:
            out["symmetry"][f"{c1}_{c2}"] = {
                "col1": c1, "col2": c2,
                "threshold": LIMITS["gap"].of(p[f"gap_{c1}_{c2}"])}
    return out
