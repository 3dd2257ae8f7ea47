"""Queries on the telemetry trace: readers, windows, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import calibrate as cal
from ..operators import metrics, signals
from ..operators.segments import carry_values, halo_windows
from ..profiles import BALANCE_ROWS, LIMITS, Limit
from .registry import query
from .trace import KEYS, PROFILE, SQL, frame_segment, rows, state, table, trace

W = f"WITH {SQL}"
CAL = "(SELECT * FROM tr WHERE split = 'cal')"
# Differences inside each calibration frame, and of the frames laid end to end.
STEPS = f"""{W},
st AS (SELECT *, l_t1 - lag(l_t1) OVER w AS dl_t1, p_j1 - lag(p_j1) OVER w AS dp_j1
  FROM tr WHERE split = 'cal' WINDOW w AS (PARTITION BY scenario ORDER BY rn)),
ch AS (SELECT l_t1 - lag(l_t1) OVER w AS dl_t1, p_j1 - lag(p_j1) OVER w AS dp_j1
  FROM tr WHERE split = 'cal' WINDOW w AS (ORDER BY scenario, rn))"""
FIT = f"""{STEPS},
fit AS (SELECT coalesce(regr_slope(dl_t1, f_pu1), 0) AS alpha,
  coalesce(regr_intercept(dl_t1, f_pu1), avg(dl_t1)) AS o, coalesce(regr_r2(dl_t1, f_pu1), 0) AS r2,
  count(dl_t1) AS n FROM st WHERE dl_t1 IS NOT NULL),
rs AS (SELECT st.*, dl_t1 - alpha * f_pu1 - o AS resid,
  CASE WHEN rn = 0 THEN 0 ELSE dl_t1 - alpha * f_pu1 - o END AS resid0 FROM st, fit)"""
ATTACKS = [("A1", "2024-01-03 06:00:00", "2024-01-05 12:00:00"),
           ("A2", "2024-01-17 09:00:00", "2024-01-19 06:00:00"),
           ("A3", "2024-01-24 20:00:00", "2024-01-27 16:00:00")]
HIT = " OR ".join(f"ts BETWEEN TIMESTAMP '{s}' AND TIMESTAMP '{e}'" for _, s, e in ATTACKS)
WINDOWS = ", ".join(f"('{i}', TIMESTAMP '{s}', TIMESTAMP '{e}')" for i, s, e in ATTACKS)


def r6(c: str | F.Column, name: str) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def cal_rows(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return trace(spark, d, "cal", *cols)


@query("scan_trace", f"""{W} SELECT scenario, split, rn, l_t1, f_pu1, s_pu1, s_pu2, label FROM tr""")
def scan_trace(spark, d):
    return trace(spark, d, None, "l_t1", "f_pu1", "s_pu1", "s_pu2", "label").drop("ts", "event_id")


@query("cast_numeric", """
SELECT event_id, epoch(date_trunc('hour', ts))::BIGINT AS hour_s,
  CAST(regexp_extract(props, ': *(.*)}', 1) AS DOUBLE) AS k, NULL::DOUBLE AS bad FROM events""")
def cast_numeric(spark, d):
    raw = table(spark, d, "events").select(
        "event_id", F.concat(F.lit(" "), F.date_format("ts", "dd/MM/yy HH"), F.lit(" ")).alias("dt"),
        F.regexp_extract("props", ": *(.*)}", 1).alias("k"), F.col("event_type").alias("bad"))
    return raw.select(
        "event_id", F.unix_timestamp(F.to_timestamp(F.trim("dt"), "dd/MM/yy HH")).alias("hour_s"),
        F.col("k").try_cast("double").alias("k"), F.col("bad").try_cast("double").alias("bad"))


@query("union_frames", """
SELECT source, count(*) AS n, round(sum(v), 4) AS total, count(extra) AS n_extra FROM (
  SELECT 'orders' AS source, o_totalprice AS v, o_orderpriority AS extra FROM orders
  UNION ALL SELECT 'customer', c_acctbal, NULL FROM customer
  UNION ALL SELECT 'supplier', s_acctbal, NULL FROM supplier) GROUP BY source""")
def union_frames(spark, d):
    o = table(spark, d, "orders").select(F.lit("orders").alias("source"),
                                         F.col("o_totalprice").alias("v"),
                                         F.col("o_orderpriority").alias("extra"))
    c = table(spark, d, "customer").select(F.lit("customer").alias("source"),
                                           F.col("c_acctbal").alias("v"))
    s = table(spark, d, "supplier").select(F.col("s_acctbal").alias("v"),
                                           F.lit("supplier").alias("source"))
    u = o.unionByName(c, allowMissingColumns=True).unionByName(s, allowMissingColumns=True)
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"),
                                   F.count("extra").alias("n_extra"))


@query("attack_window_label", f"""{W}
SELECT scenario, count(*) AS n, sum(CAST({HIT} AS INT))::BIGINT AS n_attack FROM ev GROUP BY scenario""")
def attack_window_label(spark, d):
    e = rows(spark, d).select("scenario", metrics.in_windows(F.col("ts"), ATTACKS).alias("y"))
    return e.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_attack"))


@query("pre_trigger_filter", f"""{W}
SELECT scenario, count(*) AS n, round(sum(l_t1), 4) AS total FROM tr WHERE split = 'cal' AND rn > 0 AND rn < 30
GROUP BY scenario""")
def pre_trigger_filter(spark, d):
    t = cal_rows(spark, d, "l_t1").filter((F.col("rn") > 0) & (F.col("rn") < 30))
    return t.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_t1"), 4).alias("total"))


@query("join_ground_truth", """
SELECT o_orderpriority AS priority, CAST(o_orderstatus = 'F' AS INT) AS attacked,
  CAST(o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AS INT) AS in_trigger,
  count(*) AS n, round(sum(l_quantity), 4) AS qty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""")
def join_ground_truth(spark, d):
    scada = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("iteration"), "l_quantity")
    t = F.col("o_orderdate")
    gt = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("iteration"), F.col("o_orderpriority").alias("priority"),
        (F.col("o_orderstatus") == "F").cast("int").alias("attacked"),
        ((t >= F.lit("1996-01-01").cast("timestamp"))
         & (t < F.lit("1997-01-01").cast("timestamp"))).cast("int").alias("in_trigger"))
    return scada.join(gt, "iteration").groupBy("priority", "attacked", "in_trigger").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"))


@query("ffill_bfill", f"""{W}, g AS (SELECT *, CASE WHEN f_pu1 % 4 = 0 THEN f_pu1 END AS v FROM tr)
SELECT scenario, split, rn, coalesce(
  last_value(v IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v
FROM g WINDOW w AS (PARTITION BY scenario, split ORDER BY rn)""")
def ffill_bfill(spark, d):
    g = trace(spark, d, None, "f_pu1").select(
        *KEYS, "rn", F.when(F.col("f_pu1") % 4 == 0, F.col("f_pu1")).alias("v"))
    return carry_values(g, KEYS, ["v"], backward=True)


@query("on_off_fraction", f"""{W}
SELECT scenario, round(avg(CASE WHEN s_pu1 > 0.5 THEN 1.0 ELSE 0 END), 6) AS on_fraction,
  sum(CASE WHEN s_pu1 <= 0.5 THEN 1 ELSE 0 END)::BIGINT AS n_off FROM ev WHERE split = 'cal' GROUP BY scenario""")
def on_off_fraction(spark, d):
    return rows(spark, d, "cal").groupBy("scenario").agg(
        r6(F.avg(cal.on("s_pu1").cast("double")), "on_fraction"),
        F.sum(cal.off("s_pu1").cast("long")).alias("n_off"))


@query("signal_diff", f"""{W}
SELECT scenario, split, rn, round(coalesce(l_t1 - lag(l_t1) OVER (PARTITION BY scenario, split ORDER BY rn), 0), 6) AS dl_t1
FROM tr""")
def signal_diff(spark, d):
    t = trace(spark, d, None, "l_t1")
    return halo_windows(t, KEYS, lambda w: [{"dl_t1": signals.step0(F.col("l_t1"), w)}], before=1).select(
        *KEYS, "rn", r6("dl_t1", "dl_t1"))


@query("mb_residual", f"""{W}
SELECT scenario, split, rn, round(coalesce(l_t1 - lag(l_t1) OVER (PARTITION BY scenario, split ORDER BY rn), 0)
  - 0.25 * (f_pu1 + p_j1) - 1.5, 6) AS resid FROM tr""")
def mb_residual(spark, d):
    p = {"mb": {"l_t1": {"alpha": 0.25, "offset": 1.5, "feeders": ["f_pu1", "p_j1"]}}, "mb_window": {}}
    t = trace(spark, d, None, "l_t1", "f_pu1", "p_j1")
    return signals.build_signals(t, KEYS, PROFILE, p).select(
        *KEYS, "rn", r6("MB_RESID_l_t1", "resid"))


@query("head_diff", f"""{W} SELECT event_id, round(l_t1 - p_j1, 6) AS head FROM ev""")
def head_diff(spark, d):
    return rows(spark, d).select("event_id", r6(F.col("l_t1") - F.col("p_j1"), "head"))


@query("rolling_sum", f"""{W}
SELECT scenario, split, rn,
  round(CASE WHEN count(*) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 6
    THEN sum(l_t1) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END, 6) AS full6,
  round(sum(l_t1) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS part6
FROM tr WINDOW w AS (PARTITION BY scenario, split ORDER BY rn)""")
def rolling_sum(spark, d):
    t = trace(spark, d, None, "l_t1")
    return halo_windows(t, KEYS, lambda w: [{
        "full6": signals.rolling_sum(F.col("l_t1"), w, 6, full_only=True),
        "part6": signals.rolling_sum(F.col("l_t1"), w, 6, full_only=False)}], before=5).select(
        *KEYS, "rn", r6("full6", "full6"), r6("part6", "part6"))


@query("score_smoothing", f"""{W}
SELECT scenario, split, rn, max(s_pu1 + s_pu2 + label) OVER (PARTITION BY scenario, split ORDER BY rn
  ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)::DOUBLE AS score FROM tr""")
def score_smoothing(spark, d):
    t = trace(spark, d, None, "s_pu1", "s_pu2", "label")
    fires = F.col("s_pu1") + F.col("s_pu2") + F.col("label")
    return halo_windows(t, KEYS, lambda w: [{
        "score": signals.centered_max(fires, w, 5).cast("double")}], before=2, after=2).select(
        *KEYS, "rn", "score")


FLAGSHIP = """, q AS (SELECT quantile_cont(abs(dl_t1), 0.9) AS slew FROM st WHERE dl_t1 IS NOT NULL),
raw AS (SELECT scenario, rn, CAST(abs(coalesce(l_t1 - lag(l_t1) OVER w, 0)) > slew AS INT) AS raw
  FROM tr, q WHERE split = 'eval' WINDOW w AS (PARTITION BY scenario ORDER BY rn)),
f AS (SELECT *, CASE WHEN rn >= 1 THEN least(raw, lag(raw) OVER w) ELSE 0 END AS ful FROM raw
  WINDOW w AS (PARTITION BY scenario ORDER BY rn)),
c AS (SELECT *, greatest(ful, coalesce(lead(ful) OVER w, 0)) AS confirmed FROM f
  WINDOW w AS (PARTITION BY scenario ORDER BY rn))"""


@query("hysteresis", f"""{STEPS}{FLAGSHIP}
SELECT scenario, count(*) AS n, sum(raw)::BIGINT AS n_raw, sum(confirmed)::BIGINT AS n_confirmed FROM c GROUP BY scenario""")
def hysteresis(spark, d):
    """Flag level steps above the clean 90th percentile, confirm runs of two, count per scenario."""
    steps = cal.with_steps(cal_rows(spark, d, "l_t1"), ["scenario"], ["l_t1"])
    limit = cal.slew_limit(steps, "l_t1", Limit(90.0))
    ev = trace(spark, d, "eval", "l_t1").crossJoin(F.broadcast(limit))  # one row

    def stages(w):
        jump = F.abs(signals.step0(F.col("l_t1"), w))
        return [{"raw": (jump > F.col("slew_max")).cast("int")},
                *signals.run_stages(F.col("raw"), 2, w)]

    c = halo_windows(ev, ["scenario"], stages, before=2, after=1)
    return c.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("n_raw"),
                                     F.sum("confirmed").alias("n_confirmed"))


@query("per_attack_breakdown", f"""{STEPS}, win(attack, s, e) AS (VALUES {WINDOWS}),
i AS (SELECT t.scenario, t.split, attack, t.label AS hit, row_number() OVER (PARTITION BY t.scenario, t.split, attack ORDER BY t.rn) - 1 AS idx
  FROM tr t JOIN win ON t.ts BETWEEN s AND e)
SELECT scenario, split, attack, count(*) AS duration_h, sum(hit)::BIGINT AS detected_steps,
  round(sum(hit) / count(*), 6) AS detection_rate, min(CASE WHEN hit = 1 THEN idx END) AS time_to_detect_h,
  round(coalesce(1.0 - min(CASE WHEN hit = 1 THEN idx END) / count(*), 0), 6) AS ttd_score
FROM i GROUP BY scenario, split, attack""")
def per_attack_breakdown(spark, d):
    t = trace(spark, d, None, "label")
    g = metrics.per_attack(t, KEYS, ATTACKS, pred="label")
    return g.select(*KEYS, "attack", "duration_h", "detected_steps", r6("detection_rate", "detection_rate"),
                    "time_to_detect_h", r6("ttd_score", "ttd_score"))


@query("calib_tank_bounds", f"""{W} SELECT round(greatest(0.0, min(l_t1) - 0.05), 6) AS h_min,
  round(least(600.0, max(l_t1) + 0.05), 6) AS h_max FROM ev WHERE split = 'cal'""")
def calib_tank_bounds(spark, d):
    b = cal.tank_bounds(rows(spark, d, "cal"), "l_t1", *PROFILE.bounds("l_t1"))
    return b.select(r6("h_min", "h_min"), r6("h_max", "h_max"))


@query("calib_tank_slew", f"""{STEPS} SELECT round(quantile_cont(abs(dl_t1), 0.995) * 1.2 + 0.02, 6) AS slew_max FROM ch""")
def calib_tank_slew(spark, d):
    steps = cal.chained_steps(cal_rows(spark, d, "l_t1"), "scenario", ["l_t1"], frame_segment())
    return cal.slew_limit(steps, "l_t1", LIMITS["level_step"]).select(
        r6("slew_max", "slew_max"))


@query("calib_pump_mode", f"""{W}, c AS (SELECT * FROM ev WHERE split = 'cal')
SELECT CASE WHEN avg(s_pu1) < 0.005 THEN 'always_off' WHEN avg(s_pu1) > 0.995 THEN 'always_on' ELSE 'varying' END AS mode,
  round(quantile_cont(f_pu1, 0.005) FILTER (WHERE s_pu1 > 0.5) - 1, 6) AS f_on_min,
  round(quantile_cont(f_pu1, 0.995) FILTER (WHERE s_pu1 > 0.5) + 1, 6) AS f_on_max,
  round(quantile_cont(abs(f_pu1), 0.995) FILTER (WHERE s_pu1 <= 0.5) + 0.5, 6) AS f_off_max FROM c""")
def calib_pump_mode(spark, d):
    p = cal.pump_mode(rows(spark, d, "cal"), "s_pu1", "f_pu1", LIMITS["flow"].percentile)
    return p.select("mode", *[r6(c, c) for c in ("f_on_min", "f_on_max", "f_off_max")])


@query("calib_valve", f"""{W}, c AS (SELECT * FROM ev WHERE split = 'cal')
SELECT round(quantile_cont(l_t1, 0.005) FILTER (WHERE s_pu2 > 0.5) - 1, 6) AS f_on_min,
  round(quantile_cont(l_t1, 0.995) FILTER (WHERE s_pu2 > 0.5) + 1, 6) AS f_on_max,
  round(quantile_cont(abs(l_t1), 0.995) FILTER (WHERE s_pu2 <= 0.5) + 0.5, 6) AS f_off_max FROM c""")
def calib_valve(spark, d):
    v = cal.valve_envelope(rows(spark, d, "cal"), "s_pu2", "l_t1", LIMITS["flow"].percentile)
    return v.select(*[r6(c, c) for c in ("f_on_min", "f_on_max", "f_off_max")])


@query("calib_head", f"""{W} SELECT round(quantile_cont(l_t1 - p_j1, 0.005) - 2, 6) AS h_min,
  round(quantile_cont(l_t1 - p_j1, 0.995) + 2, 6) AS h_max FROM ev WHERE split = 'cal' AND s_pu1 > 0.5 HAVING count(*) > 100""")
def calib_head(spark, d):
    return cal.head_envelope(rows(spark, d, "cal"), "s_pu1", "l_t1", "p_j1").select(
        r6("h_min", "h_min"), r6("h_max", "h_max"))


@query("calib_pressure", f"""{STEPS} SELECT
  round((SELECT quantile_cont(p_j1, 0.0005) - 1 FROM st), 6) AS p_min,
  round((SELECT quantile_cont(p_j1, 0.9995) + 1 FROM st), 6) AS p_max,
  round((SELECT quantile_cont(abs(dp_j1), 0.995) * 1.2 + 0.5 FROM ch), 6) AS slew_max""")
def calib_pressure(spark, d):
    limits = cal.pressure_limits(rows(spark, d, "cal"), "p_j1", LIMITS["pressure_low"].percentile,
                                 LIMITS["pressure_high"].percentile)
    steps = cal.chained_steps(cal_rows(spark, d, "p_j1"), "scenario", ["p_j1"], frame_segment())
    slew = cal.slew_limit(steps, "p_j1", LIMITS["pressure_step"])
    return limits.crossJoin(F.broadcast(slew)).select(  # one row each
        *[r6(c, c) for c in ("p_min", "p_max", "slew_max")])


@query("calib_symmetry", f"""{W} SELECT round(quantile_cont(abs(l_t1 - f_pu1), 0.995) * 1.2 + 0.05, 6) AS threshold
FROM ev WHERE split = 'cal' HAVING count(*) >= 100""")
def calib_symmetry(spark, d):
    return cal.symmetry_limit(rows(spark, d, "cal"), "l_t1", "f_pu1").select(r6("threshold", "threshold"))


@query("mass_balance_ols", f"""{STEPS} SELECT scenario, round(coalesce(regr_slope(dl_t1, f_pu1), 0), 6) AS alpha,
  round(coalesce(regr_intercept(dl_t1, f_pu1), avg(dl_t1)), 6) AS o,
  round(CASE WHEN var_pop(f_pu1) = 0 THEN 0 ELSE coalesce(regr_r2(dl_t1, f_pu1), 0) END, 6) AS r2, count(dl_t1) AS n
FROM st WHERE dl_t1 IS NOT NULL GROUP BY scenario HAVING count(*) > 1""")
def mass_balance_ols(spark, d):
    steps = cal.with_steps(cal_rows(spark, d, "l_t1", "f_pu1"), ["scenario"], ["l_t1"])
    fit = cal.mass_balance_fit(steps, "l_t1", ["f_pu1"], ["scenario"]).filter(F.col("n") > 1)
    return fit.select("scenario", r6("alpha", "alpha"), r6("offset", "o"), r6("r2", "r2"), "n")


@query("mb_eps", f"""{FIT} SELECT round(any_value(alpha), 6) AS alpha, round(any_value(o), 6) AS o,
  round(quantile_cont(abs(resid), 0.99) * 1.1 + 0.005, 6) AS eps FROM rs, fit""".replace("FROM rs, fit", "FROM (SELECT resid, fit.alpha, fit.o FROM rs, fit)"))
def mb_eps(spark, d):
    df = cal_rows(spark, d, "l_t1", "f_pu1")
    steps = cal.with_steps(df, ["scenario"], ["l_t1"])
    fit = cal.mass_balance_fits(steps, {"l_t1": ["f_pu1"]})
    resid = cal.residual("l_t1", ["f_pu1"])
    p = cal.percentiles(steps.crossJoin(F.broadcast(fit)), [], {"r": F.abs(resid)},  # one row
                        {"p": ("r", LIMITS["balance"].percentile)})
    return fit.crossJoin(F.broadcast(p)).select(  # one row each
        r6("alpha_l_t1", "alpha"), r6("offset_l_t1", "o"),
        r6(LIMITS["balance"].of(F.col("p")), "eps"))


ROLLED = ", ".join(
    f"round((SELECT quantile_cont(abs(x), 0.995) * 1.05 + 0.01 FROM (SELECT CASE WHEN count(resid0) OVER f = {k} "
    f"THEN sum(resid0) OVER f END AS x FROM rs WINDOW f AS (PARTITION BY scenario ORDER BY rn "
    f"ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)) HAVING count(x) >= 100), 6) AS eps_w{k}"
    for k in BALANCE_ROWS)


@query("mb_window_eps", f"""{FIT} SELECT {ROLLED}""")
def mb_window_eps(spark, d):
    b = cal.mass_balance_limits(cal_rows(spark, d, "l_t1", "f_pu1"), ["scenario"], {"l_t1": ["f_pu1"]}, PROFILE)
    return b.select(*[r6(f"eps_l_t1_w{k}", f"eps_w{k}") for k in BALANCE_ROWS])


@query("mb_pooled", f"""{FIT} SELECT round(alpha, 6) AS alpha, round(o, 6) AS o, round(r2, 6) AS r2, n,
  (SELECT round(quantile_cont(abs(resid), 0.99) * 1.1 + 0.005, 6) FROM rs) AS eps, {ROLLED} FROM fit WHERE n >= 100""")
def mb_pooled(spark, d):
    b = cal.mass_balance_limits(cal_rows(spark, d, "l_t1", "f_pu1"), ["scenario"], {"l_t1": ["f_pu1"]}, PROFILE)
    return b.select(r6("alpha_l_t1", "alpha"), r6("offset_l_t1", "o"), r6("r2_l_t1", "r2"),
                    F.col("n_l_t1").alias("n"), r6("eps_l_t1", "eps"),
                    *[r6(f"eps_l_t1_w{k}", f"eps_w{k}") for k in BALANCE_ROWS])
