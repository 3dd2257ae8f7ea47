"""The detectors end to end on the trace: fit on the first half, monitor the second."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.formulas import synthesize
from ..operators.calibrate import calibrate
from ..operators.signals import stl_flags
from ..profiles import BALANCE_ROWS
from ..session import cut_lineage
from . import hybrid
from .registry import query
from .state_queries import CONF, FEATURES, MINED_FROM, RANK, RATE_COLS, RATES, VIOLATIONS
from .trace import KEYS, PROFILE, frame_segment, rows, state, trace
from .trace_queries import FIT, r6

COLUMNS = ["l_t1", "f_pu1", "p_j1", "s_pu1", "s_pu2", "label"]

_rolled = ", ".join(
    f"(SELECT round(quantile_cont(abs(x), 0.995) * 1.05 + 0.01, 6) FROM (SELECT CASE WHEN count(resid0) OVER f = {k} "
    f"THEN sum(resid0) OVER f END AS x FROM rs WINDOW f AS (PARTITION BY scenario ORDER BY rn "
    f"ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)) HAVING count(x) >= 100) AS w{k}" for k in BALANCE_ROWS)
_rolls = ", ".join(
    f"sum(mb) OVER (PARTITION BY scenario ORDER BY rn ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS m{k}"
    for k in BALANCE_ROWS)
_mbw = " + ".join(f"CAST(coalesce(abs(m{k}) > w{k}, false) AS INT)" for k in BALANCE_ROWS)
STL = f"""{FIT},
par AS (SELECT alpha, o, (SELECT round(quantile_cont(abs(resid), 0.99) * 1.1 + 0.005, 6) FROM rs) AS eps, {_rolled},
  (SELECT round(quantile_cont(abs(dl_t1), 0.995) * 1.2 + 0.02, 4) FROM ch) AS slew,
  (SELECT round(quantile_cont(abs(dp_j1), 0.995) * 1.2 + 0.5, 4) FROM ch) AS pslew FROM fit),
lim AS (SELECT round(greatest(0.0, min(l_t1) - 0.05), 4) AS hmin, round(least(600.0, max(l_t1) + 0.05), 4) AS hmax,
  round(quantile_cont(f_pu1, 0.005) FILTER (WHERE s_pu1 = 1) - 1, 4) AS p_lo,
  round(quantile_cont(f_pu1, 0.995) FILTER (WHERE s_pu1 = 1) + 1, 4) AS p_hi,
  round(quantile_cont(abs(f_pu1), 0.995) FILTER (WHERE s_pu1 = 0) + 0.5, 4) AS p_off,
  round(quantile_cont(l_t1, 0.005) FILTER (WHERE s_pu2 = 1) - 1, 4) AS v_lo,
  round(quantile_cont(l_t1, 0.995) FILTER (WHERE s_pu2 = 1) + 1, 4) AS v_hi,
  round(quantile_cont(abs(l_t1), 0.995) FILTER (WHERE s_pu2 = 0) + 0.5, 4) AS v_off,
  round(quantile_cont(l_t1 - p_j1, 0.005) FILTER (WHERE s_pu1 = 1) - 2, 4) AS hd_lo,
  round(quantile_cont(l_t1 - p_j1, 0.995) FILTER (WHERE s_pu1 = 1) + 2, 4) AS hd_hi,
  round(quantile_cont(p_j1, 0.0005) - 1, 4) AS j_lo, round(quantile_cont(p_j1, 0.9995) + 1, 4) AS j_hi,
  round(quantile_cont(abs(l_t1 - f_pu1), 0.995) * 1.2 + 0.05, 4) AS sym FROM st),
g0 AS (SELECT *, coalesce(l_t1 - lag(l_t1) OVER w, 0) AS dl, coalesce(p_j1 - lag(p_j1) OVER w, 0) AS dj
  FROM tr WHERE split = 'eval' WINDOW w AS (PARTITION BY scenario ORDER BY rn)),
g1 AS (SELECT g0.*, dl - alpha * f_pu1 - o AS mb FROM g0, par),
g2 AS (SELECT g1.*, {_rolls} FROM g1),
g3 AS (SELECT g2.*, CAST(abs(mb) > eps AS INT) + {_mbw} + CAST(l_t1 < 0 OR l_t1 > 600 AS INT)
  + CAST(l_t1 < hmin OR l_t1 > hmax AS INT) + CAST(abs(dl) > slew AS INT)
  + CAST(s_pu1 > 0.5 AND (f_pu1 < p_lo OR f_pu1 > p_hi) AS INT) + CAST(s_pu1 < 0.5 AND abs(f_pu1) > p_off AS INT)
  + CAST(s_pu2 > 0.5 AND (l_t1 < v_lo OR l_t1 > v_hi) AS INT) + CAST(s_pu2 < 0.5 AND abs(l_t1) > v_off AS INT)
  + CAST(l_t1 > 150.05 AND s_pu1 > 0.5 AS INT) + CAST(l_t1 < 4.95 AND s_pu1 < 0.5 AS INT)
  + CAST(abs(l_t1 - f_pu1) > sym AS INT) + CAST(s_pu1 > 0.5 AND (l_t1 - p_j1 < hd_lo OR l_t1 - p_j1 > hd_hi) AS INT)
  + CAST(p_j1 < j_lo OR p_j1 > j_hi AS INT) + CAST(abs(dj) > pslew AS INT) AS fires FROM g2, par, lim),
g4 AS (SELECT *, CAST(fires >= 1 AS INT) AS raw,
  max(fires) OVER (PARTITION BY scenario ORDER BY rn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)::DOUBLE AS score FROM g3),
g5 AS (SELECT *, CASE WHEN rn >= 1 THEN least(raw, lag(raw) OVER (PARTITION BY scenario ORDER BY rn)) ELSE 0 END AS ful FROM g4),
stl AS (SELECT *, greatest(ful, coalesce(lead(ful) OVER (PARTITION BY scenario ORDER BY rn), 0)) AS y_stl FROM g5)"""
BAND = "'|P.C:' || CAST(floor(f_pu1 / 5) AS BIGINT)"
HYBRID = f"""{STL},
trb AS (SELECT * REPLACE (state || {BAND} AS state) FROM tr),
mv AS (SELECT *, lag(state) OVER (PARTITION BY scenario, split ORDER BY rn) AS prev FROM trb),
al AS (SELECT DISTINCT prev, state FROM mv WHERE split = 'cal' AND prev <> state),
{MINED_FROM.format(src='trb')},
{VIOLATIONS.format(src='trb')},
kk AS (SELECT coalesce((SELECT min(k) FROM (SELECT unnest(range(1, (SELECT max(c) + 2 FROM vi WHERE split = 'cal'))) AS k)
  WHERE (SELECT avg(CAST(c >= k AS INT)) FROM vi WHERE split = 'cal') <= 0.01), 1) AS k),
pred AS (SELECT stl.scenario, stl.rn, stl.label AS y, stl.score, y_stl,
  CASE WHEN nn.state IS NULL THEN 1 WHEN mv.rn > 0 AND mv.prev <> mv.state AND al.state IS NULL THEN 1 ELSE 0 END AS y_gfsm,
  CAST(vi.gone OR vi.c >= (SELECT k FROM kk) AS INT) AS y_inv
  FROM stl JOIN mv USING (event_id) JOIN vi USING (event_id) LEFT JOIN nn ON nn.state = mv.state
  LEFT JOIN al ON al.prev = mv.prev AND al.state = mv.state)"""


def with_band(df):
    return df.withColumn("state", F.concat_ws("|", state(), F.concat(
        F.lit("P.C:"), F.floor(F.col("f_pu1") / 5).cast("string"))))


def fitted(spark, d) -> hybrid.Fitted:
    return hybrid.fit(with_band(trace(spark, d, "cal", *COLUMNS)), PROFILE, FEATURES, "scenario",
                      KEYS, frame_segment(), with_band(rows(spark, d, "cal")))


def predictions(spark, d, fusion="intersection"):
    ev = with_band(trace(spark, d, "eval", *COLUMNS))
    return hybrid.predict(ev, KEYS, fitted(spark, d), fusion)


@query("stl_detector", f"{STL} SELECT scenario, rn, fires, y_stl AS y_pred_stl, score FROM stl")
def stl_detector(spark, d):
    clean = cut_lineage(trace(spark, d, "cal", *COLUMNS))  # read by several passes
    params = calibrate(clean, PROFILE, "scenario", frame_segment(), rows(spark, d, "cal"))
    f = stl_flags(trace(spark, d, "eval", *COLUMNS), KEYS, PROFILE, params, synthesize(PROFILE, params))
    return f.select("scenario", "rn", "fires", "y_pred_stl", "score")


@query("hybrid_monitor", f"""{HYBRID}, x AS (SELECT scenario, y, score AS s, CAST((y_gfsm = 1 OR y_inv = 1) AND y_stl = 1 AS INT) AS p FROM pred),
{CONF.format(k='scenario,', g='GROUP BY scenario')}, {RANK.format(k='scenario,', a='a.scenario,', j='a.scenario = b.scenario AND', g='GROUP BY scenario')}
SELECT scenario, {RATES}, aucpr, aucroc FROM cf JOIN rk USING (scenario)""")
def hybrid_monitor(spark, d):
    m = hybrid.score(predictions(spark, d), ["scenario"])
    return m.select("scenario", "tp", "fp", "tn", "fn", *[r6(c, c) for c in (*RATE_COLS, "aucpr", "aucroc")])


@query("ablation_arms", f"""{HYBRID}, x AS (
  SELECT 'gfsm' AS arm, y, CAST(y_gfsm = 1 OR y_inv = 1 AS INT) AS p FROM pred
  UNION ALL SELECT 'stl', y, y_stl FROM pred
  UNION ALL SELECT 'gfsm_or_stl', y, CAST(y_gfsm = 1 OR y_inv = 1 OR y_stl = 1 AS INT) FROM pred),
{CONF.format(k='arm,', g='GROUP BY arm')},
{RANK.format(k='arm,', a='a.arm,', j='a.arm = b.arm AND', g='GROUP BY arm').replace('FROM x GROUP', 'FROM (SELECT *, p AS s FROM x) GROUP')}
SELECT arm, (tp + fp + tn + fn) AS n, tp + fn AS attack_rows, {RATES}, aucpr AS auprc FROM cf JOIN rk USING (arm)""")
def ablation_arms(spark, d):
    a = hybrid.ablation(predictions(spark, d, "or"))
    return a.select("arm", "n", "attack_rows", "tp", "fp", "tn", "fn", *[r6(c, c) for c in RATE_COLS],
                    r6("aucpr", "auprc"))
