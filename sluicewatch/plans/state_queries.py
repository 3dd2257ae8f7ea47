"""Queries on composite states, rules, formulas, fusion and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas
from ..functions.naming import state_components
from ..functions.rules import violation_count
from ..operators import detectors, metrics, mining, signals

from .registry import query
from .trace import KEYS, PROFILE, SQL, rows, state, table, trace
from .trace_queries import r6

W = f"WITH {SQL}"
FEATURES = ["l_t1", "f_pu1", "p_j1"]
RULES = [
    {"id": "r0", "antecedent": [{"col": "f_pu1", "op": "in", "val": [0.0, 50.0]}],
     "consequent": [{"col": "l_t1", "op": "<=", "val": 60.0}]},
    {"id": "r1", "antecedent": [{"col": "s_pu1", "op": "==", "val": 1}],
     "consequent": [{"col": "l_t1", "op": "in", "val": [5.0, 200.0]},
                    {"col": "f_pu1", "op": ">", "val": 3.0}]},
    {"id": "r2", "antecedent": [], "consequent": [{"col": "p_j1", "op": ">=", "val": 4.0}]},
    {"id": "r3", "antecedent": [{"col": "missing", "op": "<", "val": 1.0}],
     "consequent": [{"col": "l_t1", "op": "<", "val": 0.0}]},
]
COUNT = ("(CAST(f_pu1 BETWEEN 0 AND 50 AND NOT l_t1 <= 60 AS INT) + CAST(s_pu1 = 1 AND NOT "
         "(l_t1 BETWEEN 5 AND 200 AND f_pu1 > 3) AS INT) + CAST(NOT p_j1 >= 4 AS INT))")


@query("composite_state", f"{W} SELECT event_id, state FROM tr")
def composite_state(spark, d):
    return rows(spark, d).select("event_id", state().alias("state"))


@query("parse_state_key", f"""{W} SELECT event_id, 'P' AS plc, 'B' AS case_var, CAST(s_pu2 AS VARCHAR) AS sid, 2 AS n FROM ev""")
def parse_state_key(spark, d):
    c = state_components(F.col("state"))
    return rows(spark, d).select("event_id", state().alias("state")).select(
        "event_id", c[1]["plc"].alias("plc"), c[1]["case"].alias("case_var"),
        c[1]["sid"].alias("sid"), F.size(c).alias("n"))


@query("state_support", f"""{W} SELECT state, count(*) AS observations,
CASE WHEN count(*) < 50 THEN 'insufficient_data' ELSE 'ok' END AS status FROM
(SELECT scenario || '#' || state AS state FROM tr WHERE split = 'cal') GROUP BY state""")
def state_support(spark, d):
    s = rows(spark, d, "cal").select(F.concat_ws("#", "scenario", state()).alias("state"))
    return mining.state_support(s)


@query("unknown_state_anti", f"""{W}, k AS (SELECT DISTINCT scenario, state, f_pu1 FROM tr WHERE split = 'cal')
SELECT scenario, count(*) AS n FROM tr t WHERE split = 'eval' AND NOT EXISTS (SELECT 1 FROM k
  WHERE k.scenario = t.scenario AND k.state = t.state AND k.f_pu1 = t.f_pu1) GROUP BY scenario""")
def unknown_state_anti(spark, d):
    key = ["scenario", "state", "f_pu1"]
    known = rows(spark, d, "cal").select("scenario", state().alias("state"), "f_pu1").distinct()
    seen = rows(spark, d, "eval").select("scenario", state().alias("state"), "f_pu1")
    return seen.join(known, key, "left_anti").groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))


def banded(spark, d, split):
    """Finer states (20 flow bands), so that evaluation shows states and moves not seen before."""
    t = trace(spark, d, split, "s_pu1", "s_pu2", "f_pu1")
    return t.withColumn("state", F.concat_ws("|", state(), F.concat(
        F.lit("P.C:"), F.floor(F.col("f_pu1") / 5).cast("string"))))


BANDED = f"""{W}, b AS (SELECT scenario, split, rn, state || '|P.C:' || CAST(floor(f_pu1 / 5) AS BIGINT) AS state FROM tr),
m AS (SELECT *, lag(state) OVER (PARTITION BY scenario, split ORDER BY rn) AS prev FROM b),
ks AS (SELECT DISTINCT state FROM b WHERE split = 'cal'),
al AS (SELECT DISTINCT prev, state FROM m WHERE split = 'cal' AND prev <> state)"""


@query("transition_conformance", f"""{BANDED}
SELECT scenario, count(*) AS n, sum(CASE WHEN state NOT IN (SELECT state FROM ks) THEN 1
  WHEN rn > 0 AND prev <> state AND NOT EXISTS (SELECT 1 FROM al WHERE al.prev = m.prev AND al.state = m.state) THEN 1
  ELSE 0 END)::BIGINT AS flagged FROM m WHERE split = 'eval' GROUP BY scenario""")
def transition_conformance(spark, d):
    c = banded(spark, d, "cal")
    f = detectors.transition_flags(banded(spark, d, "eval"), KEYS, c.select("state"),
                                   detectors.observed_transitions(c, KEYS))
    return f.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.sum("y_pred_gfsm").alias("flagged"))


@query("rule_violation_count", f"{W} SELECT event_id, {COUNT} AS violations FROM ev")
def rule_violation_count(spark, d):
    e = rows(spark, d)
    return e.select("event_id", violation_count(RULES, e.columns).alias("violations"))


@query("violation_threshold", f"""{W}, v AS (SELECT {COUNT} AS c, label = 1 AND f_pu1 > 97 AS gone FROM ev WHERE split = 'cal'),
ks AS (SELECT unnest(range(1, (SELECT max(c) + 2 FROM v))) AS k),
r AS (SELECT k, (SELECT avg(CAST(gone OR c >= k AS INT)) FROM v) AS rate FROM ks)
SELECT CAST(coalesce((SELECT min(k) FROM r WHERE rate <= 0.08), (SELECT max(k) FROM r)) AS INT) AS k,
  (SELECT count(*) = 0 FROM r WHERE rate <= 0.08) AS unmet""")
def violation_threshold(spark, d):
    e = rows(spark, d, "cal")
    c = e.select(violation_count(RULES, e.columns).alias("violations"),
                 ((F.col("label") == 1) & (F.col("f_pu1") > 97)).alias("absent"))
    return detectors.violation_threshold(c, 0.08).select("k", F.col("note").isNotNull().alias("unmet"))


# Quartile bins and pair rules per composite state of the calibration rows.
MINED_FROM = """c AS (SELECT state, l_t1, f_pu1, p_j1 FROM {src} WHERE split = 'cal'),
lg AS (SELECT row_number() OVER () AS rid, * FROM c),
lo AS (UNPIVOT lg ON l_t1, f_pu1, p_j1 INTO NAME f VALUE v),
q AS (SELECT state, f, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS z FROM lo GROUP BY state, f),
bn AS (SELECT rid, state, f, v, CAST(v > a AS INT) + CAST(v > b AS INT) + CAST(v > z AS INT) AS bin FROM lo JOIN q USING (state, f)),
sg AS (SELECT state, f, bin, count(*) AS n, min(v) AS lo, max(v) AS hi FROM bn GROUP BY state, f, bin),
nn AS (SELECT state, count(*) AS n FROM c GROUP BY state),
pr AS (SELECT x.state, x.f AS f1, x.bin AS b1, y.f AS f2, y.bin AS b2, count(*) AS both_n
  FROM bn x JOIN bn y ON x.rid = y.rid AND x.f <> y.f GROUP BY 1, 2, 3, 4, 5),
ru AS (SELECT pr.*, s1.lo AS lo1, s1.hi AS hi1, s2.lo AS lo2, s2.hi AS hi2, both_n / nn.n AS support,
  both_n / s1.n AS confidence, (both_n / s1.n) * nn.n / s2.n AS lift
  FROM pr JOIN sg s1 ON pr.state = s1.state AND f1 = s1.f AND b1 = s1.bin
  JOIN sg s2 ON pr.state = s2.state AND f2 = s2.f AND b2 = s2.bin JOIN nn ON nn.state = pr.state
  WHERE nn.n >= 50 AND both_n / nn.n >= 0.1 AND both_n / s1.n >= 0.7)"""
MINED = f"{W}, {MINED_FROM.format(src='tr')}"


@query("rule_mining_pairs", f"""{MINED} SELECT state, f1, b1, f2, b2, both_n, round(support, 6) AS support,
round(confidence, 6) AS confidence, round(lift, 6) AS lift, lo1, hi1, lo2, hi2 FROM ru""")
def rule_mining_pairs(spark, d):
    c = rows(spark, d, "cal").withColumn("state", state())
    m = mining.mine_pairs(c, FEATURES)
    return m.select("state", "f1", "b1", "f2", "b2", F.col("both").alias("both_n"), r6("support", "support"),
                    r6("confidence", "confidence"), r6("lift", "lift"), "lo1", "hi1", "lo2", "hi2")


# Rules of up to three antecedents and two consequents over all rows: every set of bins of a row, and its splits.
SETS = f"""{W}, c AS (SELECT row_number() OVER () AS rid, state, l_t1, f_pu1, p_j1, hour(ts)::DOUBLE AS hr FROM tr),
lo AS (UNPIVOT c ON l_t1, f_pu1, p_j1, hr INTO NAME f VALUE v),
q AS (SELECT state, f, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS z FROM lo GROUP BY state, f),
bn AS (SELECT rid, state, f || '_' || (CAST(v > a AS INT) + CAST(v > b AS INT) + CAST(v > z AS INT)) AS item FROM lo JOIN q USING (state, f)),
it AS (SELECT rid, state, list(item ORDER BY item) AS items FROM bn GROUP BY rid, state),
sb AS (SELECT state, list_transform(list_filter(range(1, len(items) + 1), lambda i: (m >> (i - 1)) & 1 = 1), lambda i: items[i]) AS s
  FROM it, range(1, 16) r(m) WHERE m < (1 << len(items))),
fs AS (SELECT state, s, count(*) AS n FROM sb GROUP BY state, s),
nn AS (SELECT state, count(*) AS n FROM c GROUP BY state HAVING count(*) >= 50),
ru AS (SELECT w.state, a.s AS ante, k.s AS cons, w.n AS n_both, w.n / nn.n AS support, w.n / a.n AS confidence, (w.n / a.n) * nn.n / k.n AS lift
  FROM fs w JOIN nn USING (state) JOIN fs a ON a.state = w.state AND len(a.s) < len(w.s) AND list_has_all(w.s, a.s)
  JOIN fs k ON k.state = w.state AND len(k.s) = len(w.s) - len(a.s) AND list_has_all(w.s, k.s) AND NOT list_has_any(k.s, a.s)
  WHERE len(a.s) <= 3 AND len(k.s) <= 2 AND w.n / nn.n >= 0.01 AND w.n / a.n >= 0.7)"""


@query("rule_mining_sets", f"""{SETS} SELECT state, array_to_string(ante, ' ') AS antecedent, array_to_string(cons, ' ') AS consequent, len(ante)::INT AS n_antecedents,
n_both, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM ru""")
def rule_mining_sets(spark, d):
    c = rows(spark, d).withColumns({"state": state(), "hr": F.hour("ts").cast("double")})
    m = mining.mine_rules(c, [*FEATURES, "hr"], 3, 2, min_support=0.01)

    def text(side):
        return F.array_join(F.transform(side, lambda x: F.concat_ws("_", x["f"], x["b"].cast("string"))), " ").alias(side)

    return m.select("state", text("antecedent"), text("consequent"), F.size("antecedent").alias("n_antecedents"), "n_both",
                    r6("support", "support"), r6("confidence", "confidence"), r6("lift", "lift"))


VIOLATIONS = """vi AS (SELECT e.event_id, e.split, n.state IS NULL AS gone,
  (SELECT count(*) FROM ru WHERE ru.state = e.state
    AND (CASE f1 WHEN 'l_t1' THEN e.l_t1 WHEN 'f_pu1' THEN e.f_pu1 ELSE e.p_j1 END) BETWEEN lo1 AND hi1
    AND NOT (CASE f2 WHEN 'l_t1' THEN e.l_t1 WHEN 'f_pu1' THEN e.f_pu1 ELSE e.p_j1 END) BETWEEN lo2 AND hi2) AS c
  FROM {src} e LEFT JOIN nn n ON n.state = e.state)"""
PHI = f"{MINED}, {VIOLATIONS.format(src='tr')}"


@query("phi_detector", f"{PHI} SELECT event_id, CAST(gone OR c >= 1 AS INT) AS flag FROM vi WHERE split = 'eval'")
def phi_detector(spark, d):
    c = rows(spark, d, "cal").withColumn("state", state())
    phi = mining.rule_sets(mining.mine_rules(c, FEATURES, 1), mining.state_support(c))
    e = rows(spark, d, "eval").select("event_id", *FEATURES, state().alias("state"))
    return detectors.phi_flags(e, phi, FEATURES, 1, out="flag").select("event_id", "flag")


def run_signals(spark, d):
    """Run-time signals of all rows for fixed parameters."""
    params = {"mb": {"l_t1": {"alpha": 0.1, "offset": -2.0, "feeders": ["f_pu1"]}},
              "mb_window": {"l_t1": {"w3": {}}}}
    t = trace(spark, d, None, "l_t1", "f_pu1", "p_j1", "s_pu1", "s_pu2")
    return signals.build_signals(t, KEYS, PROFILE, params)


SIG = f"""{W}, e0 AS (SELECT *, coalesce(l_t1 - lag(l_t1) OVER w, 0) AS dl_t1 FROM tr
  WINDOW w AS (PARTITION BY scenario, split ORDER BY rn)),
e1 AS (SELECT *, dl_t1 - 0.1 * f_pu1 + 2.0 AS mb FROM e0),
e2 AS (SELECT *, sum(mb) OVER (PARTITION BY scenario, split ORDER BY rn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mbr FROM e1)"""
SPECS = {
    "MB_l_t1": "abs(MB_RESID_l_t1) <= 150.500000",
    "MBW_l_t1_w3": "abs(MB_ROLL_l_t1_w3) <= 180.250000",
    "RANGE_l_t1": "l_t1 >= 0.5000 and l_t1 <= 250.0000",
    "SLEW_l_t1": "abs(dl_t1) <= 160.0000",
    "PUMP_ON_1": "(s_pu1 <= 0.5) or (f_pu1 >= 2.0000 and f_pu1 <= 97.0000)",
    "PUMP_OFF_1": "(s_pu1 > 0.5) or (abs(f_pu1) <= 98.0000)",
    "CTRL_HI_s_pu1_l_t1": "(l_t1 <= 150.0500) or (s_pu1 <= 0.5)",
    "CTRL_LO_s_pu1_l_t1": "(l_t1 >= 4.9500) or (s_pu1 > 0.5)",
    "SYMM_l_t1_f_pu1": "abs(l_t1 - f_pu1) <= 200.0000",
}
ROB = {
    "MB_l_t1": "150.5 - abs(mb)", "MBW_l_t1_w3": "180.25 - abs(mbr)",
    "RANGE_l_t1": "least(l_t1 - 0.5, 250.0 - l_t1)", "SLEW_l_t1": "160.0 - abs(dl_t1)",
    "PUMP_ON_1": "greatest(0.5 - s_pu1, least(f_pu1 - 2.0, 97.0 - f_pu1))",
    "PUMP_OFF_1": "greatest(s_pu1 - 0.5, 98.0 - abs(f_pu1))",
    "CTRL_HI_s_pu1_l_t1": "greatest(150.05 - l_t1, 0.5 - s_pu1)",
    "CTRL_LO_s_pu1_l_t1": "greatest(l_t1 - 4.95, s_pu1 - 0.5)",
    "SYMM_l_t1_f_pu1": "200.0 - abs(l_t1 - f_pu1)",
}


def robustness_query(name: str, *specs: str) -> None:
    cols = ", ".join(f"round({ROB[s]}, 6) AS {s}" for s in specs)

    @query(name, f"{SIG} SELECT event_id, {cols} FROM e2")
    def run(spark, d):
        e = run_signals(spark, d)
        return e.select("event_id", *[r6(formulas.robustness(SPECS[s], e.columns), s) for s in specs])


robustness_query("stl_robustness", *SPECS)
robustness_query("stl_range", "RANGE_l_t1")
robustness_query("stl_slew", "SLEW_l_t1")
robustness_query("stl_ctrl", "CTRL_HI_s_pu1_l_t1", "CTRL_LO_s_pu1_l_t1")
robustness_query("stl_pump_mode", "PUMP_ON_1", "PUMP_OFF_1")


@query("fire_count", f"{SIG} SELECT event_id, " + " + ".join(
    f"CAST({r} < 0 AS INT)" for r in ROB.values()) + " AS fires FROM e2")
def fire_count(spark, d):
    e = run_signals(spark, d)
    return e.select("event_id", formulas.fire_count(SPECS, e.columns).alias("fires"))


@query("min_robustness", f"{SIG}, r AS (SELECT event_id, least(" + ", ".join(ROB.values()) + ") AS rob, e2.* EXCLUDE (event_id) FROM e2) "
       "SELECT event_id, round(rob, 6) AS rob, CASE " + " ".join(
           f"WHEN {ROB[n]} = rob THEN '{n}'" for n in sorted(ROB)) + " END AS name FROM r")
def min_robustness(spark, d):
    e = run_signals(spark, d)
    m = e.select("event_id", formulas.min_robustness(SPECS, e.columns).alias("m"))
    return m.select("event_id", r6("m.rob", "rob"), F.col("m.name").alias("name"))


@query("formula_vars", f"""SELECT p_partkey, list_sort(list_distinct(list_filter(regexp_extract_all(
  'abs(' || p_name || ') <= ' || p_size || ' and not(' || p_brand || ' > 3) or always_' || p_type,
  '[A-Za-z_][A-Za-z0-9_]*'), lambda x: x NOT IN ('and','or','not','abs','always','eventually','until','implies')))) AS vars FROM part""")
def formula_vars(spark, d):
    from ..functions.naming import formula_vars as names

    text = F.concat(F.lit("abs("), "p_name", F.lit(") <= "), F.col("p_size").cast("string"),
                    F.lit(" and not("), "p_brand", F.lit(" > 3) or always_"), "p_type")
    return table(spark, d, "part").select("p_partkey", names(text).alias("vars"))


@query("fuse_or", f"{W} SELECT event_id, CAST(s_pu1 = 1 OR s_pu2 = 1 OR label = 1 AS INT) AS y_pred FROM ev")
def fuse_or(spark, d):
    flags = [F.col(c) for c in ("s_pu1", "s_pu2", "label")]
    return rows(spark, d).select("event_id", detectors.fuse_or(flags).alias("y_pred"))


@query("fuse_intersection", f"{W} SELECT event_id, CAST((s_pu1 = 1 OR s_pu2 = 1) AND label = 1 AS INT) AS y_pred FROM ev")
def fuse_intersection(spark, d):
    return rows(spark, d).select("event_id", detectors.fuse_intersection(
        [F.col("s_pu1"), F.col("s_pu2")], [F.col("label")]).alias("y_pred"))


def labelled(spark, d):
    """Quality labels scored by document length, with a length cut as the decision."""
    doc = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y_true"))
    return lab.join(doc, "doc_id").select("lang", "y_true", F.col("n_chars").alias("score"),
                                          (F.col("n_chars") > 500).cast("int").alias("y_pred"))


LABELLED = """WITH x AS (SELECT lang, quality AS y, n_chars AS s, CAST(n_chars > 500 AS INT) AS p FROM labels JOIN documents USING (doc_id))"""
CONF = """cf AS (SELECT {k} sum(CAST(y = 1 AND p = 1 AS INT))::BIGINT AS tp, sum(CAST(y = 0 AND p = 1 AS INT))::BIGINT AS fp,
  sum(CAST(y = 0 AND p = 0 AS INT))::BIGINT AS tn, sum(CAST(y = 1 AND p = 0 AS INT))::BIGINT AS fn FROM x {g})"""
RATES = """tp, fp, tn, fn,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
  round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE
    (tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) END, 6) AS mcc,
  round((CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END + CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END)
    / (CAST(tp + fn > 0 AS INT) + CAST(tn + fp > 0 AS INT)), 6) AS balanced_accuracy"""
# Ranking metrics by comparing every distinct score with every other one.
RANK = """sc AS (SELECT {k} s, sum(CAST(y = 1 AS INT)) AS pos, sum(CAST(y = 0 AS INT)) AS neg FROM x GROUP BY {k} s),
cu AS (SELECT {a} a.pos, a.neg, sum(b.pos) AS tp, sum(b.neg) AS fp FROM sc a JOIN sc b ON {j} b.s >= a.s GROUP BY {a} a.s, a.pos, a.neg),
rk AS (SELECT {k} CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(pos * tp / (tp + fp)) / sum(pos), 6) END AS aucpr,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) END AS aucroc FROM cu {g})"""
RATE_COLS = ("precision", "recall", "f1", "mcc", "balanced_accuracy")


@query("detection_metrics", f"{LABELLED}, {CONF.format(k='lang,', g='GROUP BY lang')} SELECT lang, {RATES} FROM cf")
def detection_metrics(spark, d):
    m = metrics.rates(metrics.confusion(labelled(spark, d), ["lang"]))
    return m.select("lang", "tp", "fp", "tn", "fn", *[r6(c, c) for c in RATE_COLS])


BY_LANG = RANK.format(k="lang,", a="a.lang,", j="a.lang = b.lang AND", g="GROUP BY lang")


@query("average_precision", f"{LABELLED}, {BY_LANG} SELECT lang, aucpr FROM rk")
def average_precision(spark, d):
    return metrics.ranking(labelled(spark, d), ["lang"]).select("lang", r6("aucpr", "aucpr"))


@query("roc_auc", f"{LABELLED}, {RANK.format(k='', a='', j='', g='')} SELECT aucroc FROM rk")
def roc_auc(spark, d):
    return metrics.ranking(labelled(spark, d), []).select(r6("aucroc", "aucroc"))
