"""Operators against plain Python on small inputs; blocks and cells are made tiny on purpose."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluicewatch.functions import formulas, guards, naming, rules
from sluicewatch.operators import calibrate, detectors, graph, metrics, signals
from sluicewatch.operators.quantiles import percentiles
from sluicewatch.operators.segments import carry_values, halo_windows, with_positions
from sluicewatch.profiles import NETWORKS, network_of


def series(spark, values, key="a"):
    return spark.createDataFrame([
        (key, i, None if v is None else float(v)) for i, v in enumerate(values)], "k string, rn long, x double")


def ordered(df, col):
    return [r[col] for r in df.orderBy("rn").collect()]


def test_positions_of_a_hot_series(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"s{i % 7}", rng.randrange(10_000), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    got = {(r["k"], r["t"], r["id"]): r["rn"] for r in with_positions(
        df, ["k"], ["t", "id"], F.floor(F.col("t") / 50)).collect()}
    for k in {r[0] for r in rows}:
        for i, row in enumerate(sorted(r for r in rows if r[0] == k)):
            assert got[row] == i


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_windows_do_not_see_block_edges(spark, block):
    x = np.random.default_rng(5).normal(size=60)
    got = halo_windows(series(spark, x.tolist()), ["k"], lambda w: [
        {"d": signals.step0(F.col("x"), w)},
        {"roll": signals.rolling_sum(F.col("d"), w, 4, full_only=False),
         "mx": signals.centered_max(F.col("x"), w, 5)}], before=4, after=2, block_rows=block)
    d = np.concatenate([[0.0], np.diff(x)])
    assert np.allclose(ordered(got, "d"), d)
    assert np.allclose(ordered(got, "roll"), pd.Series(d).rolling(4, min_periods=1).sum())
    assert np.allclose(ordered(got, "mx"), pd.Series(x).rolling(5, min_periods=1, center=True).max())


@pytest.mark.parametrize("block", [3, 1000])
def test_fill_forward_then_backward(spark, block):
    x = [None, None, 1.0, None, None, None, None, None, 2.0, None, None]
    got = carry_values(series(spark, x), ["k"], ["x"], backward=True, block_rows=block)
    assert ordered(got, "x") == [1.0] * 8 + [2.0] * 3


@pytest.mark.parametrize("cells", [4096, 3])
def test_percentiles_equal_numpy(spark, cells):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=400), np.full(300, 7.0), rng.exponential(1e6, size=50), [np.nan]])
    df = spark.createDataFrame([("g" if i % 2 else "h", float(v)) for i, v in enumerate(x)], "k string, x double")
    ps = {"p0": 0.0, "p5": 5.0, "p50": 50.0, "p995": 99.5, "p100": 100.0}
    whole = percentiles(df, [], {"x": F.col("x")}, {n: ("x", p) for n, p in ps.items()}, cells).first()
    clean = x[~np.isnan(x)]
    for n, p in ps.items():
        assert whole[n] == pytest.approx(np.percentile(clean, p), rel=1e-12)
    assert whole["n_x"] == 750
    for r in percentiles(df, ["k"], {"x": F.col("x")}, {n: ("x", p) for n, p in ps.items()}, cells).collect():
        part = clean[1::2] if r["k"] == "g" else clean[0::2]
        assert r["p995"] == pytest.approx(np.percentile(part, 99.5), rel=1e-12)


def test_percentiles_of_several_frames(spark):
    """Metrics of two frames, infinite, missing and equal values, in the same passes; what is shuffled is cells."""
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.normal(size=300), [np.inf, -np.inf, 1e308, -1e308]])
    one = spark.createDataFrame([("g", float(x), None, 4.0) for x in a], "k string, a double, b double, c double")
    two = spark.createDataFrame([("g", float(x)) for x in range(100)] + [("h", 1.0), ("h", None)], "k string, d double")
    for keys in ([], ["k"]):
        out = percentiles(one, keys, {c: F.col(c) for c in "abc"}, {"a9": ("a", 90.0), "a0": ("a", 0.0), "a100": ("a", 100.0), "b5": ("b", 50.0),
                                                                      "c5": ("c", 5.0), "d5": ("d", 50.0)}, 5, [(two, {"d": F.col("d")})])
        g = (out.filter("k = 'g'") if keys else out).first()
        d = np.array([*range(100)] if keys else [*range(100), 1.0])
        assert g.a9 == pytest.approx(np.percentile(a, 90)) and (g.a0, g.a100) == (-np.inf, np.inf) and g.b5 is None and g.c5 == 4.0
        assert g.d5 == pytest.approx(np.percentile(d, 50)) and (g.n_a, g.n_b, g.n_c, g.n_d) == (304, 0, 304, len(d))


def brute_runs(raw, k):
    out, run = [0] * len(raw), 0
    for i, r in enumerate(raw):
        run = run + 1 if r else 0
        if run >= k:
            out[i - k + 1:i + 1] = [1] * k
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_hysteresis_equals_run_scan(spark, k):
    rng = random.Random(k)
    raw = [int(rng.random() < 0.6) for _ in range(80)]
    df = series(spark, raw).withColumn("raw", F.col("x").cast("int"))
    assert ordered(signals.hysteresis(df, ["k"], "raw", k), "confirmed") == brute_runs(raw, k)


def test_hysteresis_vector(spark):
    df = series(spark, [-1, .5, -1, -1, -1, .5]).withColumn("raw", (F.col("x") < 0).cast("int"))
    assert ordered(signals.hysteresis(df, ["k"], "raw", 2), "confirmed") == [0, 0, 1, 1, 1, 0]


def scalar_atom(row, a):
    if a["col"] not in row:
        return False
    v, op, val = row[a["col"]], a["op"], a["val"]
    if op == "in":
        return not (v < val[0]) and not (v > val[1])
    return {"==": v == val, ">=": v >= val, "<=": v <= val, ">": v > val, "<": v < val}[op]


def test_rule_counts_equal_scalar_evaluation(spark):
    rng = random.Random(1234)
    data = [{"a": float("nan") if rng.random() < .15 else rng.gauss(0, 1), "b": rng.gauss(0, 1),
             "c": float(rng.randrange(3)), "state": "s"} for _ in range(60)]

    def atom():
        op = rng.choice(["in", "==", ">=", "<=", ">", "<"])
        lo = rng.gauss(0, 1)
        return {"col": rng.choice(["a", "b", "c", "missing"]), "op": op,
                "val": [lo, lo + rng.random()] if op == "in" else float(rng.randrange(3))}

    rs = [{"id": f"r{i}", "antecedent": [atom() for _ in range(rng.randrange(3))],
           "consequent": [atom() for _ in range(rng.randrange(1, 3))]} for i in range(25)]
    want = [sum(all(scalar_atom(d, x) for x in r["antecedent"])
                and not all(scalar_atom(d, x) for x in r["consequent"]) for r in rs) for d in data]
    df = spark.createDataFrame([(i, d["a"], d["b"], d["c"], "s") for i, d in enumerate(data)],
                               "rn long, a double, b double, c double, state string")
    assert ordered(df.select("rn", rules.violation_count(rs, df.columns).alias("n")), "n") == want

    def as_data(atoms):
        return [(x["col"], x["op"], *(x["val"] if x["op"] == "in" else (x["val"], None))) for x in atoms]

    phi = spark.createDataFrame([("s", [(r["id"], as_data(r["antecedent"]), as_data(r["consequent"])) for r in rs])],
                                f"state string, rules {rules.RULES_TYPE}")
    counted = detectors.rule_counts(df, phi, ["a", "b", "c"])
    assert ordered(counted, "violations") == want and not any(ordered(counted, "absent"))


@pytest.mark.parametrize("counts, absent, budget, k, noted", [
    ([0] * 5 + [2] * 3 + [5] * 2, [False] * 10, 0.20, 3, False),
    ([0, 0, 0, 0], [True, True, False, False], 0.10, 1, True),
    ([1, 1, 1], [False] * 3, 0.5, 2, False)])
def test_threshold(spark, counts, absent, budget, k, noted):
    df = spark.createDataFrame(list(zip(counts, absent)), "violations int, absent boolean")
    r = detectors.violation_threshold(df, budget).first()
    assert (r["k"], r["note"] is not None) == (k, noted)
    with pytest.raises(ValueError):
        detectors.violation_threshold(df, 1.5)


@pytest.mark.parametrize("trace, moves, want", [
    ([0, 0, 1, 0], [(0, 1), (1, 0)], [0, 0, 0, 0]), ([0, 2, 1], [(0, 1), (1, 0)], [0, 1, 1]),
    ([0, 1, 0], [(0, 1)], [0, 0, 1]), ([2, 0], [(0, 1)], [1, 1])])
def test_transition_flags(spark, trace, moves, want):
    df = spark.createDataFrame([("a", i, str(s)) for i, s in enumerate(trace)], "k string, rn long, state string")
    known = spark.createDataFrame([("0",), ("1",)], "state string")
    allowed = spark.createDataFrame([(str(a), str(b)) for a, b in moves], "prev string, state string")
    assert ordered(detectors.transition_flags(df, ["k"], known, allowed), "y_pred_gfsm") == want


def test_composite_state_refuses_missing_values(spark):
    df = spark.createDataFrame([(0.0, 1.9), (1.0, 0.0)], "a double, b double")
    comps = [("PLC1", "P78_State"), ("PLC1", "P79_State")]
    got = [r[0] for r in df.select(naming.composite_state(comps, ["a", "b"])).collect()]
    assert got == ["PLC1.P78_State:0|PLC1.P79_State:1", "PLC1.P78_State:1|PLC1.P79_State:0"]
    bad = spark.createDataFrame([(float("nan"), 1.0)], "a double, b double")
    with pytest.raises(Exception, match="non-finite"):
        bad.select(naming.composite_state(comps, ["a", "b"])).collect()


def test_fusion(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 1), (1, 1, 0)], "a int, b int, p int")
    a, b, p = (F.col(c) for c in "abp")
    got = [tuple(r) for r in df.select(detectors.fuse_or([a, b]), detectors.fuse_intersection([a, b], [p]),
                                       detectors.fuse_intersection([], [p])).collect()]
    assert got == [(0, 0, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 0, 0)]
    with pytest.raises(ValueError):
        detectors.fuse_or([])


@pytest.mark.parametrize("text, unsat, canonical", [
    ("", False, "TRUE"), ("No Check", False, "TRUE"), ("X = high AND X = low", True, "X = high AND X = low"),
    ("P = 1 AND P <> 1", True, "P <> 1 AND P = 1"), ("T > 5 AND T < 5", True, "T < 5 AND T > 5"),
    ("T >= 5 AND T <= 5", False, "T <= 5 AND T >= 5"), ("T = 4 AND T > 4", True, "T = 4 AND T > 4"),
    ("P = 5 AND P = 5.0", True, "P = 5 AND P = 5.0"),
    ("T > 5 AND T < 3 OR A = 1", False, "T < 3 AND T > 5 OR A = 1"),
    ("NOT (A > 5 OR B = 1)", False, "A <= 5 AND B <> 1"), ("A = 1 AND A = 1", False, "A = 1"),
    ("SENSOR < 5", False, "SENSOR < 5"), ("T2 <", False, "T2 < ")])
def test_guards(spark, text, unsat, canonical):
    df = spark.createDataFrame([(text,)], "t string").withColumn("d", guards.guard_to_dnf("t"))
    assert tuple(df.select(guards.unsat(F.col("d")), guards.guard_text(F.col("d"))).first()) == (unsat, canonical)


def test_formulas(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, -1.0, 2.0, -3.0, float("nan"))], "x double")
    got = [r[0] for r in df.select(formulas.fires("x >= -1", ["x"])).collect()]
    assert got == [0, 0, 0, 1, 0]  # the boundary and missing values never fire
    rob = [r[0] for r in df.select(formulas.robustness("(x <= 0.5) or (abs(x) <= 1.5 and x > 0)", ["x"])).collect()]
    assert rob == [0.5, 1.5, -0.5, 3.5, None]
    assert df.select(formulas.robustness("x <=", ["x"])).first()[0] == 0.0
    assert df.select(formulas.robustness("unknown <= 3", ["x"])).first()[0] == 0.0


def test_number_text(spark):
    df = spark.createDataFrame([(v,) for v in (5.0, 2.4000000001, 0.5, 1234567.0, 1e-5, 100.0, 0.0, -3.25)], "x double")
    want = [f"{r[0]:g}" for r in df.collect()]
    assert [r[0] for r in df.select(naming.format_g(F.col("x"))).collect()] == want


def test_calibrate_families(spark):
    rng = np.random.default_rng(0)
    n = 2_000
    level, status, flow = rng.uniform(1, 5, n), (rng.random(n) < .5).astype(float), rng.uniform(0, 10, n)
    df = spark.createDataFrame(pd.DataFrame({"frame": ["f0"] * 1000 + ["f1"] * 1000, "rn": [*range(1000)] * 2,
                                             "l_t1": level, "s_pu1": status, "f_pu1": flow}))
    p = calibrate.calibrate(df, NETWORKS["ctown"])
    on, off = flow[status > .5], flow[status <= .5]
    assert p["pump"][1]["mode"] == "varying"
    assert p["pump"][1]["f_on_min"] == pytest.approx(np.percentile(on, 0.5) - 1)
    assert p["pump"][1]["f_off_max"] == pytest.approx(np.percentile(np.abs(off), 99.5) + .5)
    assert p["tank"]["l_t1"]["slew_max"] == pytest.approx(np.percentile(np.abs(np.diff(level)), 99.5) * 1.2 + .02)
    assert p["tank"]["l_t1"]["h_min"] == pytest.approx(level.min() - .05)
    dh = np.concatenate([np.diff(level[:1000]), np.diff(level[1000:])])
    q = np.concatenate([flow[1:1000], flow[1001:]])
    slope, intercept = np.polyfit(q, dh, 1)
    assert p["mb"]["l_t1"]["alpha"] == pytest.approx(slope)
    assert p["mb"]["l_t1"]["eps"] == pytest.approx(np.percentile(np.abs(dh - slope * q - intercept), 99) * 1.1 + .005)
    pool = []
    for i in (0, 1000):
        r = np.concatenate([[0], np.diff(level[i:i + 1000]) - slope * flow[i + 1:i + 1000] - intercept])
        pool.append(pd.Series(r).rolling(6).sum().dropna())
    assert p["mb_window"]["l_t1"]["w6"]["eps"] == pytest.approx(
        np.percentile(np.abs(np.concatenate(pool)), 99.5) * 1.05 + .01)
    specs = formulas.synthesize(NETWORKS["ctown"], p)
    assert specs["RANGE_l_t1"].startswith("l_t1 >= ") and "CTRL_HI_s_v2_l_t2" in specs
    assert network_of("anytown") is NETWORKS["anytown"]
    with pytest.raises(ValueError):
        network_of("nowhere")


def test_metrics_edges(spark):
    df = spark.createDataFrame([(1, 1, .9), (0, 1, .9), (1, 0, .4), (0, 0, .1)], "y_true int, y_pred int, score double")
    m = metrics.detection_metrics(df, []).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (1, 1, 1, 1)
    assert m["aucpr"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3) and m["aucroc"] == pytest.approx(0.625)
    one = metrics.detection_metrics(df.filter("y_true = 0"), []).first()
    assert one["aucpr"] is None and one["recall"] == 0 and one["mcc"] == 0


def edges_of(spark, pairs):
    return spark.createDataFrame([("g", str(a), str(b)) for a, b in pairs], "fb string, frm string, to string")


def states_of(spark, ids):
    return spark.createDataFrame([("g", str(s), i) for i, s in enumerate(ids)], "fb string, node string, ord long")


def test_graph_vectors(spark):
    states, edges = states_of(spark, [10, 20, 50, 60]), edges_of(spark, [(10, 20), (50, 60), (60, 50)])
    assert sorted(r["node"] for r in graph.unreachable_states(states, edges, ["fb"]).collect()) == ["50", "60"]
    s = graph.statistics(states_of(spark, [10, 20, 30]), edges_of(spark, [(10, 20), (10, 30), (20, 30)]), ["fb"]).first()
    assert (s["avg_transitions_per_state"], s["max_transitions_from_state"], s["dead_states"]) == (1.0, 2, 1)
    ring = graph.initial_state(states_of(spark, [7, 100]), edges_of(spark, [(7, 100), (100, 7)]), ["fb"])
    assert ring.first()["node"] == "100"
    assert graph.dangling(states, edges_of(spark, [(10, 99)]), ["fb"]).first()["side"] == "to_state"
    cut = graph.transitive_reduction(edges_of(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (2, 4), (1, 4)]), ["fb"])
    assert sorted((r["frm"], r["to"]) for r in cut.collect()) == [("1", "2"), ("2", "3"), ("3", "4")]


def test_components_of_random_graphs(spark):
    rng = random.Random(9)
    n = 24
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(40)}
    reach = {a: {a} for a in range(n)}
    for _ in range(n):
        for a in range(n):
            reach[a] |= {y for x, y in pairs if x in reach[a]}
    want = {frozenset(b for b in range(n) if b in reach[a] and a in reach[b]) for a in range(n)}
    got: dict[str, set] = {}
    for r in graph.components(states_of(spark, range(n)), edges_of(spark, pairs), ["fb"]).collect():
        got.setdefault(r["scc"], set()).add(int(r["node"]))
    assert {frozenset(s) for s in got.values()} == want
    loops = {a for a, b in pairs if a == b}
    cyc = {int(r["node"]) for r in graph.cycles(states_of(spark, range(n)), edges_of(spark, pairs), ["fb"]).collect()}
    assert cyc == {x for s in want if len(s) > 1 for x in s} | loops


@pytest.mark.parametrize(("text", "want"), [
    ("x > 16#FF OR y < 2", [[("x", ">", "16#FF")], [("y", "<", "2")]]),
    ("t > T#5s AND x > 1", [[("t", ">", "T#5s"), ("x", ">", "1")]]),
    ("flag AND x > 5", [[("flag", "=", "TRUE"), ("x", ">", "5")]]),
    ("not flag", [[("flag", "=", "FALSE")]]),
    ("x MOD 2 = 1 OR y > 3", [[("x MOD 2", "=", "1")], [("y", ">", "3")]]),
    ("in > 5 or flag", [[("in", ">", "5")], [("flag", "=", "TRUE")]]),
    ("a XOR b", [[("a", "=", "TRUE"), ("b", "=", "FALSE")], [("a", "=", "FALSE"), ("b", "=", "TRUE")]]),
    ("NOT (a = 1 AND b < 2)", [[("a", "<>", "1")], [("b", ">=", "2")]]),
    ("x > (", [[("x > (", "=", "TRUE")]]),
])
def test_guards_keep_every_condition(text, want):
    from sluicewatch.functions.guards import guard_terms

    assert [[tuple(c.values()) for c in t] for t in guard_terms(text)] == want


def test_programs_with_else_label_lists_and_names(spark):
    from sluicewatch.operators import programs

    deep = "IF q > 0 THEN " * 14 + "S := RUN;" + " END_IF;" * 14
    text = ("FUNCTION_BLOCK F VAR_IN_OUT S : INT; END_VAR CASE S OF IDLE, 1: IF x > 1.0 THEN y := 2; ELSIF x < 0 THEN S := 7; "
            "ELSE S := RUN; END_IF; 3..5: IF a THEN S := IDLE; ELSE b := TRUE; END_IF; RUN: " + deep
            + " S := other; ELSE b := FALSE; END_CASE; END_FUNCTION_BLOCK")
    nodes = programs.statements(spark.createDataFrame([("f", text)], "file string, text string"))
    states, moves = programs.automata(nodes)
    assert {r.node for r in states.collect()} == {"IDLE", "1", "3", "4", "5", "RUN", "7"}
    got = {(r.frm, r.to, r.condition) for r in moves.collect()}
    no = "NOT (x > 1.0) AND NOT (x < 0)"
    assert got == {(s, "7", "(x < 0) AND NOT (x > 1.0)") for s in ("IDLE", "1")} | {(s, "RUN", no) for s in ("IDLE", "1")} | {
        (s, "IDLE", "a") for s in "345"} | {("RUN", "RUN", "q > 0")}
    dep = {(r.state, r.stmt): (r.guard, r.control is not None) for r in programs.dependence_nodes(nodes).collect()}
    assert dep["4", "b := TRUE"] == ("(NOT (a))", True)
    assert {r.scope for r in programs.variables(nodes).collect()} == {"in_out"}


def test_programs_nest_in_the_row(spark):
    """The ELSE of an inner CASE stands under no state of either; what strings hold is no code."""
    from sluicewatch.operators import programs

    text = ("PROGRAM P CASE S OF 0: CASE T OF 1: T := 2; ELSE IF y > 1 THEN T := 3; END_IF; q := 5; END_CASE; r := 1; IF a THEN S := 1; END_IF;"
            " ELSE IF b THEN S := 2; ELSE S := 3; END_IF; END_CASE; t := 'x; IF b THEN'; u := \"(* ' *)\"; (* don't *) v := 'it$'s'; END_PROGRAM")
    nodes = programs.statements(spark.createDataFrame([("f", text), ("none", ""), ("null", None), ("junk", "END_IF; END_CASE; ELSE x := 1;")],
                                                      "file string, text string")).cache()
    at = {r.stmt: (r.case_var, r.state) for r in programs.located(nodes).filter("kind = 'assign' AND file = 'f'").collect()}
    assert at == {"T := 2": ("T", "1"), "T := 3": ("T", ""), "q := 5": ("T", ""), "r := 1": ("S", "0"), "S := 1": ("S", "0"),
                  "S := 2": ("S", ""), "S := 3": ("S", ""), "t := 'x; IF b THEN'": (None, ""), "u := \"(* ' *)\"": (None, ""), "v := 'it$'s'": (None, "")}
    moves = programs.automata(nodes)[1].select("case_var", "frm", "to", "condition").collect()
    assert [tuple(r) for r in moves] == [("S", "0", "1", "a")]
    conds = {r.stmt: [u.cond for u in r.up if u.cond] for r in nodes.filter("kind = 'assign'").collect()}
    assert conds["S := 3"] == ["NOT (b)"] and conds["S := 2"] == ["b"] and conds["r := 1"] == []
    assert nodes.filter("file IN ('none', 'null')").count() == 0 and nodes.filter("file = 'junk'").count() == 2


def test_programs_are_read_once(spark):
    """Templates, dependences and declarations come from one reading; many files make one batch of rows."""
    from sluicewatch.operators import programs
    from sluicewatch.plans import program_queries

    found = program_queries.found_templates(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    texts = spark.range(0, 300, 1, 1).select(F.concat(F.lit("f"), "id").alias("file"), F.lit("PROGRAM P\nx := 1;\nEND_PROGRAM").alias("text"))
    sizes = programs.statements(texts).mapInArrow(lambda bs: (b.slice(0, 1) for b in bs), programs.statements(texts).schema)
    assert sizes.count() == 1
