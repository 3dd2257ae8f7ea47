"""The stages end to end on small inputs made here."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sluicewatch.plans import automaton, cli, pipeline
from sluicewatch.sources import dataset, network_files, telemetry

INP = """[TITLE]
small

[TANKS]
;ID  Elev Init Min Max Diam
 T41   71.5  3   0   6.5  31.3
 T42   71.5  2   0.5 4.0  10.0 ; second

[PUMPS]
 P78 J1 T41 HEAD 8
[VALVES]
 V1  J1 T42 200 prv 40.0
[CONTROLS]
LINK P78 OPEN   IF NODE T41 BELOW 5
LINK P78 CLOSED IF NODE T41 ABOVE 8.0
LINK P79 open if node T42 below 5.0
LINK P79 closed if node T42 above 8

[RULES]

[END]
"""
PLCS = """- name: PLC1
  actuators: [P78, P79]
- name: PLC2
  sensors: [T41]
- name: PLC3
  sensors: [T42]
"""
PLC1 = """(* Auto-generated by st_gen from anytown.inp + anytown_plcs.yaml
   Topology: anytown   PLC: PLC1
   DO NOT EDIT. *)

PROGRAM PLC1
VAR_INPUT
    T41 : REAL;            (* sourced from PLC2 *)
    T42 : REAL;            (* sourced from PLC3 *)
END_VAR
VAR_OUTPUT
    P78 : BOOL;
    P79 : BOOL;
END_VAR
VAR
    P78_State : INT := 0;
    P79_State : INT := 0;
END_VAR

(* ----- FSM for actuator P78 ----- *)
CASE P78_State OF
    0:  (* CLOSED *)
        IF T41 < 5 THEN
            P78_State := 1;
        END_IF;
    1:  (* OPEN *)
        IF T41 > 8 THEN
            P78_State := 0;
        END_IF;
END_CASE;
P78 := (P78_State = 1);

(* ----- FSM for actuator P79 ----- *)
CASE P79_State OF
    0:  (* CLOSED *)
        IF T42 < 5 THEN
            P79_State := 1;
        END_IF;
    1:  (* OPEN *)
        IF T42 > 8 THEN
            P79_State := 0;
        END_IF;
END_CASE;
P79 := (P79_State = 1);

END_PROGRAM
"""
PLC2 = """(* Auto-generated by st_gen from anytown.inp + anytown_plcs.yaml
   Topology: anytown   PLC: PLC2
   DO NOT EDIT. *)

PROGRAM PLC2
(* No actuators with [CONTROLS] entries -- sensor-only or static-setting PLC. *)
END_PROGRAM
"""


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = tmp_path_factory.mktemp("topo")
    (d / "anytown.inp").write_text(INP)
    (d / "anytown_plcs.yaml").write_text(PLCS)
    return str(d)


def test_inp_reader(spark, root):
    net = network_files.read_inp(spark, f"{root}/anytown.inp")
    assert [tuple(r)[1:] for r in net["tanks"].orderBy("id").collect()] == [
        ("T41", 0.0, 6.5), ("T42", 0.5, 4.0)]
    assert net["pumps"].first()["node2"] == "T41"
    assert (net["valves"].first()["vtype"], net["valves"].first()["setting"]) == ("PRV", 40.0)
    assert net["controls"].count() == 4


@pytest.mark.parametrize("line, section", [("LINK A OPEN AT TIME 5", "CONTROLS"), ("RULE 1", "RULES"),
                                           ("T1 1 2", "TANKS")])
def test_inp_reader_refuses(spark, tmp_path, line, section):
    (tmp_path / "bad.inp").write_text(f"[{section}]\n{line}\n")
    with pytest.raises(Exception, match="at line 2"):
        for df in network_files.read_inp(spark, str(tmp_path / "bad.inp")).values():
            df.collect()


def test_generated_programs_match_golden_text(spark, root):
    out = f"{root}/data/generated/anytown/st"
    man = pipeline.generate(spark, "anytown", f"{root}/anytown.inp", f"{root}/anytown_plcs.yaml", out)
    text = {r["file"]: r["text"] for r in cli.programs_of(spark, f"{root}/data", "anytown").collect()}
    assert text["PLC1.st"] == PLC1
    assert text["PLC2.st"] == PLC2
    fsms = spark.read.json(f"{out}/{man['fsms']}").orderBy("act_ord").collect()
    assert [(f["actuator"], f["transitions"]) for f in fsms] == [("P78", 2), ("P79", 2)]
    sensors = spark.read.json(f"{out}/{man['sensors']}").orderBy("first").collect()
    assert [(s["plc"], s["sensor"], s["owner_plc"]) for s in sensors] == [
        ("PLC1", "T41", "PLC2"), ("PLC1", "T42", "PLC3")]


def test_automaton_of_two_pumps(spark):
    src = spark.createDataFrame([("a.st", PLC1), ("b.st", PLC2)], "file string, text string")
    a = automaton.compose(*automaton.extract(src))
    assert a.initial == "PLC1.P78_State:0|PLC1.P79_State:0"
    assert (a.states.count(), a.edges.count()) == (4, 12)
    guard = a.edges.filter("frm LIKE '%:0|%:0' AND to LIKE '%:1|%:1'").first()["guard"]
    assert guard == "T41 < 5 AND T42 < 5"
    stats = automaton.analysis(a)
    assert stats["unreachable"].count() == 0 and stats["dead"].count() == 0
    assert stats["cycles"].first()["size"] == 4
    with pytest.raises(ValueError, match="max-states"):
        automaton.compose(*automaton.extract(src), max_states=2)


def write_raw(root):
    """Hourly raw files of the kind the C-Town reader expects, with levels tied to pumps."""
    rng = random.Random(3)
    os.makedirs(f"{root}/raw/BATADAL", exist_ok=True)
    head = "DATETIME , L_T1,F_PU1,S_PU1,S_PU2,P_J280, ATT_FLAG\n"

    def line(day, hour, attack, flag):
        on = rng.random() < 0.5
        level = 99.0 if attack else 2 + rng.random()
        return f"{day:02d}/01/17 {hour:02d},{level:.4f},{50 + rng.random() if on else 0:.4f},{int(on)},{int(rng.random() < .3)},{20 + rng.random():.4f},{flag}\n"

    with open(f"{root}/raw/BATADAL/BATADAL_dataset03_train_1.csv", "w") as f:
        f.write(head + "".join(line(1 + i // 24, i % 24, False, 0) for i in range(600)))
    with open(f"{root}/raw/BATADAL/BATADAL_test_dataset.csv", "w") as f:
        f.write(head + "".join(line(15 + i // 24, i % 24, 33 <= i <= 102, -999) for i in range(120)))


def test_whole_pipeline(spark, root):
    write_raw(root)
    data = f"{root}/ctown_data"
    assert cli.main(["dataio-ingest", "--topology", "ctown", "--raw-root", f"{root}/raw", "--data-root", data]) == 0
    ds = dataset.load_dataset(spark, data, "ctown")
    assert ds.calibration.count() == 600 and ds.evaluation.count() == 120
    assert ds.evaluation.filter("label = 1").agg({"rn": "min"}).first()[0] == 33
    assert ds.column_map["L_T1"] == "l_t1"
    assert ds.roles["tank"] == ["l_t1"] and ds.roles["junction"] == ["p_j280"]
    os.makedirs(f"{data}/ctown/st")
    prog = PLC1.replace("P78", "PU1").replace("P79", "PU2")
    with open(f"{data}/ctown/st/ctown_plc1.st", "w") as f:
        f.write(prog)
    for stage in ("st-analyze", "stl-monitor", "gfsm-build", "invariants-mine", "ics-monitor"):
        assert cli.main([stage, "--topology", "ctown", "--data-root", data]) == 0, stage
    made = f"{data}/generated/ctown"
    with open(f"{made}/monitor/ctown_monitor_manifest.json") as f:
        man = json.load(f)
    assert {a["arm"] for a in man["arms"]} == {"gfsm", "stl", "gfsm_or_stl"}
    fused = spark.read.json(f"{made}/monitor/{man['scenarios']}").first()
    assert fused["tp"] + fused["fn"] == 70
    assert spark.read.json(f"{made}/stl/evaluation").first()["recall"] == 1.0
    assert spark.read.json(f"{made}/gfsm/plcs").first()["status"] == "ok"
    with open(f"{made}/monitor/ctown_ablation.csv") as f:
        assert len(f.read().splitlines()) == 5
    pred = spark.read.csv(f"{made}/monitor/predictions", header=True)
    assert pred.columns == ["scenario", "row", "y_true", "y_pred_stl", "y_pred_gfsm", "y_pred_invariants", "y_pred"]
    assert pred.count() == 120
    # A changed automaton manifest makes the mined rules stale.
    with open(f"{made}/gfsm/ctown_gfsm_manifest.json", "a") as f:
        f.write("\n")
    assert cli.main(["ics-monitor", "--topology", "ctown", "--data-root", data]) == 2


def test_missing_dataset(spark, tmp_path):
    with pytest.raises(telemetry.DataError, match="dataio-ingest"):
        dataset.load_dataset(spark, str(tmp_path), "ctown")


def test_anytown_runs(spark, tmp_path):
    def run(name, rows):
        d = tmp_path / name
        d.mkdir()
        (d / "scada_values.csv").write_text("iteration, timestamp , T41,P78\n" + "".join(
            f"{i},2020-01-01 00:{i % 60:02d},{'' if level is None else level},{p}\n" for i, level, p in rows))
        return d

    clean = run("clean", [(0, 9, 9), (1, None, 0), (2, 2.5, 0), (3, None, 1), (700, 3.0, 1)])
    attack = run("attack", [(1, 1.0, 0), (649, "bad", 1), (793, 4.0, 1), (794, 5.0, 0)])
    (attack / "ground_truth.csv").write_text("iteration\n1\n649\n793\n794\n")
    cal, ev, names = telemetry.anytown(spark, [str(clean / "scada_values.csv")], [
        (str(attack / "scada_values.csv"), str(attack / "ground_truth.csv"), 649, 794, "mitm")])
    assert [(r["rn"], r["t41"]) for r in cal.orderBy("rn").collect()] == [(0, 2.5), (1, 2.5), (2, 2.5)]
    assert [(r["scenario"], r["rn"], r["t41"], r["label"]) for r in ev.orderBy("rn").collect()] == [
        ("mitm", 0, 1.0, 0), ("mitm", 1, 1.0, 1), ("mitm", 2, 4.0, 1), ("mitm", 3, 5.0, 0)]
    assert names["T41"] == "t41"


def test_stored_artifacts(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({
        "initial": "P.S:0", "states": {"P.S:0": ["0"], "P.S:1": ["1"]},
        "transitions": [{"from": "P.S:0", "to": "P.S:1"}, {"from_state": "P.S:1", "to_state": "P.S:0"}]}))
    states, moves = network_files.read_automaton(spark, str(tmp_path / "g.json"))
    assert states.count() == 2
    assert sorted((r["prev"], r["state"]) for r in moves.collect()) == [("P.S:0", "P.S:1"), ("P.S:1", "P.S:0")]
    rule = {"id": "r0", "antecedent": [{"col": "x", "op": ">", "val": 1.5}],
            "consequent": [{"col": "y", "op": "in", "val": [0, 5]}], "support": 1, "confidence": 1, "lift": 1}
    (tmp_path / "p.json").write_text(json.dumps({"violation_threshold": 2, "states": {"P.S:0": {"status": "ok", "rules": [rule]}}}))
    phi, k = network_files.read_rules(spark, str(tmp_path / "p.json"))
    r = phi.first()["rules"][0]
    assert k == 2 and r["antecedent"][0]["lo"] == 1.5 and (r["consequent"][0]["lo"], r["consequent"][0]["hi"]) == (0.0, 5.0)
    rule["consequent"][0]["val"] = [1]
    (tmp_path / "bad.json").write_text(json.dumps({"states": {"s": {"rules": [rule]}}}))
    with pytest.raises(Exception, match="2-element"):
        network_files.read_rules(spark, str(tmp_path / "bad.json"))[0].collect()


def test_dangling_reference_fails_the_unit(spark, tmp_path):
    states = spark.createDataFrame([("f", "P", "S", x, i) for i, x in enumerate("01")], "file string, program string, case_var string, node string, ord int")
    moves = spark.createDataFrame([("f", "P", "S", "0", "1", "x > 1", 1, 1), ("f", "P", "S", "1", "9", "x < 1", 2, 2)],
                                  "file string, program string, case_var string, frm string, to string, condition string, if_node long, ord long")
    a, man = pipeline.build(spark, None, str(tmp_path), "net", local=(states, moves))
    assert a is None and man["all_ok"] is False and man["dangling"] == 1
    told = spark.read.json(str(tmp_path / "analysis" / "dangling")).collect()
    assert [(r.program, r.side, r.node) for r in told] == [("P", "to_state", "9")]
    states = states.withColumn("ord", F.struct(F.lit(0).alias("late"), F.col("ord")))
    a, man = pipeline.build(spark, None, str(tmp_path), "net", local=(states, moves.filter("to = '1'")))
    assert man["all_ok"] and man["dangling"] == 0 and man["states"] == 2 and man["transitions"] == 1
