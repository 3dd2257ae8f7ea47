"""The stages as jobs: ingest, generate, analyze, build, mine, monitor, ablate."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import synthesize
from ..functions.naming import composite_state
from ..operators import mining, network, programs
from ..operators.calibrate import calibrate
from ..operators.metrics import detection_metrics
from ..operators.signals import stl_flags
from ..profiles import network_of
from ..session import cut_lineage
from ..sinks import writers
from ..sources import dataset, network_files, telemetry
from . import automaton, hybrid

KEYS = ["scenario"]


def rows_as_dicts(df: DataFrame) -> list[dict[str, Any]]:
    """Frames with one row per ablation arm or topology, for a manifest."""
    return [r.asDict(recursive=True) for r in df.collect()]


def save(df: DataFrame, out: str, name: str) -> str:
    df.write.mode("overwrite").json(os.path.join(out, name))
    return name


def ingest(spark: SparkSession, topology: str, raw_root: str, data_root: str) -> str:
    if topology == "ctown":
        base = os.path.join(raw_root, "BATADAL")
        names = ("BATADAL_dataset03_train_1.csv", "BATADAL_test_dataset.csv")
        cal, ev, cols = telemetry.ctown(spark, *[os.path.join(base, n) for n in names])
        windows, source = telemetry.CTOWN_ATTACKS, {"name": " + ".join(names), "format": "csv"}
    elif topology == "anytown":
        base = os.path.join(raw_root, "Anytown", "_inspect", "anytown_dataset")
        clean = [os.path.join(p, f) for p, _, fs in os.walk(os.path.join(base, "network_anomalies"))
                 for f in fs if f == "scada_values.csv"]
        runs = []
        for sub, start, end, name in telemetry.ANYTOWN_RUNS:
            out = os.path.join(base, "disruptive_anomalies_and_attacks", sub, "output")
            if os.path.exists(os.path.join(out, "scada_values.csv")):
                runs.append((os.path.join(out, "scada_values.csv"),
                             os.path.join(out, "ground_truth.csv"), start, end, name))
        cal, ev, cols = telemetry.anytown(spark, clean, runs)
        windows, source = [], {"name": "anytown_dataset.zip", "format": "csv"}
    else:
        raise telemetry.DataError(f"unknown topology: {topology}")
    return dataset.write_dataset(spark, data_root, topology, cal, ev, cols, windows, source)


def generate(spark: SparkSession, topology: str, inp: str, plcs_file: str, out: str) -> dict[str, Any]:
    """Network file and PLC map to one control program per PLC, plus a manifest."""
    net = network_files.read_inp(spark, inp)
    plcs, acts, sensors = network_files.read_plcs(spark, plcs_file)
    c = cut_lineage(net["controls"].drop("file"))
    clash = network.ambiguous(c).first()
    if clash is not None:
        raise telemetry.DataError(
            f"actuator {clash['link']!r} has ambiguous (comparator,threshold) pairs")
    owners = network.sensor_owner(sensors)
    lines = network.program_lines(plcs.select("plc"), acts, owners, c, topology,
                                  os.path.basename(inp), os.path.basename(plcs_file))
    writers.write_programs(lines, os.path.join(out, "programs"))
    fsms = network.manifest_rows(plcs, acts, owners, c)
    use = network.sensors_used(network.control_use(acts, c)).join(owners, "sensor", "left")
    man = writers.stage_manifest("st_gen/v1", topology, inp=os.path.basename(inp),
                                 plcs_yaml=os.path.basename(plcs_file),
                                 fsms=save(fsms, out, "fsms"), sensors=save(use.select(
                                     "plc", "sensor", "first", F.coalesce("owner", F.lit("")).alias("owner_plc")),
                                     out, "sensors"))
    writers.write_json(os.path.join(out, f"{topology}_manifest.json"), man)
    return man


def analyze(spark: SparkSession, sources: DataFrame, out: str, topology: str) -> dict[str, Any]:
    """Program sources to statements, dependences and invariant templates."""
    nodes = cut_lineage(programs.statements(sources))
    dep, var = cut_lineage(programs.dependence_nodes(nodes)), programs.variables(nodes)
    acts = dep.filter("kind = 'assign' AND writes IS NOT NULL AND writes <> case_var")
    found = cut_lineage(programs.templates(dep, var, programs.influences(dep, acts)))
    edges = programs.control_edges(dep).withColumn("edge", F.lit("control")).unionByName(
        programs.data_edges(dep).withColumn("edge", F.lit("data")), allowMissingColumns=True)
    for name, df in (("ast", nodes), ("pdg_nodes", dep), ("pdg_edges", edges), ("variables", var),
                     ("templates", found)):
        save(df, out, name)
    writers.write_dot(
        dep.select(F.concat_ws(":", "file", "node").alias("node")),
        edges.select(F.concat_ws(":", "file", "frm").alias("frm"), F.concat_ws(":", "file", "to").alias("to"),
                     F.coalesce("var", "edge").alias("guard")), os.path.join(out, "pdg_dot"), topology)
    counts = found.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    status = sources.select("file").join(
        nodes.filter("kind = 'program'").select("file").distinct().withColumn("ok", F.lit(True)), "file", "left")
    bad = status.filter("ok IS NULL").select("file")
    man = writers.stage_manifest("st_analyze/v1", topology, templates={
        r["type"]: r["n"] for r in counts.collect()}, unreadable=bad.count(), all_ok=bad.isEmpty())
    writers.write_json(os.path.join(out, f"{topology}_analysis_manifest.json"), man)
    return man


def build(spark: SparkSession, sources: DataFrame | None, out: str, topology: str, max_states: int | None = None,
          listed: DataFrame | None = None, local: tuple[DataFrame, DataFrame] | None = None) -> tuple[automaton.Automaton | None, dict[str, Any]]:
    """Program sources to the global automaton, its drawing and its analysis.

    ``listed`` (plc, n_listed) are the FSMs each program should have; a program that lacks
    them makes the run not ok, one without any is skipped. ``local`` brings local states and moves in place of
    programs. Moves whose ends name no state are listed in ``analysis/dangling``, and then nothing is composed.
    """
    states, moves = automaton.extract(sources) if local is None else local
    dangling = cut_lineage(automaton.dangling(states, moves))
    dangling.write.mode("overwrite").json(os.path.join(out, "analysis", "dangling"))
    if not dangling.isEmpty():
        man = writers.stage_manifest("gfsm/v1", topology, initial=None, components=[], states=0, transitions=0,
                                     dangling=dangling.count(), all_ok=False)
        writers.write_json(os.path.join(out, f"{topology}_gfsm_manifest.json"), man)
        return None, man
    a = automaton.compose(states, moves, max_states)
    writers.write_automaton(a.states, a.edges, os.path.join(out, "gfsm"), f"{topology} (composed)")
    found = automaton.analysis(a)
    for name, df in found.items():
        df.write.mode("overwrite").json(os.path.join(out, "analysis", name))
    blocks = a.local_states.select("program", "case_var").distinct().groupBy(
        F.col("program").alias("plc")).agg(F.count(F.lit(1)).alias("n_blocks"))
    if listed is None:
        listed = blocks.withColumnRenamed("n_blocks", "n_listed")
    status = automaton.plc_status(listed, blocks)
    save(status, out, "plcs")
    stats = found["statistics"].first()
    man = writers.stage_manifest(
        "gfsm/v1", topology, initial=a.initial, components=[list(c) for c in a.components],
        states=stats["total_states"], transitions=stats["total_transitions"], dangling=0,
        all_ok=status.filter("status = 'error'").isEmpty())
    writers.write_json(os.path.join(out, f"{topology}_gfsm_manifest.json"), man)
    return a, man


def state_columns(components: list[tuple[str, str]], column_map: dict[str, str],
                  have: list[str]) -> list[str]:
    """Dataset column of each component; all must exist."""
    up = {k.upper(): v for k, v in column_map.items()}
    cols = []
    for _, case in components:
        act = case.removesuffix("_State")
        cols.append(up.get(act.upper()) or up.get("S_" + act.upper()) or act.lower())
    missing = [c for c in cols if c not in have]
    if missing:
        raise telemetry.DataError(f"missing state column(s) {missing}")
    return cols


def mine(spark: SparkSession, ds: telemetry.Dataset, components: list[tuple[str, str]], out: str,
         gfsm_manifest: str, dataset_manifest: str, fp_budget: float = hybrid.FP_BUDGET) -> dict[str, Any]:
    cols = state_columns(components, ds.column_map, ds.calibration.columns)
    clean = cut_lineage(ds.calibration.withColumn("state", composite_state(components, cols)))
    features = [c for c in ds.calibration.columns if c not in ("frame", "rn", *cols)]
    phi, k, note = hybrid.mine(clean, features, fp_budget)
    phi.write.mode("overwrite").json(os.path.join(out, "phi"))
    man = writers.stage_manifest(
        "invariants/v1", ds.topology, violation_threshold=k, violation_threshold_note=note,
        violation_fp_budget=fp_budget, gfsm_manifest_sha256=writers.sha256_text(gfsm_manifest),
        dataset_manifest_sha256=writers.sha256_text(dataset_manifest), features=features,
        min_observations=mining.MIN_OBSERVATIONS, support_min=mining.MIN_SUPPORT,
        confidence_min=mining.MIN_CONFIDENCE, all_ok=True)
    writers.write_json(os.path.join(out, f"{ds.topology}_invariants_manifest.json"), man)
    return man


def check_fresh(manifest: dict[str, Any], gfsm_manifest: str, dataset_manifest: str) -> None:
    """Rules mined against other manifests than the current ones are refused."""
    for field, text in (("gfsm_manifest_sha256", gfsm_manifest),
                        ("dataset_manifest_sha256", dataset_manifest)):
        if manifest.get(field) is not None and manifest[field] != writers.sha256_text(text):
            raise telemetry.DataError(f"stale rules ({field} mismatch); re-run invariants-mine")


def monitor_stl(spark: SparkSession, ds: telemetry.Dataset, out: str) -> dict[str, Any]:
    """Limits and formulas from clean frames, flags and metrics on the evaluation frames."""
    profile = network_of(ds.topology)
    params = calibrate(cut_lineage(ds.calibration), profile)
    specs = synthesize(profile, params)
    os.makedirs(out, exist_ok=True)
    with open(os.path.join(out, "stl_formulas.txt"), "w", encoding="utf-8") as fh:
        fh.write(writers.formula_report(specs))
    writers.write_json(os.path.join(out, "calibration.json"), params)
    p = cut_lineage(stl_flags(ds.evaluation, KEYS, profile, params, specs)
                    .withColumn("y_pred", F.col("y_pred_stl")).withColumn("anomaly_score", F.col("score")))
    writers.write_predictions(p, os.path.join(out, "predictions"), "y_pred", "anomaly_score")
    man = writers.stage_manifest("stl/v1", ds.topology, n_formulas=len(specs), all_ok=True,
                                 scenarios=save(detection_metrics(p, KEYS, "label"), out, "evaluation"))
    writers.write_json(os.path.join(out, f"{ds.topology}_stl_manifest.json"), man)
    return man


def monitor(spark: SparkSession, ds: telemetry.Dataset, components: list[tuple[str, str]],
            known: DataFrame, allowed: DataFrame, out: str, phi: DataFrame | None = None, k: int = 1,
            fusion: str = "intersection") -> dict[str, Any]:
    """Three detectors, fused and scored; rules are mined here unless given."""
    profile = network_of(ds.topology)
    cols = state_columns(components, ds.column_map, ds.evaluation.columns)
    state = composite_state(components, cols)
    features = [c for c in ds.evaluation.columns if c not in ("scenario", "rn", "label", *cols)]
    clean = cut_lineage(ds.calibration.withColumn("state", state))
    params = calibrate(clean, profile)
    note = None
    if phi is None:
        phi, k, note = hybrid.mine(clean, features)
    m = hybrid.Fitted(profile, params, synthesize(profile, params), known, allowed, phi, k, note, features)
    p = cut_lineage(hybrid.predict(ds.evaluation.withColumn("state", state), KEYS, m, fusion))
    writers.write_predictions(p, os.path.join(out, "predictions"), "y_pred_stl", "y_pred_gfsm",
                              "y_pred_invariants", "y_pred")
    arms = rows_as_dicts(hybrid.ablation(p))
    writers.write_ablation(p, arms, out, ds.topology)
    man = writers.stage_manifest(
        "monitor/v1", ds.topology, detectors=["stl", "gfsm", "invariants"], fusion=fusion, all_ok=True,
        scenarios=save(hybrid.score(p, KEYS), out, "evaluation"), arms=arms)
    writers.write_json(os.path.join(out, f"{ds.topology}_monitor_manifest.json"), man)
    return man


def read_built(spark: SparkSession, out: str, topology: str) -> tuple[list[tuple[str, str]], DataFrame, DataFrame, str]:
    """(components, known states, allowed moves, manifest text) of a built automaton."""
    path = os.path.join(out, f"{topology}_gfsm_manifest.json")
    if not os.path.exists(path):
        raise telemetry.DataError(f"gfsm manifest not found: {path}")
    with open(path, encoding="utf-8") as fh:
        text = fh.read()
    known = spark.read.json(os.path.join(out, "gfsm", "states")).select("node")
    allowed = spark.read.json(os.path.join(out, "gfsm", "transitions")).select("frm", "to")
    return [tuple(c) for c in json.loads(text)["components"]], known, allowed, text


def read_mined(spark: SparkSession, out: str, topology: str) -> tuple[DataFrame, dict[str, Any]]:
    path = os.path.join(out, f"{topology}_invariants_manifest.json")
    if not os.path.exists(path):
        raise telemetry.DataError(f"invariants manifest not found: {path}")
    with open(path, encoding="utf-8") as fh:
        man = json.load(fh)
    from ..functions.rules import RULES_TYPE

    phi = spark.read.schema(f"state string, status string, rules {RULES_TYPE}").json(os.path.join(out, "phi"))
    return phi, man
