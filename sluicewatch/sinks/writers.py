"""Writers for predictions, formulas, programs, automata and provenance manifests."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.network import LINE_ORDER

# Formula families in report order.
FAMILIES = ("MB_", "MBW_", "PHYS_", "RANGE_", "SLEW_", "PUMP_", "VALVE_", "HEAD_", "PRESSURE_",
            "PSLEW_", "CTRL_", "SYMM_")


def write_predictions(df: DataFrame, path: str, *flags: str) -> None:
    """scenario, row, y_true and the flag columns, in row order."""
    out = df.select("scenario", F.col("rn").alias("row"), F.col("label").alias("y_true"), *flags)
    out.repartitionByRange("scenario", "row").sortWithinPartitions("scenario", "row").write.mode(
        "overwrite").csv(path, header=True)


def formula_report(specs: dict[str, str]) -> str:
    """Formulas grouped by family; a formula belongs to the first family it starts with."""
    def rank(name: str) -> int:
        return next((i for i, f in enumerate(FAMILIES) if name.startswith(f)), len(FAMILIES))

    known = sorted((n for n in specs if rank(n) < len(FAMILIES)), key=rank)
    head = f"STL Specifications ({len(specs)} total)", "=" * 80, "", ""
    sections = ["\n".join(head)]
    for i, names in groupby(known, key=rank):
        bodies = [f"{n}\n  always[ {specs[n]} ]\n\n" for n in names]
        sections += [f"-- {FAMILIES[i].rstrip('_')} ({len(bodies)})\n", *bodies]
    return "".join(sections)


def write_json(path: str, value: Any) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def stage_manifest(schema: str, topology: str, **more: Any) -> dict[str, Any]:
    return {"schema": schema, "topology": topology,
            "generated_at": dt.datetime.now(dt.timezone.utc).isoformat(), **more}


def write_programs(lines: DataFrame, path: str) -> None:
    """Program texts as one folder per PLC, lines in order."""
    ordered = lines.repartitionByRange("plc", *LINE_ORDER).sortWithinPartitions("plc", *LINE_ORDER)
    ordered.select("plc", "text").write.partitionBy("plc").mode("overwrite").text(path)


def dot_lines(states: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(part, key, text) lines of a graph drawing; sort by part and key.

    ``states`` has (node), ``edges`` (frm, to, guard).
    """
    spark = states.sparkSession
    top = [f'digraph "{name}" {{', "    rankdir=LR;",
           "    node [shape=circle, style=filled, fillcolor=lightblue];", "    edge [fontsize=10];", ""]
    fixed = [(0, f"{i:02d}", t) for i, t in enumerate(top)] + [(2, "", ""), (4, "", "}")]
    q = '"'
    label = F.replace(F.replace("guard", F.lit(q), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    nodes = states.select(F.lit(1).alias("part"), F.col("node").alias("key"), F.format_string(
        '    "%s" [label="%s"];', "node", "node").alias("text"))
    arcs = edges.select(F.lit(3).alias("part"), F.concat_ws("\x01", "frm", "to", "guard").alias("key"),
                        F.format_string('    "%s" -> "%s" [label="%s"];', "frm", "to", label).alias("text"))
    return spark.createDataFrame(fixed, "part int, key string, text string").unionByName(nodes).unionByName(arcs)


def write_automaton(states: DataFrame, edges: DataFrame, path: str, name: str) -> None:
    """states/ and transitions/ as JSON lines, dot/ as text."""
    states.write.mode("overwrite").json(f"{path}/states")
    edges.repartitionByRange("frm", "to", "guard").sortWithinPartitions("frm", "to", "guard").write.mode(
        "overwrite").json(f"{path}/transitions")
    write_dot(states, edges, f"{path}/dot", name)


def write_dot(states: DataFrame, edges: DataFrame, path: str, name: str) -> None:
    dot = dot_lines(states, edges, name).repartitionByRange("part", "key").sortWithinPartitions("part", "key")
    dot.select("text").write.mode("overwrite").text(path)


# Columns of the ablation table.
ARM_COLUMNS = ("topology", "arm", "n", "attack_rows", "mcc", "balanced_accuracy", "auprc", "precision",
               "recall", "f1", "tp", "fp", "fn", "tn")


def write_ablation(predictions: DataFrame, arms: list[dict[str, Any]], out: str, topology: str) -> None:
    """agreement/ per row (gfsm next to stl), and one line per arm under a note."""
    g = F.greatest("y_pred_gfsm", "y_pred_invariants").alias("gfsm")
    rows = predictions.select("scenario", F.col("rn").alias("row"), F.col("label").alias("y_true"), g,
                              F.col("y_pred_stl").alias("stl"))
    rows.repartitionByRange("scenario", "row").sortWithinPartitions("scenario", "row").write.mode(
        "overwrite").csv(os.path.join(out, "agreement"), header=True)
    with open(os.path.join(out, f"{topology}_ablation.csv"), "w", encoding="utf-8") as fh:
        fh.write("# arms score their 0/1 decision, so auprc is coarse\n" + ",".join(ARM_COLUMNS) + "\n")
        for a in sorted(arms, key=lambda a: a["arm"]):
            row = {**a, "topology": topology, "auprc": a["aucpr"]}
            fh.write(",".join(str(row[c]) for c in ARM_COLUMNS) + "\n")
