"""Command line: one subcommand per stage. Exit 0 ok, 1 a unit failed, 2 unusable input."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import dataset, network_files, telemetry
from . import pipeline


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sluicewatch")
    sub = p.add_subparsers(dest="stage", required=True)

    def stage(name: str, *options: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        who = s.add_mutually_exclusive_group(required=True)
        who.add_argument("--topology")
        who.add_argument("--all", action="store_true")
        s.add_argument("--data-root", default="data")
        for o in options:
            s.add_argument(o)
        return s

    stage("dataio-ingest").add_argument("--raw-root", default=os.path.expanduser("~/Downloads"))
    g = stage("st-gen", "--inp", "--plcs")
    g.add_argument("--out", default=None)
    stage("st-analyze", "--out")
    stage("stl-monitor", "--out")
    b = stage("gfsm-build", "--out")
    b.add_argument("--max-states", type=int, default=None)
    m = stage("invariants-mine", "--out")
    m.add_argument("--fp-budget", type=float, default=0.01)
    h = stage("ics-monitor", "--out")
    h.add_argument("--fusion", choices=("intersection", "or"), default="intersection")
    return p


def programs_of(spark: SparkSession, root: str, topology: str):
    """Program sources of a topology: plain .st files, or the line folders st-gen writes."""
    flat = os.path.join(root, topology, "st")
    if os.path.isdir(flat):
        return network_files.read_programs(spark, flat)
    folder = os.path.join(root, "generated", topology, "st", "programs")
    if not os.path.isdir(folder):
        raise telemetry.DataError(f"no programs for {topology}")
    parts = spark.read.text(folder, wholetext=True).select("*", F.col("_metadata.file_path").alias("p"))
    # A program is its parts in name order; it is one compile unit and thus one row of text.
    return parts.groupBy(F.concat("plc", F.lit(".st")).alias("file")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("p", "value"))),
        lambda x: x["value"]), "").alias("text"))


def listed_fsms(spark: SparkSession, made: str):
    """FSMs per program that st-gen wrote, when it ran."""
    path = os.path.join(made, "st", "fsms")
    if not os.path.isdir(path):
        return None
    return spark.read.schema("plc string, actuator string").json(path).groupBy("plc").agg(
        F.count(F.lit(1)).alias("n_listed"))


def run(spark: SparkSession, a: argparse.Namespace, topology: str) -> bool:
    root = a.data_root
    made = os.path.join(root, "generated", topology)

    def out(stage: str) -> str:
        return getattr(a, "out", None) or os.path.join(made, stage)

    if a.stage == "dataio-ingest":
        pipeline.ingest(spark, topology, a.raw_root, root)
        return True
    if a.stage == "st-gen":
        pipeline.generate(spark, topology, a.inp, a.plcs, out("st"))
        return True
    if a.stage == "st-analyze":
        return pipeline.analyze(spark, programs_of(spark, root, topology), out("analysis"), topology)["all_ok"]
    if a.stage == "gfsm-build":
        return pipeline.build(spark, programs_of(spark, root, topology), out("gfsm"), topology, a.max_states,
                              listed_fsms(spark, made))[1]["all_ok"]
    ds = dataset.load_dataset(spark, root, topology)
    if a.stage == "stl-monitor":
        return pipeline.monitor_stl(spark, ds, out("stl"))["all_ok"]
    text = dataset.read_manifest(root, topology)[1]
    components, known, allowed, built = pipeline.read_built(spark, os.path.join(made, "gfsm"), topology)
    if a.stage == "invariants-mine":
        if not 0.0 < a.fp_budget < 1.0:
            raise telemetry.DataError(f"--fp-budget must be in (0, 1), got {a.fp_budget}")
        return pipeline.mine(spark, ds, components, out("invariants"), built, text, a.fp_budget)["all_ok"]
    phi, man = pipeline.read_mined(spark, os.path.join(made, "invariants"), topology)
    pipeline.check_fresh(man, built, text)
    return pipeline.monitor(spark, ds, components, known, allowed, out("monitor"), phi,
                            max(1, man["violation_threshold"]), a.fusion)["all_ok"]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"sluicewatch {a.stage}").getOrCreate()
    names = [a.topology] if a.topology else ["anytown", "ctown"]
    failed, bad = False, False
    for topology in names:
        try:
            failed |= not run(spark, a, topology)
        except (telemetry.DataError, PySparkException, ValueError, OSError) as exc:
            print(f"error: {topology}: {exc}", file=sys.stderr)
            bad = True
            if not a.all:
                return 2
    return 2 if bad else int(failed)


if __name__ == "__main__":
    sys.exit(main())
