"""Readers for network files, PLC maps, program sources and stored artifacts."""

from __future__ import annotations

import os
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import network
from .telemetry import DataError


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text), line numbers from 1."""
    whole = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("i", "text"))
    return lines.select("file", (F.col("i") + 1).cast("long").alias("line_no"), "text")


def read_inp(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """tanks, pumps, valves and controls of the network files at ``path``."""
    keys = ["file"]
    sec = network.no_rules(network.sections(read_lines(spark, path), keys))
    return {"tanks": network.tanks(sec, keys), "pumps": network.pumps(sec, keys),
            "valves": network.valves(sec, keys), "controls": network.controls(sec, keys)}


def plc_problems(entries: list) -> list[str]:
    """What is wrong with the entries of a PLC map, one sentence each."""
    named = [e.get("name") if isinstance(e, dict) else None for e in entries]
    found = [f"entry {i + 1} needs a name in text" for i, n in enumerate(named) if not isinstance(n, str)]
    found += [f"the name {n} stands {c} times" for n, c in Counter(n for n in named if isinstance(n, str)).items() if c > 1]
    for e, n in zip(entries, named, strict=True):
        for kind in ("sensors", "actuators") if isinstance(n, str) else ():
            devices = e.get(kind) or []
            if not (isinstance(devices, list) and {type(x) for x in devices} <= {str}):
                found.append(f"{kind} of {n} are no list of names")
    return found


def read_plcs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plcs, actuators, sensors) of a PLC map; the map names devices, it holds no data.

    All problems of a map are told at once.
    """
    from .dataset import _yaml

    entries = _yaml().safe_load(spark.read.text(path, wholetext=True).first()[0])
    problems = plc_problems(entries) if isinstance(entries, list) else ["a list of PLCs is expected"]
    if problems:
        raise DataError(f"unusable PLC map {path}: " + "; ".join(problems))
    plcs = [(e["name"], i) for i, e in enumerate(entries)]
    acts, sensors = ([(e["name"], x) for e in entries for x in e.get(kind) or []] for kind in ("actuators", "sensors"))
    return (spark.createDataFrame(plcs, "plc string, ord long"),
            spark.createDataFrame([(p, i, x) for i, (p, x) in enumerate(acts)], "plc string, act_ord long, actuator string"),
            spark.createDataFrame([(p, i, x) for i, (p, x) in enumerate(sensors)], "plc string, ord long, sensor string"))


def read_programs(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of program sources, one row per file."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.st").select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def read_automaton(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(states, transitions) of a stored global automaton in its JSON form."""
    if not os.path.exists(path):
        raise DataError(f"gfsm json not found: {path}")
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", (
        "initial string, states map<string,array<string>>, transitions array<struct<`from`:string,"
        "`to`:string,from_state:string,to_state:string,guard:string>>")).alias("g"))
    states = doc.select(F.explode("g.states").alias("state", "locals"))
    t = doc.select(F.explode("g.transitions").alias("t"))
    frm, to = F.coalesce("t.from_state", "t.from"), F.coalesce("t.to_state", "t.to")
    bad = F.raise_error(F.lit("gfsm transition missing from/to keys")).cast("string")
    return states, t.select(F.coalesce(frm, bad).alias("prev"), F.coalesce(to, bad).alias("state"),
                            F.col("t.guard").alias("guard"))


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """((state, rules), K) of a stored rule file; ``in`` atoms need two bounds."""
    if not os.path.exists(path):
        raise DataError(f"phi json not found: {path}")
    atom = "array<struct<col:string,op:string,val:string>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", (
        "violation_threshold int, gfsm_manifest_sha256 string, dataset_manifest_sha256 string, "
        f"states map<string,struct<status:string,rules:array<struct<id:string,antecedent:{atom},"
        f"consequent:{atom},support:double,confidence:double,lift:double>>>>")).alias("p"))
    k = doc.select("p.violation_threshold").first()[0]

    def bounds(a):
        two = F.from_json(a["val"], "array<double>")
        bad = F.raise_error(F.lit("malformed rule: 'in' atom requires a 2-element val")).cast("double")
        one = a["val"].try_cast("double")
        is_in = a["op"] == "in"
        ok = F.coalesce(F.size(two) == 2, F.lit(False))
        return F.struct(a["col"].alias("col"), a["op"].alias("op"),
                        F.when(~is_in, one).when(ok, two[0]).otherwise(bad).alias("lo"),
                        F.when(is_in & ok, two[1]).alias("hi"))

    rules = doc.select(F.explode("p.states").alias("state", "e")).select("state", F.transform(
        F.coalesce("e.rules", F.array()), lambda r: F.struct(
            r["id"].alias("id"), F.transform(r["antecedent"], bounds).alias("antecedent"),
            F.transform(r["consequent"], bounds).alias("consequent"))).alias("rules"))
    return rules, max(1, k or 1)
