"""Water-network files and the control programs generated from them, as line tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import format_g, iec_ident
from ..session import cut_lineage
from .segments import carry_values

# The one control form that is understood, and the section header form.
CONTROL = (r"(?i)^\s*LINK\s+(\S+)\s+(OPEN|CLOSED)\s+IF\s+NODE\s+(\S+)\s+(BELOW|ABOVE)\s+"
           r"(-?(?:\d+\.?\d*|\.\d+))\s*$")
SECTION = r"^\s*\[([A-Za-z_]+)\]\s*$"


def sections(lines: DataFrame, keys: Sequence[str], pos: str = "line_no") -> DataFrame:
    """Data lines with their section: comments and blanks dropped, headers carried forward."""
    head = F.when(F.col("text").rlike(SECTION), F.upper(F.regexp_extract("text", SECTION, 1)))
    marked = lines.select(*keys, pos, "text", head.alias("_head"), head.alias("section"))
    carried = carry_values(marked, keys, ["section"], pos=pos)
    data = F.trim(F.regexp_replace(F.trim("text"), ";.*$", ""))
    return carried.filter(F.col("_head").isNull() & F.col("section").isNotNull()).select(
        *keys, pos, "section", data.alias("data")).filter(F.col("data") != "")


def _fail(message: str, what: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), F.lit(" at line "), F.col("line_no").cast("string"),
                                  F.lit(": "), what)).cast("string")


def _fields(section: str, least: int) -> Column:
    parts = F.split("data", r"\s+")
    return F.when(F.size(parts) >= least, parts).otherwise(
        F.split(_fail(f"[{section}] too few fields", F.col("data")), " "))


def tanks(sec: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    p = sec.filter("section = 'TANKS'").withColumn("p", _fields("TANKS", 6))
    return p.select(*keys, F.col("p")[0].alias("id"), F.col("p")[3].cast("double").alias("min_level"),
                    F.col("p")[4].cast("double").alias("max_level"))


def pumps(sec: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    p = sec.filter("section = 'PUMPS'").withColumn("p", _fields("PUMPS", 3))
    return p.select(*keys, *[F.col("p")[i].alias(n) for i, n in enumerate(("id", "node1", "node2"))])


def valves(sec: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    p = sec.filter("section = 'VALVES'").withColumn("p", _fields("VALVES", 6))
    return p.select(*keys, *[F.col("p")[i].alias(n) for i, n in enumerate(("id", "node1", "node2"))],
                    F.upper(F.col("p")[4]).alias("vtype"), F.col("p")[5].cast("double").alias("setting"))


def parse_control(data: Column) -> Column:
    """struct<link,target,sensor,comparator,threshold>; NULL for any other form."""
    def part(i: int) -> Column:
        return F.regexp_extract(data, CONTROL, i)

    return F.when(data.rlike(CONTROL), F.struct(
        part(1).alias("link"), F.upper(part(2)).alias("target"), part(3).alias("sensor"),
        F.upper(part(4)).alias("comparator"), part(5).cast("double").alias("threshold")))


def controls(sec: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Controls with their line number; raises on an unsupported form."""
    c = sec.filter("section = 'CONTROLS'").withColumn("c", parse_control(F.col("data")))
    link = F.coalesce(F.col("c.link"), _fail("[CONTROLS] unsupported control", F.col("data")))
    return c.select(*keys, F.col("line_no").alias("ord"), link.alias("link"), "c.target", "c.sensor",
                    "c.comparator", "c.threshold")


def no_rules(sec: DataFrame) -> DataFrame:
    """The sections again; raises when a [RULES] section has a line."""
    bad = F.col("section") == "RULES"
    return sec.withColumn("section", F.when(bad, _fail("[RULES] is not supported", F.col("data")))
                          .otherwise(F.col("section")))


def ambiguous(c: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(link, comparator, threshold) that command both OPEN and CLOSED."""
    return c.groupBy(*keys, "link", "comparator", "threshold").agg(
        F.min("target").alias("t0"), F.max("target").alias("t1")).filter(
        F.col("t0") != F.col("t1")).drop("t0", "t1")


def sensor_owner(declared: DataFrame) -> DataFrame:
    """Owning PLC per sensor; of several declarations the last one counts."""
    return declared.groupBy("sensor").agg(F.max_by("plc", "ord").alias("owner"))


def control_use(actuators: DataFrame, c: DataFrame) -> DataFrame:
    """Controls per PLC actuator with their place in the program: OPEN before CLOSED."""
    use = actuators.join(c, actuators["actuator"] == c["link"])
    return use.withColumn("st", F.when(F.col("target") == "OPEN", 0).otherwise(1))


def sensors_used(use: DataFrame) -> DataFrame:
    """(plc, sensor, first use) without repeats."""
    return use.groupBy("plc", "sensor").agg(F.min(F.struct("act_ord", "st", "ord")).alias("first"))


LINE_ORDER = ("sec", "act_ord", "st", "ord", "ln")


def program_lines(plcs: DataFrame, actuators: DataFrame, owners: DataFrame, c: DataFrame,
                  topology: str, inp: str = "", plcs_file: str = "") -> DataFrame:
    """Program text of every PLC as (plc, sec, act_ord, st, ord, ln, text).

    Lines sort by ``LINE_ORDER`` within a PLC. ``plcs`` (plc), ``actuators`` (plc, act_ord,
    actuator), ``owners`` (sensor, owner), ``c`` (link, ord, target, sensor, comparator,
    threshold). Ambiguous controls must have been ruled out.
    """
    use = cut_lineage(control_use(actuators, c))  # every part of the text reads it
    acts = use.select("plc", "act_ord", "actuator").distinct()
    zero = F.lit(0).cast("long")

    def rows(df: DataFrame, sec: int, texts: Sequence[str | Column], act=zero, st=None, order=zero,
             first: int = 0) -> DataFrame:
        items = F.array(*[F.struct(F.lit(first + i).alias("ln"),
                                   (F.lit(t) if isinstance(t, str) else t).alias("text"))
                          for i, t in enumerate(texts)])
        return df.select("plc", F.lit(sec).alias("sec"), act.cast("long").alias("act_ord"),
                         (F.lit(0) if st is None else st).alias("st"),
                         order.cast("long").alias("ord"), F.inline(items))

    busy = acts.select("plc").distinct()
    head = [F.concat(F.lit(f"(* Auto-generated by st_gen from {inp} + {plcs_file}")),
            F.concat(F.lit(f"   Topology: {topology}   PLC: "), "plc"), "   DO NOT EDIT. *)", "",
            F.concat(F.lit("PROGRAM "), "plc")]
    note = "(* No actuators with [CONTROLS] entries -- sensor-only or static-setting PLC. *)"
    used = sensors_used(use).join(owners, "sensor", "left")
    annot = (F.when(F.col("owner").isNull(), "(* unassigned in plcs.yaml *)")
             .when(F.col("owner") == F.col("plc"), "(* owned by this PLC *)")
             .otherwise(F.concat(F.lit("(* sourced from "), "owner", F.lit(" *)"))))
    act, state = iec_ident(F.col("actuator")), F.concat(iec_ident(F.col("actuator")), F.lit("_State"))
    i4 = "    "
    test = F.concat(F.lit("        IF "), iec_ident(F.col("sensor")),
                    F.when(F.col("comparator") == "BELOW", " < ").otherwise(" > "),
                    format_g(F.col("threshold")), F.lit(" THEN"))
    a, o = F.col("act_ord"), F.col("ord")
    parts = [
        rows(plcs, 0, head),
        rows(plcs.join(busy, "plc", "left_anti"), 1, [note]),
        rows(busy, 2, ["VAR_INPUT"]),
        rows(used, 3, [F.concat(F.lit(i4), iec_ident(F.col("sensor")), F.lit(" : REAL;            "), annot)],
             act=F.col("first.act_ord"), st=F.col("first.st"), order=F.col("first.ord")),
        rows(busy, 4, ["END_VAR", "VAR_OUTPUT"]),
        rows(acts, 5, [F.concat(F.lit(i4), act, F.lit(" : BOOL;"))], act=a),
        rows(busy, 6, ["END_VAR", "VAR"]),
        rows(acts, 7, [F.concat(F.lit(i4), state, F.lit(" : INT := 0;"))], act=a),
        rows(busy, 8, ["END_VAR", ""]),
        rows(acts, 9, [F.concat(F.lit("(* ----- FSM for actuator "), "actuator", F.lit(" ----- *)")),
                       F.concat(F.lit("CASE "), state, F.lit(" OF")), "    0:  (* CLOSED *)"],
             act=a, st=F.lit(-1)),
        rows(use, 9, [test, F.concat(F.lit("            "), state, F.lit(" := "),
                                     F.when(F.col("st") == 0, "1").otherwise("0"), F.lit(";")),
                      "        END_IF;"], act=a, st=F.col("st") * 2, order=o),
        rows(acts, 9, ["    1:  (* OPEN *)"], act=a, st=F.lit(1)),
        rows(acts, 9, ["END_CASE;", F.concat(act, F.lit(" := ("), state, F.lit(" = 1);")), ""],
             act=a, st=F.lit(3)),
        rows(plcs, 10, ["END_PROGRAM"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def manifest_rows(plcs: DataFrame, actuators: DataFrame, owners: DataFrame, c: DataFrame) -> DataFrame:
    """One row per controlled actuator: (plc, act_ord, actuator, states, transitions)."""
    use = control_use(actuators, c)
    return use.groupBy("plc", "act_ord", "actuator").agg(
        F.lit(2).alias("states"), F.count(F.lit(1)).alias("transitions"))
