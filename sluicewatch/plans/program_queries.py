"""Queries on network controls and control programs derived from the order tables.

Every customer is a pump: it opens below the smallest and closes above the largest quantity
it was sold, and the suppliers of those lines are the tanks it watches. PLCs are nations.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import guards, naming
from ..operators import network, programs
from ..operators.segments import with_positions
from ..session import cut_lineage
from .registry import query
from .trace import SQL, table, trace

NAME = "CASE WHEN {s} % 2 = 0 THEN 'T' || {s} ELSE {s} || 'T' END"
IDENT = "CASE WHEN {s} % 2 = 0 THEN 'T' || {s} ELSE 'v_' || {s} || 'T' END"
NUM = "CAST(CAST({q} AS BIGINT) AS VARCHAR)"  # quantities are whole numbers
CT = f"""ct AS (SELECT o_custkey AS c, min(l_quantity) AS loq, max(l_quantity) AS hiq,
  arg_min(l_suppkey, l_quantity * 1000000000 + l_suppkey) AS los, arg_max(l_suppkey, l_quantity * 1000000000 + l_suppkey) AS his
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
cl AS (SELECT 'PU' || c AS link, c, 0 AS ord, 'OPEN' AS target, {NAME.format(s='los')} AS sensor, los AS s, 'BELOW' AS comparator, loq AS threshold FROM ct
  UNION ALL SELECT 'PU' || c, c, 1, 'CLOSED', {NAME.format(s='his')}, his, 'ABOVE', hiq FROM ct)"""


def sold(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return li.join(o, "l_orderkey")


def limits(spark, d):
    rank = F.struct("l_quantity", "l_suppkey")
    return sold(spark, d).groupBy(F.col("o_custkey").alias("c")).agg(
        F.min("l_quantity").alias("loq"), F.max("l_quantity").alias("hiq"),
        F.min_by("l_suppkey", rank).alias("los"), F.max_by("l_suppkey", rank).alias("his"))


def tank(s):
    n = F.col(s).cast("string")
    return F.when(F.col(s) % 2 == 0, F.concat(F.lit("T"), n)).otherwise(F.concat(n, F.lit("T")))


def control_lines(spark, d):
    """The controls as the text lines a network file has."""
    pump = F.concat(F.lit("LINK PU"), F.col("c").cast("string"))
    texts = F.array(
        F.struct(F.lit(0).alias("ord"), F.concat(pump, F.lit(" OPEN   IF NODE "), tank("los"), F.lit(" BELOW "),
                                                 naming.format_g(F.col("loq"))).alias("text")),
        F.struct(F.lit(1).alias("ord"), F.concat(pump, F.lit(" closed IF NODE "), tank("his"), F.lit(" Above "),
                                                 naming.format_g(F.col("hiq")), F.lit(".0")).alias("text")))
    return limits(spark, d).select("c", F.inline(texts))


def parsed_controls(spark, d):
    p = network.parse_control(F.col("text"))
    return control_lines(spark, d).withColumn("p", p).select("c", "ord", "p.*")


@query("control_regex", f"WITH {CT} SELECT link, ord, target, sensor, comparator, threshold FROM cl")
def control_regex(spark, d):
    return parsed_controls(spark, d).drop("c")


@query("controls_by_link", f"""WITH {CT} SELECT link, count(*) AS n, string_agg(sensor, ',' ORDER BY ord) AS sensors FROM cl GROUP BY link""")
def controls_by_link(spark, d):
    # A link has two controls here; in a network file it has a handful.
    return parsed_controls(spark, d).groupBy("link").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("ord", "sensor"))), lambda x: x["sensor"]), ",").alias("sensors"))


@query("ambiguous_controls", """SELECT 'PU' || o_custkey AS link, CASE l_returnflag WHEN 'A' THEN 'BELOW' ELSE 'ABOVE' END AS comparator,
  l_quantity AS threshold FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3 HAVING count(DISTINCT l_linestatus) > 1""")
def ambiguous_controls(spark, d):
    c = sold(spark, d).select(
        F.concat(F.lit("PU"), F.col("o_custkey").cast("string")).alias("link"),
        F.when(F.col("l_returnflag") == "A", "BELOW").otherwise("ABOVE").alias("comparator"),
        F.col("l_quantity").alias("threshold"),
        F.when(F.col("l_linestatus") == "O", "OPEN").otherwise("CLOSED").alias("target"))
    return network.ambiguous(c)


@query("sensor_owner_lookup", """SELECT 'T' || l_suppkey AS sensor, 'PLC' || arg_max(c_nationkey, l_orderkey) AS owner
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY l_suppkey""")
def sensor_owner_lookup(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    declared = sold(spark, d).join(c, "o_custkey").select(
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("sensor"),
        F.concat(F.lit("PLC"), F.col("c_nationkey").cast("string")).alias("plc"), F.col("l_orderkey").alias("ord"))
    return network.sensor_owner(declared)


def program_parts(spark, d):
    """(plcs, actuators, owners, controls) of the whole network."""
    name = F.concat(F.lit("PLC"), F.col("n_nationkey").cast("string"))
    plcs = table(spark, d, "nation").select(name.alias("plc"))
    acts = table(spark, d, "customer").select(
        F.concat(F.lit("PLC"), F.col("c_nationkey").cast("string")).alias("plc"),
        F.col("c_custkey").alias("act_ord"), F.concat(F.lit("PU"), F.col("c_custkey").cast("string")).alias("actuator"))
    owners = table(spark, d, "supplier").select(
        tank("s_suppkey").alias("sensor"), F.concat(F.lit("PLC"), F.col("s_nationkey").cast("string")).alias("owner"))
    return plcs, acts, owners, parsed_controls(spark, d).drop("c")


USE = f"""WITH {CT}, us AS (SELECT 'PLC' || c_nationkey AS plc, c_custkey AS act_ord, cl.* FROM cl JOIN customer ON c = c_custkey),
fu AS (SELECT plc, sensor, s, min(act_ord * 2 + ord) AS f FROM us GROUP BY plc, sensor, s)"""


@query("ordered_distinct", f"""{USE} SELECT plc, sensor, row_number() OVER (PARTITION BY plc ORDER BY f, sensor) - 1 AS pos FROM fu""")
def ordered_distinct(spark, d):
    _, acts, _, c = program_parts(spark, d)
    used = network.sensors_used(network.control_use(acts, c)).select("plc", "sensor", F.struct(
        "first.act_ord", "first.st", "first.ord").alias("f"))
    return with_positions(used, ["plc"], ["f", "sensor"], F.floor(F.col("f.act_ord") / 10_000), "pos").drop("f")


@query("st_emit", f"""{USE},
ac AS (SELECT DISTINCT plc, act_ord, link FROM us),
ow AS (SELECT {NAME.format(s='s_suppkey')} AS sensor, 'PLC' || s_nationkey AS owner FROM supplier),
al AS (SELECT 'PLC' || n_nationkey AS plc FROM nation), bz AS (SELECT DISTINCT plc FROM ac),
x(plc, sec, a, st, o, ln, text) AS (
  SELECT plc, 0, 0, 0, 0, 0, '(* Auto-generated by st_gen from net.inp + plcs.yaml' FROM al
  UNION ALL SELECT plc, 0, 0, 0, 0, 1, '   Topology: tpch   PLC: ' || plc FROM al UNION ALL SELECT plc, 0, 0, 0, 0, 2, '   DO NOT EDIT. *)' FROM al
  UNION ALL SELECT plc, 0, 0, 0, 0, 3, '' FROM al UNION ALL SELECT plc, 0, 0, 0, 0, 4, 'PROGRAM ' || plc FROM al
  UNION ALL SELECT plc, 1, 0, 0, 0, 0, '(* No actuators with [CONTROLS] entries -- sensor-only or static-setting PLC. *)' FROM al WHERE plc NOT IN (SELECT plc FROM bz)
  UNION ALL SELECT plc, 2, 0, 0, 0, 0, 'VAR_INPUT' FROM bz
  UNION ALL SELECT fu.plc, 3, f // 2, f % 2, f % 2, 0, '    ' || {IDENT.format(s='s')} || ' : REAL;            ' ||
    CASE WHEN owner IS NULL THEN '(* unassigned in plcs.yaml *)' WHEN owner = fu.plc THEN '(* owned by this PLC *)' ELSE '(* sourced from ' || owner || ' *)' END
    FROM fu LEFT JOIN ow USING (sensor)
  UNION ALL SELECT plc, 4, 0, 0, 0, 0, 'END_VAR' FROM bz UNION ALL SELECT plc, 4, 0, 0, 0, 1, 'VAR_OUTPUT' FROM bz
  UNION ALL SELECT plc, 5, act_ord, 0, 0, 0, '    ' || link || ' : BOOL;' FROM ac
  UNION ALL SELECT plc, 6, 0, 0, 0, 0, 'END_VAR' FROM bz UNION ALL SELECT plc, 6, 0, 0, 0, 1, 'VAR' FROM bz
  UNION ALL SELECT plc, 7, act_ord, 0, 0, 0, '    ' || link || '_State : INT := 0;' FROM ac
  UNION ALL SELECT plc, 8, 0, 0, 0, 0, 'END_VAR' FROM bz UNION ALL SELECT plc, 8, 0, 0, 0, 1, '' FROM bz
  UNION ALL SELECT plc, 9, act_ord, -1, 0, 0, '(* ----- FSM for actuator ' || link || ' ----- *)' FROM ac
  UNION ALL SELECT plc, 9, act_ord, -1, 0, 1, 'CASE ' || link || '_State OF' FROM ac UNION ALL SELECT plc, 9, act_ord, -1, 0, 2, '    0:  (* CLOSED *)' FROM ac
  UNION ALL SELECT plc, 9, act_ord, ord * 2, ord, 0, '        IF ' || {IDENT.format(s='s')} || CASE comparator WHEN 'BELOW' THEN ' < ' ELSE ' > ' END || {NUM.format(q='threshold')} || ' THEN' FROM us
  UNION ALL SELECT plc, 9, act_ord, ord * 2, ord, 1, '            ' || link || '_State := ' || (1 - ord) || ';' FROM us
  UNION ALL SELECT plc, 9, act_ord, ord * 2, ord, 2, '        END_IF;' FROM us
  UNION ALL SELECT plc, 9, act_ord, 1, 0, 0, '    1:  (* OPEN *)' FROM ac
  UNION ALL SELECT plc, 9, act_ord, 3, 0, 0, 'END_CASE;' FROM ac UNION ALL SELECT plc, 9, act_ord, 3, 0, 1, link || ' := (' || link || '_State = 1);' FROM ac
  UNION ALL SELECT plc, 9, act_ord, 3, 0, 2, '' FROM ac
  UNION ALL SELECT plc, 10, 0, 0, 0, 0, 'END_PROGRAM' FROM al)
SELECT plc, row_number() OVER (PARTITION BY plc ORDER BY sec, a, st, o, ln) AS line_no, text FROM x""")
def st_emit(spark, d):
    lines = network.program_lines(*program_parts(spark, d), "tpch", "net.inp", "plcs.yaml")
    # One program may hold most pumps: number its lines in runs of 10,000 pumps.
    run = F.col("sec").cast("long") * 1_000_000_000 + F.floor(F.col("act_ord") / 10_000)
    out = with_positions(lines, ["plc"], list(network.LINE_ORDER), run, "line_no")
    return out.select("plc", (F.col("line_no") + 1).alias("line_no"), "text")


@query("inp_section_carry", f"""WITH {SQL},
li AS (SELECT scenario || '/' || split AS scenario, rn + 1 AS line_no, CASE WHEN event_type = 'signup' AND f_pu1 < 50 THEN ' [Tanks]  ' WHEN event_type = 'signup' THEN '[PUMPS]'
  WHEN f_pu1 % 7 = 0 THEN '; note' ELSE ' N' || CAST(f_pu1 AS BIGINT) || ' 1 2 ;rest' END AS text FROM tr),
h AS (SELECT *, CASE WHEN text = ' [Tanks]  ' THEN 'TANKS' WHEN text = '[PUMPS]' THEN 'PUMPS' END AS hd FROM li),
s AS (SELECT *, last_value(hd IGNORE NULLS) OVER (PARTITION BY scenario ORDER BY line_no) AS section FROM h)
SELECT scenario, line_no, section, rtrim(trim(replace(text, ';rest', ''))) AS data FROM s
WHERE hd IS NULL AND section IS NOT NULL AND text <> '; note'""")
def inp_section_carry(spark, d):
    t = trace(spark, d, None, "event_type", "f_pu1").withColumn("scenario", F.concat_ws("/", "scenario", "split"))
    head = F.col("event_type") == "signup"
    text = (F.when(head & (F.col("f_pu1") < 50), " [Tanks]  ").when(head, "[PUMPS]")
            .when(F.col("f_pu1") % 7 == 0, "; note")
            .otherwise(F.concat(F.lit(" N"), F.col("f_pu1").cast("long").cast("string"), F.lit(" 1 2 ;rest"))))
    lines = t.select("scenario", (F.col("rn") + 1).alias("line_no"), text.alias("text"))
    return network.sections(lines, ["scenario"])


def spread(df):
    """Few bytes a row but much to do for each: one task a core, which AQE would join into one by size."""
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sources(spark, d):
    """One control program per customer, as a source file with comments and nested IFs."""
    k, lo, hi = (F.col(c).cast("string") for c in ("c", "los", "his"))
    loq, hiq = naming.format_g(F.col("loq")), naming.format_g(F.col("hiq"))
    text = F.concat(
        F.lit("(* pump of customer "), k, F.lit(";\n   IF ignored THEN *)\nPROGRAM PLC"), k,
        F.lit("\nVAR_INPUT\n  L"), lo, F.lit(" : REAL;  (* low tank *)\n  H"), hi,
        F.lit(" : REAL;\nEND_VAR\nVAR_OUTPUT\n  PU, Alarm : BOOL;\nEND_VAR\nVAR\n  PU_State : INT := 0;\n  hi_limit : REAL := "),
        hiq, F.lit(";\n  lvl : REAL;\nEND_VAR\n\nCASE PU_State OF\n  0:  (* CLOSED *)\n    Alarm := FALSE;\n    IF L"), lo, F.lit(" < "), loq,
        F.lit(" THEN\n      PU_State := 1;\n    END_IF;\n  1:\n    lvl := H"), hi,
        F.lit(" + 1;\n    IF lvl > hi_limit THEN\n      IF L"), lo, F.lit(" >= "), loq,
        F.lit(" AND NOT (H"), hi, F.lit(" = 0) THEN PU_State := 0; PU := FALSE; END_IF;\n    ELSIF lvl < 0 THEN\n"
              "      PU_State := 2;\n    END_IF;\n  2, 3..4:\n    IF lvl > hi_limit THEN\n      Alarm := TRUE;\n    ELSE\n"
              "      PU_State := 0;\n    END_IF;\nEND_CASE;\nPU := (PU_State = 1);\nEND_PROGRAM\n"))
    return spread(limits(spark, d)).select(k.alias("file"), text.alias("text"))


def nodes(spark, d):
    return programs.statements(sources(spark, d))


LO, HI, ND = NUM.format(q='loq'), NUM.format(q='hiq'), "'L' || los || ' >= ' || " + NUM.format(q='loq') + " || ' AND NOT (H' || his || ' = 0)'"


@query("st_statements", f"""WITH {CT}, v(kind, n) AS (VALUES ('program', 1), ('var', 3), ('declare', 6), ('case', 1), ('label', 3), ('if', 4), ('elsif', 1), ('else', 1), ('assign', 9))
SELECT CAST(c AS VARCHAR) AS file, kind, n::BIGINT AS n, CASE kind WHEN 'program' THEN 0 WHEN 'var' THEN 1 WHEN 'declare' THEN 2 WHEN 'case' THEN 1
  WHEN 'label' THEN 2 WHEN 'if' THEN 4 WHEN 'elsif' THEN 3 WHEN 'else' THEN 3 ELSE 5 END::BIGINT AS deepest FROM ct, v""")
def st_statements(spark, d):
    s = programs.statements(sources(spark, d))
    return s.groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"))


@query("st_variables", f"""WITH {CT}, v AS (
  SELECT c, 'input' AS scope, 'L' || los AS name, 'REAL' AS type, NULL AS init, CASE WHEN false THEN '' ELSE 'sensing' END AS role FROM ct
  UNION ALL SELECT c, 'input', 'H' || his, 'REAL', NULL, 'sensing' FROM ct
  UNION ALL SELECT c, 'output', 'PU', 'BOOL', NULL, 'actuation' FROM ct UNION ALL SELECT c, 'output', 'Alarm', 'BOOL', NULL, 'actuation' FROM ct
  UNION ALL SELECT c, 'var', 'PU_State', 'INT', '0', 'internal' FROM ct UNION ALL SELECT c, 'var', 'lvl', 'REAL', NULL, 'internal' FROM ct
  UNION ALL SELECT c, 'var', 'hi_limit', 'REAL', {HI}, 'configuration' FROM ct)
SELECT CAST(c AS VARCHAR) AS file, scope, name, type, init, role FROM v""")
def st_variables(spark, d):
    return programs.variables(nodes(spark, d)).drop("program")


@query("fsm_extract", f"""WITH {CT}, v AS (
  SELECT c, '0' AS frm, '1' AS "to", 'L' || los || ' < ' || {LO} AS condition FROM ct
  UNION ALL SELECT c, '1', '0', 'lvl > hi_limit' FROM ct UNION ALL SELECT c, '1', '0', {ND} FROM ct
  UNION ALL SELECT c, '1', '2', '(lvl < 0) AND NOT (lvl > hi_limit)' FROM ct
  UNION ALL SELECT c, s, '0', 'NOT (lvl > hi_limit)' FROM ct, (VALUES ('2'), ('3'), ('4')) k(s))
SELECT CAST(c AS VARCHAR) AS file, 'PU_State' AS case_var, frm, "to", condition FROM v""")
def fsm_extract(spark, d):
    return programs.automata(nodes(spark, d))[1].select("file", "case_var", "frm", "to", "condition")


def shapes(spark, d):
    """One program per customer in six shapes: nested CASE with ELSE, loops, calls, named labels, strings, ELSIF chain."""
    lim = spread(limits(spark, d))
    low = F.concat(F.lit("L"), F.col("los").cast("string"), F.lit(" < "), naming.format_g(F.col("loq")))
    high = F.concat(F.lit("H"), F.col("his").cast("string"), F.lit(" > "), naming.format_g(F.col("hiq")))
    forms = [
        "0: CASE T OF 1: IF {low} THEN T := 2; END_IF; ELSE IF y > 1 THEN T := 3; END_IF; q := 5; END_CASE;\n"
        " IF {high} THEN S := 1; END_IF; 1: x := 0;",
        "0: FOR i := 1 TO 3 DO IF {low} THEN S := 1; END_IF; END_FOR;\n 1: WHILE x > 0 DO x := x - 1; END_WHILE; IF {high} THEN S := 0; END_IF;",
        "0: TON1(IN := TRUE, PT := T#5s); IF TON1.Q THEN S := 1; END_IF;\n 1: Reset(); IF {high} THEN S := 0; END_IF;",
        "IDLE: IF {low} THEN S := RUN; END_IF;\n RUN, HOLD: IF {high} THEN S := IDLE; END_IF;",
        "0: msg := 'a; IF b THEN (* x'; IF {low} THEN S := 1; END_IF;\n 1: (* it's *) IF mode = 'off;' THEN S := 0; END_IF;",
        "0: IF {low} THEN S := 1; ELSIF {high} THEN S := 2; ELSE S := 3; END_IF; 1: x := 1; 2: x := 2; 3: x := 3;"]
    text = F.lit("")
    for i, form in enumerate(forms):
        parts = [{"low": low, "high": high}[x] if n % 2 else F.lit(x) for n, x in enumerate(re.split(r"\{(low|high)\}", form))]
        text = F.when(F.col("c") % len(forms) == i, F.concat(*parts)).otherwise(text)
    name = F.col("c").cast("string")
    return lim.select(name.alias("file"), F.concat(
        F.lit("PROGRAM P"), name, F.lit("\nCASE S OF "), text, F.lit(" END_CASE;\nEND_PROGRAM")).alias("text"))


LOW, HIGH = "'L' || los || ' < ' || " + NUM.format(q="loq"), "'H' || his || ' > ' || " + NUM.format(q="hiq")


@query("fsm_extract_shapes", f"""WITH {CT}, lim AS (SELECT c, c % 6 AS k, {LOW} AS low, {HIGH} AS high FROM ct), v(k, case_var, frm, "to", cond) AS (VALUES
  (0, 'T', '1', '2', 'low'), (0, 'S', '0', '1', 'high'), (1, 'S', '0', '1', 'low'), (1, 'S', '1', '0', 'high'), (2, 'S', '0', '1', 'TON1.Q'),
  (2, 'S', '1', '0', 'high'), (3, 'S', 'IDLE', 'RUN', 'low'), (3, 'S', 'RUN', 'IDLE', 'high'), (3, 'S', 'HOLD', 'IDLE', 'high'),
  (4, 'S', '0', '1', 'low'), (4, 'S', '1', '0', 'mode = ''off;'''), (5, 'S', '0', '1', 'low'), (5, 'S', '0', '2', '(high) AND NOT (low)'),
  (5, 'S', '0', '3', 'NOT (low) AND NOT (high)'))
SELECT CAST(c AS VARCHAR) AS file, case_var, frm, "to", replace(replace(cond, 'low', low), 'high', high) AS condition FROM lim JOIN v USING (k)""")
def fsm_extract_shapes(spark, d):
    return programs.automata(programs.statements(shapes(spark, d)))[1].select("file", "case_var", "frm", "to", "condition")


@query("st_statement_shapes", f"""WITH {CT}, v(k, kind, n, deepest) AS (VALUES
  (0, 'program', 1, 0), (0, 'case', 2, 3), (0, 'label', 3, 4), (0, 'if', 3, 5), (0, 'else', 1, 4), (0, 'assign', 5, 6),
  (1, 'program', 1, 0), (1, 'case', 1, 1), (1, 'label', 2, 2), (1, 'loop', 2, 3), (1, 'if', 2, 4), (1, 'assign', 3, 5),
  (2, 'program', 1, 0), (2, 'case', 1, 1), (2, 'label', 2, 2), (2, 'call', 2, 3), (2, 'if', 2, 3), (2, 'assign', 2, 4),
  (3, 'program', 1, 0), (3, 'case', 1, 1), (3, 'label', 2, 2), (3, 'if', 2, 3), (3, 'assign', 2, 4),
  (4, 'program', 1, 0), (4, 'case', 1, 1), (4, 'label', 2, 2), (4, 'if', 2, 3), (4, 'assign', 3, 4),
  (5, 'program', 1, 0), (5, 'case', 1, 1), (5, 'label', 4, 2), (5, 'if', 1, 3), (5, 'elsif', 1, 3), (5, 'else', 1, 3), (5, 'assign', 6, 4))
SELECT CAST(c AS VARCHAR) AS file, kind, n::BIGINT AS n, deepest::BIGINT AS deepest FROM ct JOIN v ON v.k = c % 6""")
def st_statement_shapes(spark, d):
    s = programs.statements(shapes(spark, d))
    return s.groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"))


@query("def_use_edges", f"""WITH {CT} SELECT CAST(c AS VARCHAR) AS file, '1' AS state, 'lvl' AS var, v.k AS reader FROM ct, (VALUES ('if'), ('elsif')) v(k)""")
def def_use_edges(spark, d):
    dep = cut_lineage(programs.dependence_nodes(nodes(spark, d)))
    e = programs.data_edges(dep)
    kinds = dep.select("file", "program", "case_var", "state", F.col("node").alias("to"), F.col("kind").alias("reader"))
    return e.join(kinds, ["file", "program", "case_var", "state", "to"]).select("file", "state", "var", "reader")


def found_templates(spark, d):
    # what is asked for below, read from the programs once
    n = cut_lineage(nodes(spark, d).filter("kind IN ('declare', 'assign') OR cond IS NOT NULL"))
    dep, var = cut_lineage(programs.dependence_nodes(n)), cut_lineage(programs.variables(n))
    acts = dep.filter("kind = 'assign' AND writes IN ('PU', 'Alarm')")
    return programs.templates(dep, var, programs.influences(dep, acts))


TEMPLATES = f"""WITH {CT}, tp AS (
  SELECT c, 'state' AS type, '0' AS state, 'Alarm' AS var, 'FALSE' AS dest, 'In State 0, Alarm = FALSE' AS structure FROM ct
  UNION ALL SELECT c, 'inter', '0', 'PU_State', '1', 'IF (L' || los || ' < ' || {LO} || ') THEN PU_State := 1' FROM ct
  UNION ALL SELECT c, 'inter', '1', 'PU_State', '0', 'IF (lvl > hi_limit) AND (' || {ND} || ') THEN PU_State := 0' FROM ct
  UNION ALL SELECT c, 'inter', '1', 'PU_State', '2', 'IF ((lvl < 0) AND NOT (lvl > hi_limit)) THEN PU_State := 2' FROM ct
  UNION ALL SELECT c, 'inter', s, 'PU_State', '0', 'IF (NOT (lvl > hi_limit)) THEN PU_State := 0' FROM ct, (VALUES ('2'), ('3'), ('4')) k(s)
  UNION ALL SELECT c, 'multi', s, 'Alarm', 'TRUE', 'IF lvl > hi_limit THEN Alarm := TRUE' FROM ct, (VALUES ('2'), ('3'), ('4')) k(s)
  UNION ALL SELECT c, 'single', '1', 'L' || los, 'FALSE', 'IF L' || los || ' >= [#] THEN PU = FALSE' FROM ct
  UNION ALL SELECT c, 'single', '1', 'H' || his, 'FALSE', 'IF H' || his || ' = [#] THEN PU = FALSE' FROM ct
  UNION ALL SELECT c, 'multi', '1', 'PU', 'FALSE', 'IF ' || {ND} || ' THEN PU := FALSE' FROM ct)"""


@query("template_filter", f"""{TEMPLATES} SELECT CAST(c AS VARCHAR) AS file, type, state, var, dest, structure FROM tp""")
def template_filter(spark, d):
    return found_templates(spark, d).select("file", "type", "state", "var", "dest", "structure")


@query("count_by_type", f"""{TEMPLATES} SELECT type, count(*) AS n FROM tp GROUP BY type""")
def count_by_type(spark, d):
    return found_templates(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("canonical_name", """SELECT p_partkey, trim(regexp_replace(lower(trim('  ' || p_name || ' (#' || p_brand || ') ' || p_type || '! ')), '[^0-9a-z]+', '_', 'g'), '_') AS name FROM part""")
def canonical_name(spark, d):
    raw = F.concat(F.lit("  "), "p_name", F.lit(" (#"), "p_brand", F.lit(") "), "p_type", F.lit("! "))
    return table(spark, d, "part").select("p_partkey", naming.canonical_name(raw).alias("name"))


@query("iec_ident", f"SELECT s_suppkey, {IDENT.format(s='s_suppkey')} AS ident FROM supplier")
def iec_ident(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", naming.iec_ident(tank("s_suppkey")).alias("ident"))


PREFIXES = ("t", "l_t", "s_pu", "pump_", "p7", "p_j", "f_pu", "n", "x_", "t_pu")


@query("role_by_prefix", f"""WITH x AS (SELECT p_partkey, [{', '.join(f"'{p}'" for p in PREFIXES)}][p_size % 10 + 1] || replace(p_name, ' ', '_') AS n FROM part)
SELECT p_partkey, n AS name, list_filter([CASE WHEN (n LIKE 't%' OR starts_with(n, 'l_t')) AND NOT contains(n, '_pu') THEN 'tank' END,
  CASE WHEN (starts_with(n, 's_pu') OR starts_with(n, 'pump_') OR starts_with(n, 'p7') OR starts_with(n, 'p8')) AND NOT starts_with(n, 'p_j') THEN 'pump_status' END,
  CASE WHEN starts_with(n, 'f_p') THEN 'pump_flow' END, CASE WHEN starts_with(n, 'p_j') OR starts_with(n, 'n') THEN 'junction' END], lambda r: r IS NOT NULL) AS roles FROM x""")
def role_by_prefix(spark, d):
    prefix = F.array(*[F.lit(p) for p in PREFIXES])[F.col("p_size") % 10]
    n = table(spark, d, "part").select("p_partkey", F.concat(prefix, F.translate("p_name", " ", "_")).alias("name"))
    return n.select("p_partkey", "name", naming.roles(F.col("name")).alias("roles"))


SUFFIXES = ("_sensor", "_command", "_target", "_limit", "_pump", "_x", "_level", "_StartUp", "tol", "_input_a")


@query("classify_variable", f"""WITH x AS (SELECT p_partkey, ['input','output','var'][p_partkey % 3 + 1] AS scope,
  replace(p_name, ' ', '_') || [{', '.join(f"'{s}'" for s in SUFFIXES)}][p_size % 10 + 1] AS name FROM part),
y AS (SELECT *, lower(name) AS n FROM x), z AS (SELECT *, regexp_matches(n, '(target|level$|threshold$|offset|limit$|setpoint$|tolerance$|tol$)') AS cf,
  regexp_matches(n, '(sensor|input|^l_|level$|position$|_actual|reading$|detected$)') AS se,
  regexp_matches(n, '(^s_|actuator|command$|output$|_start|motor$|valve$|pump$)') AS ac FROM y)
SELECT p_partkey, CASE WHEN scope = 'input' THEN CASE WHEN cf THEN 'configuration' ELSE 'sensing' END WHEN scope = 'output' THEN 'actuation'
  WHEN se THEN 'sensing' WHEN ac THEN 'actuation' WHEN cf THEN 'configuration' ELSE 'internal' END AS role FROM z""")
def classify_variable(spark, d):
    p = table(spark, d, "part").select(
        "p_partkey", F.array(F.lit("input"), F.lit("output"), F.lit("var"))[F.col("p_partkey") % 3].alias("scope"),
        F.concat(F.translate("p_name", " ", "_"), F.array(*[F.lit(s) for s in SUFFIXES])[F.col("p_size") % 10]).alias("name"))
    return p.select("p_partkey", naming.classify_variable(F.col("name"), F.col("scope")).alias("role"))


OPS = ("<=", ">=", "<>", "=", "<", ">")


@query("parse_condition", f"""SELECT event_id, event_type AS var, [{', '.join(f"'{o}'" for o in OPS)}][event_id % 6 + 1] AS op, CAST(value AS VARCHAR) AS val FROM events""")
def parse_condition(spark, d):
    op = F.array(*[F.lit(o) for o in OPS])[(F.col("event_id") % 6).cast("int")]
    text = F.concat(F.lit("("), "event_type", F.lit(" "), op, F.lit(" ("), F.col("value").cast("string"), F.lit("))"))
    return table(spark, d, "events").select("event_id", guards.parse_condition(text).alias("c")).select("event_id", "c.*")


@query("assignment_extract", """SELECT event_id, CAST(value AS VARCHAR) AS assigned, 'k > ' || CAST(value AS VARCHAR) AS condition FROM events""")
def assignment_extract(spark, d):
    v = F.col("value").cast("string")
    e = table(spark, d, "events").select(
        "event_id", F.concat("event_type", F.lit("  :=  "), v, F.lit("; rest")).alias("stmt"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "IF ").otherwise("ELSIF "), F.lit("k > "), v).alias("cond"))
    return e.select("event_id", naming.assigned_value(F.col("stmt")).alias("assigned"),
                    naming.condition_text(F.col("cond")).alias("condition"))


@query("resolve_column_chain", """SELECT event_id, CASE event_type WHEN 'click' THEN 'l_click' WHEN 'view' THEN 's_view' ELSE event_type END AS col FROM events""")
def resolve_column_chain(spark, d):
    cmap = F.create_map(*[F.lit(x) for x in ("CLICK", "l_click", "S_VIEW", "s_view", "S_CLICK", "wrong")])
    case = F.concat(F.initcap("event_type"), F.lit("_State"))
    return table(spark, d, "events").select("event_id", naming.resolve_column(case, cmap).alias("col"))


@query("manifest_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def manifest_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
