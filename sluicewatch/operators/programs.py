"""Control programs read relationally: statements, tree, automata, dependencies, templates.

A source file is one row of text, and stays one until its statements know what they are in: the text
is cut into an array of statements with one regular expression, a stack is folded over that array,
and only then is it a row a statement. Nothing is shuffled.
"""

from __future__ import annotations

import itertools
import re
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.naming import classify_variable
from ..session import cut_lineage

# Statement forms of code, in the order they are tried, and of declarations.
CODE = (
    r"\b(?:PROGRAM|FUNCTION_BLOCK|FUNCTION)\s+\w+(?:\s*:\s*\w+)?", r"\bEND_(?:PROGRAM|FUNCTION_BLOCK|FUNCTION)\b",
    r"\bEND_(?:CASE|IF|FOR|WHILE)\b", r"\bCASE\b.*?\bOF\b", r"\b(?:IF|ELSIF)\b.*?\bTHEN\b", r"\bELSE\b",
    r"\b(?:FOR|WHILE)\b.*?\bDO\b", r"\bREPEAT\b", r"\bUNTIL\b.*?\bEND_REPEAT\b", r"\b(?:EXIT|RETURN)\b",
    r"\b\w+(?:\s*(?:,|\.\.)\s*\w+)*\s*:(?!=)", r"[A-Za-z_%][\w.\[\]^%]*\s*:=[^;]*;",
    r"[A-Za-z_]\w*\s*\([^;]*\)\s*;")
DECLARATIONS = (
    r"\bEND_VAR\b", r"\bVAR(?:_INPUT|_OUTPUT|_IN_OUT|_GLOBAL|_EXTERNAL|_TEMP)?\b",
    r"[A-Za-z_]\w*(?:\s*,\s*\w+)*\s*:(?!=)[^;]*;")
VAR_BLOCK = r"(?is)\bVAR(?:_\w+)?\b.*?\bEND_VAR\b"
SCOPES = {"VAR_INPUT": "input", "VAR_OUTPUT": "output", "VAR_IN_OUT": "in_out", "VAR_GLOBAL": "global",
          "VAR_EXTERNAL": "external", "VAR_TEMP": "temp"}
# A comment, or a string, in which `$` takes the next character as it is.
APART = r"(?s)\(\*.*?\*\)|\{.*?\}|'(?:[^'$]|\$.)*'|\"(?:[^\"$]|\$.)*\""
# While statements are cut, the characters of a string stand for themselves in a private range.
PLAIN = "".join(map(chr, range(1, 128)))
HIDDEN = "".join(chr(0xE000 + i) for i in range(1, 128))
# Words inside expressions that are not variables.
WORDS = ("AND", "OR", "XOR", "NOT", "MOD", "TRUE", "FALSE")
OPENERS = ("program", "var", "case", "label", "if", "elsif", "else", "loop")


# Ship the fold with the task, so workers need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
_ENTRY = T.StructType([T.StructField("node", T.LongType()), *[T.StructField(f, T.StringType()) for f in ("kind", "stmt", "cond")]])
FILES = 500  # files whose statements make one batch of rows
_BRANCHES = ("if", "elsif", "else")


def without_comments(text: Column) -> Column:
    """Comments become blanks; what stands in strings is hidden from the forms of statements."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(APART), F.lit(0)), lambda x: F.when(
        x.startswith("'") | x.startswith('"'), F.translate(x, PLAIN, HIDDEN)).otherwise(" "))
    return F.array_join(F.zip_with(F.split(text, APART, -1), parts, lambda code, x: F.concat(code, F.coalesce(x, F.lit("")))), "")


def kind_of(stmt: Column) -> Column:
    up = F.upper(stmt)
    return (F.when(up.rlike(r"^END_(PROGRAM|FUNCTION)"), "end_program").when(up.rlike(r"^END_VAR"), "end_var")
            .when(up.rlike(r"^END_CASE"), "end_case").when(up.rlike(r"^END_IF"), "end_if").when(up.rlike(r"^(END_|UNTIL\b)"), "end_loop")
            .when(up.rlike(r"^(PROGRAM|FUNCTION_BLOCK|FUNCTION) "), "program").when(up.rlike(r"^VAR(_\w+)?$"), "var")
            .when(up.rlike(r"^CASE\b"), "case").when(up.rlike(r"^IF\b"), "if")
            .when(up.rlike(r"^ELSIF\b"), "elsif").when(up == "ELSE", "else")
            .when(up.rlike(r"^(FOR|WHILE|REPEAT)\b"), "loop").when(up.rlike(r":$"), "label")
            .when(up.rlike(r"^(EXIT|RETURN)"), "jump").when(up.rlike(r"^[^:(]+:="), "assign")
            .when(up.rlike(r"^[^:(]+:"), "declare").otherwise("call"))


def folded(kinds: list[str], stmts: list[str]) -> Iterator[tuple[int, str | None, list[int]]]:
    """(node, cond, up) of every statement that is not an end.

    A label ends the one before it, ELSIF and ELSE the branch or label they follow, an END_ all down to what it
    closes. ``cond`` says when a branch of an IF runs: ELSIF and ELSE negate the conditions before them, the ELSE
    of a CASE has none. ``up`` has the nodes of the stack, outermost first.
    """
    stack: list[int] = []
    asked: list[list[str]] = []  # of each branch on the stack, the conditions of its IF so far
    for node, (kind, stmt) in enumerate(zip(kinds, stmts, strict=True)):
        if kind.startswith("end_"):
            closes = _BRANCHES if kind == "end_if" else (kind[4:],)
            at = next((i for i in reversed(range(len(stack))) if kinds[stack[i]] in closes
                       and not (kind == "end_if" and i and kinds[stack[i - 1]] == "case")), None)
            if at is not None:
                del stack[at:], asked[at:]
            continue
        cond, refused = None, []
        if kind in ("if", "elsif"):
            cond = re.search(r"(?is)^(?:IF|ELSIF)\b(.*)\bTHEN$", stmt)
            cond = cond.group(1).strip() if cond else ""
            refused = [cond]
        if kind in ("elsif", "else") and stack and kinds[stack[-1]] in (*_BRANCHES, "label"):
            of_case = len(stack) > 1 and kinds[stack[-2]] == "case"
            before = asked.pop()
            stack.pop()
            if not of_case:
                refused = before + refused
                cond = " AND ".join([f"({c})" for c in [cond] if kind == "elsif"] + [f"NOT ({c})" for c in before])
        if kind == "label" and len(stack) > 1 and kinds[stack[-2]] == "case":
            del stack[-1], asked[-1]
        yield node, cond, list(stack)
        if kind in OPENERS:
            stack.append(node)
            asked.append(refused)


def statements(sources: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """(file, node, kind, stmt, depth, cond, up): statements in order, and what they are in.

    ``cond`` is the condition of a branch of an IF, ``up`` the enclosing openers from the outermost in, as
    (node, kind, stmt, cond) structs, however deep. Comments are passed over, strings kept as they are.
    """
    cut = lambda part, forms: F.regexp_extract_all(
        F.coalesce(part, F.lit("")), F.lit("(?is)" + "|".join(forms)), F.lit(0))
    clean = without_comments(F.coalesce(text, F.lit("")))
    parts = F.zip_with(F.split(clean, VAR_BLOCK), F.regexp_extract_all(clean, F.lit(VAR_BLOCK), F.lit(0)),
                       lambda code, block: F.concat(cut(code, CODE), cut(block, DECLARATIONS)))
    shown = F.transform(F.flatten(parts), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"\s*;$", "")))
    raw = sources.select(key, shown.alias("stmts")).select(
        key, F.transform("stmts", kind_of).alias("kinds"), F.transform("stmts", lambda x: F.translate(x, HIDDEN, PLAIN)).alias("stmts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                some = batch.slice(at, FILES)
                files, nodes, kind_of_row, stmt_of_row, conds, above, ends = [], [], [], [], [], [], [0]
                for i, (kinds, stmts) in enumerate(zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)):
                    row_of = {}  # an opener has a row of its own, before the rows it holds
                    for node, cond, up in folded(kinds, stmts):
                        row_of[node] = len(nodes)
                        files.append(i)
                        nodes.append(node)
                        kind_of_row.append(kinds[node])
                        stmt_of_row.append(stmts[node])
                        conds.append(cond)
                        above += [row_of[n] for n in up]
                        ends.append(len(above))
                entry = [pa.array(nodes, pa.int64()), *[pa.array(x, pa.string()) for x in (kind_of_row, stmt_of_row, conds)]]
                up = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    entry, names=["node", "kind", "stmt", "cond"]).take(pa.array(above, pa.int64())))
                depth = pa.array([b - a for a, b in itertools.pairwise(ends)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(files, pa.int64())), *entry[:3], depth, entry[3], up],
                    names=[key, "node", "kind", "stmt", "depth", "cond", "up"])

    shape = T.StructType([sources.schema[key], T.StructField("node", T.LongType()), T.StructField("kind", T.StringType()),
                          T.StructField("stmt", T.StringType()), T.StructField("depth", T.LongType()), T.StructField("cond", T.StringType()),
                          T.StructField("up", T.ArrayType(_ENTRY))])
    return raw.mapInArrow(run, shape)


def _last(up: Column, kind: str) -> Column:
    return F.try_element_at(F.filter(up, lambda x: x["kind"] == kind), F.lit(-1))


def _word(stmt: Column, pattern: str) -> Column:
    return F.trim(F.regexp_extract(stmt, pattern, 1))


def label_states(stmt: Column) -> Column:
    """The states a label names, one entry each: numbers, ranges of numbers and names."""
    def each(item: Column) -> Column:
        ends = F.split(item, r"\s*\.\.\s*")
        lo, hi = (F.try_element_at(ends, F.lit(i)).try_cast("bigint") for i in (1, 2))
        return F.when(lo.isNotNull() & hi.isNotNull() & (lo <= hi), F.transform(
            F.sequence(lo, F.greatest(lo, hi)), lambda n: n.cast("string"))).otherwise(F.array(F.trim(item)))

    return F.flatten(F.transform(F.split(F.regexp_replace(stmt, r"\s*:$", ""), r"\s*,\s*"), each))


def located(nodes: DataFrame) -> DataFrame:
    """Add program, case_var and state (innermost CASE and its label) of each statement; a statement
    under a label of several states is one row for each."""
    up, case = F.col("up"), F.col("_case")
    # the label right inside the innermost CASE; its ELSE stands under no state
    inside = F.try_element_at(F.filter(up, lambda x: x["node"] > case["node"]), F.lit(1))
    states = F.coalesce(label_states(F.when(F.col("_inside.kind") == "label", F.col("_inside.stmt"))), F.array(F.lit("")))
    # each on the one before, so the CASE is not looked for again for every opener
    return nodes.withColumn("_case", _last(up, "case")).withColumn("_inside", inside).select(
        *nodes.columns, _word(F.coalesce(_last(up, "program")["stmt"], F.lit("")), r"(?i)^\w+ (\w+)").alias("program"),
        _word(case["stmt"], r"(?i)^CASE (.*) OF$").alias("case_var"), F.explode(states).alias("state"))


def identifiers(text: Column) -> Column:
    """Sorted distinct variable names in an expression; what stands in strings is none."""
    text = F.regexp_replace(text, r"'(?:[^'$]|\$.)*'", "''")
    names = F.regexp_extract_all(text, F.lit(r"[A-Za-z_]\w*"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: ~F.upper(n).isin(*WORDS))))


def variables(nodes: DataFrame, key: str = "file") -> DataFrame:
    """(file, program, scope, name, type, init, role) of the declarations."""
    d = located(nodes.filter("kind = 'declare'"))
    section = F.upper(_last(F.col("up"), "var")["stmt"])
    scope = F.lit("var")
    for word, name in SCOPES.items():
        scope = F.when(section == word, name).otherwise(scope)
    body = F.trim(F.regexp_replace("stmt", r"^[^:]*:", ""))
    v = d.select(key, "program", scope.alias("scope"),
                 F.explode(F.split(F.regexp_extract("stmt", r"^([^:]*):", 1), ",")).alias("name"),
                 _word(body, r"^([^:]*)").alias("type"), F.nullif(_word(body, r":=(.*)$"), F.lit("")).alias("init"))
    return v.withColumn("name", F.trim("name")).withColumn(
        "role", classify_variable(F.col("name"), F.col("scope")))


def assigned(stmt: Column) -> tuple[Column, Column]:
    return _word(stmt, r"^([^:]*):="), _word(stmt, r":=(.*)$")


def automata(nodes: DataFrame, key: str = "file") -> tuple[DataFrame, DataFrame]:
    """States (file, program, case_var, node, ord) and transitions of every CASE.

    A transition is an assignment of a number or of a label's name to the CASE variable under a
    branch of an IF. An outer IF
    claims the assignments of the IFs inside it too. Targets that no label names become
    states after the labelled ones.
    """
    on = [key, "program", "case_var"]
    nodes = cut_lineage(nodes.filter("kind = 'label' OR kind = 'assign'"))  # read once, used four times
    labels = nodes.filter("kind = 'label'")
    lab = located(labels).select(*on, F.explode(label_states(F.col("stmt"))).alias("of"), F.col("node").alias("ord"))
    lab = lab.select(*on, F.col("of").alias("node"), F.struct(F.lit(0).alias("late"), "ord").alias("ord"))
    lhs, rhs = assigned(F.col("stmt"))
    a = located(nodes.filter("kind = 'assign'")).withColumn("lhs", lhs).withColumn("rhs", rhs)
    a = a.filter((F.col("lhs") == F.col("case_var")) & (F.col("state") != "") & F.col("rhs").rlike(r"^\w+$"))
    is_number = F.col("rhs").rlike(r"^(\d+|TRUE|FALSE)$")
    named = lab.select(*on, F.col("node").alias("rhs")).distinct()
    a = a.filter(is_number).unionByName(a.filter(~is_number).join(named, [*on, "rhs"], "left_semi"))
    ifs = F.filter("up", lambda x: x["kind"].isin("if", "elsif", "else") & (x["node"] > F.col("case_at")) & x["cond"].isNotNull())
    t = a.withColumn("case_at", _last(F.col("up"), "case")["node"]).select(*on, F.col("state").alias("frm"), F.col("rhs").alias("to"),
                 F.col("node").alias("at"), F.posexplode(ifs).alias("nest", "i"))
    moves = t.select(*on, "frm", "to", F.coalesce(F.nullif(F.col("i.cond"), F.lit("")),
                                                  F.lit("No Check")).alias("condition"),
                     F.col("i.node").alias("if_node"), F.col("at").alias("ord"))
    late = moves.select(*on, F.col("to").alias("node"), F.struct(F.lit(1).alias("late"), "ord").alias("ord"))
    states = lab.unionByName(late).groupBy(*on, "node").agg(F.min("ord").alias("ord"))
    return states, moves


def dependence_nodes(nodes: DataFrame, key: str = "file") -> DataFrame:
    """Assignments and conditions inside CASE elements: reads, writes, innermost controlling
    condition and the whole guard, outermost condition first."""
    n = located(nodes.filter("kind = 'assign' OR cond IS NOT NULL")).filter("state <> ''")
    lhs, rhs = assigned(F.col("stmt"))
    is_assign = F.col("kind") == "assign"
    conds = F.col("conds")
    n = n.withColumn("case_at", _last(F.col("up"), "case")["node"]).withColumn(
        "conds", F.filter("up", lambda x: x["cond"].isNotNull() & (x["node"] > F.col("case_at"))))
    return n.select(
        key, "program", "case_var", "state", "node", "kind", "stmt",
        F.when(is_assign, F.nullif(F.regexp_extract(lhs, r"^(\w+)", 1), F.lit(""))).alias("writes"),
        identifiers(F.when(is_assign, rhs).otherwise(F.col("cond"))).alias("reads"), "cond",
        F.try_element_at(conds, F.lit(-1))["node"].alias("control"),
        F.when(F.size(conds) == 0, "TRUE").otherwise(F.array_join(F.transform(conds, lambda x: F.concat(
            F.lit("("), x["cond"], F.lit(")"))), " AND ")).alias("guard"))


def data_edges(dep: DataFrame, key: str = "file") -> DataFrame:
    """(.., frm, to, var): the latest earlier writer of each variable a node reads."""
    on = [key, "program", "case_var", "state"]
    reads = dep.select(*on, "node", F.explode("reads").alias("var"), F.lit(None).cast("long").alias("writer"))
    writes = dep.filter("writes IS NOT NULL").select(
        *on, "node", F.col("writes").alias("var"), F.col("node").alias("writer"))
    w = Window.partitionBy(*on, "var").orderBy("node").rangeBetween(Window.unboundedPreceding, -1)
    seen = reads.unionByName(writes).withColumn("frm", F.last("writer", ignorenulls=True).over(w))
    return seen.filter("writer IS NULL AND frm IS NOT NULL").select(
        *on, "frm", F.col("node").alias("to"), "var")


def control_edges(dep: DataFrame, key: str = "file") -> DataFrame:
    return dep.filter("control IS NOT NULL").select(
        key, "program", "case_var", "state", F.col("control").alias("frm"), F.col("node").alias("to"))


def operator_for(cond: str, var: str) -> Column:
    """Comparison operator right of a variable in a condition text, else the one left of it."""
    ops = "(<=|>=|<>|=|<|>)"
    right = F.expr(f"regexp_extract({cond}, concat('\\\\b', {var}, '\\\\b[^<>=]*?{ops}'), 1)")
    left = F.expr(f"regexp_extract({cond}, concat('{ops}[^<>=]*?\\\\b', {var}, '\\\\b'), 1)")
    return F.coalesce(F.nullif(right, F.lit("")), F.nullif(left, F.lit("")))


def templates(dep: DataFrame, variables_: DataFrame, influences: DataFrame | None = None,
              key: str = "file") -> DataFrame:
    """Invariant templates: (.., type, node, var, dest, operator, structure).

    state: unconditional actuation; inter: assignment to the CASE variable under its joined
    conditions; single: a sensing variable in the controlling condition of an actuation;
    multi: (needs ``influences``, one row per actuation node and influencing variable).
    """
    on = [key, "program", "case_var", "state"]
    roles = variables_.select(key, "program", F.col("name").alias("var"), "role").distinct()
    act = dep.filter("kind = 'assign' AND writes IS NOT NULL")
    _, value = assigned(F.col("stmt"))
    act = act.withColumn("value", value)
    on_state = F.col("writes") == F.col("case_var")
    inter = act.filter(on_state).select(
        *on, F.lit("inter").alias("type"), "node", F.col("writes").alias("var"),
        F.col("value").alias("dest"), F.lit(None).cast("string").alias("operator"),
        F.concat(F.lit("IF "), "guard", F.lit(" THEN "), "writes", F.lit(" := "), "value").alias("structure"))
    driven = act.filter(~on_state).join(
        roles.withColumnRenamed("var", "writes").filter("role = 'actuation'").drop("role"),
        [key, "program", "writes"]).drop("cond")
    state = driven.filter("control IS NULL").select(
        *on, F.lit("state").alias("type"), "node", F.col("writes").alias("var"),
        F.col("value").alias("dest"), F.lit("=").alias("operator"),
        F.concat(F.lit("In State "), "state", F.lit(", "), "writes", F.lit(" = "), "value").alias("structure"))
    conds = dep.filter("kind <> 'assign'").select(
        *on, F.col("node").alias("control"), "cond", F.col("reads").alias("creads"))
    under = driven.join(conds, [*on, "control"])
    single = (under.withColumn("var", F.explode("creads"))
              .join(roles.filter("role = 'sensing'").drop("role"), [key, "program", "var"])
              .withColumn("operator", operator_for("cond", "var")).filter("operator IS NOT NULL")
              .select(*on, F.lit("single").alias("type"), "node", "var", F.col("value").alias("dest"), "operator",
                      F.concat(F.lit("IF "), "var", F.lit(" "), "operator", F.lit(" [#] THEN "), "writes",
                               F.lit(" = "), "value").alias("structure")))
    out = state.unionByName(inter).unionByName(single)
    if influences is not None:
        wanted = influences.join(roles.filter(F.col("role").isin("sensing", "configuration")), [
            key, "program", "var"]).select(*on, "node").distinct()
        multi = driven.join(wanted, [*on, "node"], "left_semi").join(
            conds.drop("creads"), [*on, "control"], "left").select(
            *on, F.lit("multi").alias("type"), "node", F.col("writes").alias("var"),
            F.col("value").alias("dest"), F.lit(None).cast("string").alias("operator"),
            F.concat(F.lit("IF "), F.coalesce("cond", F.lit("")), F.lit(" THEN "), "stmt").alias("structure"))
        out = out.unionByName(multi)
    return out


def influences(dep: DataFrame, targets: DataFrame, key: str = "file") -> DataFrame:
    """(.., node, var): variables read by anything a target node depends on, itself included."""
    on = [key, "program", "case_var", "state"]
    edges = cut_lineage(control_edges(dep, key).unionByName(data_edges(dep, key).drop("var")).distinct())
    frontier = cut_lineage(targets.select(*on, "node", F.col("node").alias("at")))
    seen = frontier
    while True:
        found = frontier.withColumnRenamed("at", "to").join(edges, [*on, "to"]).select(
            *on, "node", F.col("frm").alias("at")).distinct()
        frontier = cut_lineage(found.join(seen, [*on, "node", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    reads = dep.select(*on, F.col("node").alias("at"), F.explode("reads").alias("var"))
    return seen.join(reads, [*on, "at"]).select(*on, "node", "var").distinct()
