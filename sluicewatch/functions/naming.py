"""Column expressions for names, roles, states and number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Variable-name patterns per role, tried in this order at the start of the name.
SENSING_PATTERNS = (".*sensor.*", ".*_sensor$", ".*input.*", "^l_.*", ".*level$", ".*position$",
                    ".*_actual.*", ".*reading$", ".*detected$")
ACTUATION_PATTERNS = ("^s_.*", ".*actuator.*", ".*_actuator$", ".*command$", ".*_command$",
                      ".*output$", ".*_start.*", ".*motor$", ".*valve$", ".*pump$")
CONFIGURATION_PATTERNS = (".*target.*", ".*_target$", ".*level$", ".*threshold$", ".*offset$",
                          ".*_offset$", ".*limit$", ".*setpoint$", ".*tolerance$", ".*tol$")


def canonical_name(raw: Column) -> Column:
    """Lower snake case: anything outside [0-9a-z] becomes one underscore, ends trimmed."""
    text = F.regexp_replace(F.lower(F.trim(raw)), "[^0-9a-z]+", "_")
    return F.regexp_replace(text, "^_+|_+$", "")


# Name beginnings per role of a signal, and what a tank's name may not hold.
ROLE_PREFIXES = {
    "tank": ("t", "l_t"),
    "pump_status": ("s_pu", "pump_", "p7", "p8"),
    "pump_flow": ("f_p",),
    "junction": ("p_j", "n"),
}
NO_TANK = "_pu"


def role_pattern(role: str) -> str:
    """The role's prefixes as one regular expression, for columns and for header names alike."""
    tail = rf"(?!.*{NO_TANK})" if role == "tank" else ""
    return f"^{tail}(?:{'|'.join(ROLE_PREFIXES[role])})"


def roles(name: Column) -> Column:
    """Array of the roles a canonical column name carries; roles may overlap."""
    return F.filter(F.array(*[F.when(name.rlike(role_pattern(r)), r) for r in ROLE_PREFIXES]),
                    lambda r: r.isNotNull())


def iec_ident(name: Column) -> Column:
    """Identifiers may not start with a digit."""
    return F.regexp_replace(name, "^([0-9])", "v_$1")


def format_g(x: Column) -> Column:
    """Six significant digits without trailing zeros (5.0 -> 5, 2.4000000001 -> 2.4)."""
    text = F.format_string("%.6g", x.cast("double"))
    text = F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2")
    text = F.regexp_replace(text, r"\.(e|$)", "$1")
    return F.when(x == 0, "0").otherwise(text)


def classify_variable(name: Column, scope: Column) -> Column:
    """sensing / actuation / configuration / internal, by scope first, then by name."""
    def like(patterns: tuple[str, ...]) -> Column:
        return F.lower(name).rlike("^(?:" + "|".join(patterns) + ")")

    return (
        F.when(scope == "input", F.when(like(CONFIGURATION_PATTERNS), "configuration")
               .otherwise("sensing"))
        .when(scope == "output", "actuation")
        .when(like(SENSING_PATTERNS), "sensing")
        .when(like(ACTUATION_PATTERNS), "actuation")
        .when(like(CONFIGURATION_PATTERNS), "configuration")
        .otherwise("internal"))


def composite_state(components: list[tuple[str, str]], columns: list[str]) -> Column:
    """``plc.case:value`` joined by ``|``; raises on a NULL, NaN or infinite state value."""
    parts = []
    for (plc, case), c in zip(components, columns, strict=True):
        v = F.col(c).cast("double")
        bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        value = F.when(bad, F.raise_error(F.lit(
            f"non-finite value in state column {c}; cannot derive composite state")))
        value = value.otherwise(F.col(c).cast("long").cast("string"))
        parts.append(F.concat(F.lit(f"{plc}.{case}:"), value))
    return F.concat_ws("|", *parts)


def state_components(state: Column) -> Column:
    """array<struct<plc,case,sid>>: last ':' peels the id, then the first '.' the PLC."""
    pattern = r"^([^.]*)\.(.*):([^:]*)$"
    return F.transform(F.split(state, r"\|"), lambda seg: F.struct(
        F.when(~seg.rlike(pattern), F.raise_error(F.concat(
            F.lit("malformed state key segment "), seg)).cast("string"))
        .otherwise(F.regexp_extract(seg, pattern, 1)).alias("plc"),
        F.regexp_extract(seg, pattern, 2).alias("case"),
        F.regexp_extract(seg, pattern, 3).alias("sid")))


def resolve_column(case_var: Column, column_map: Column) -> Column:
    """Dataset column of an actuator: map[ACT], else map[S_ACT], else the lower-cased name.

    ``column_map`` has upper-cased keys.
    """
    act = F.regexp_replace(case_var, "_State$", "")
    up = F.upper(act)
    found = F.coalesce(F.nullif(F.try_element_at(column_map, up), F.lit("")),
                       F.nullif(F.try_element_at(column_map, F.concat(F.lit("S_"), up)), F.lit("")),
                       F.nullif(F.lower(act), F.lit("")))
    return F.coalesce(found, F.raise_error(F.concat(
        F.lit("cannot resolve dataset column for "), case_var)).cast("string"))


def formula_vars(formula: Column) -> Column:
    """Sorted distinct identifiers of a formula, reserved words left out."""
    reserved = F.array(*[F.lit(w) for w in (
        "and", "or", "not", "abs", "always", "eventually", "until", "implies")])
    names = F.regexp_extract_all(formula, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    return F.array_sort(F.array_except(names, reserved))


def assigned_value(statement: Column) -> Column:
    """Text after ``:=`` up to ``;``; NULL when there is none."""
    value = F.trim(F.regexp_extract(statement, r":=\s*(.+?)(?:;|$)", 1))
    return F.when(value != "", value)


def condition_text(statement: Column) -> Column:
    """Condition of an IF/ELSIF statement text without the keyword."""
    return F.when(statement.rlike("^(IF|ELSIF) "),
                  F.trim(F.regexp_replace(statement, "^(IF|ELSIF) ", ""))).otherwise(statement)
