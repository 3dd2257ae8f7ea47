"""Temporal-logic formulas: synthesis from calibrated limits and quantitative robustness.

Formulas are pointwise (comparisons under and/or/not), so each becomes one DOUBLE column:
``a <= b`` is ``b - a``, conjunction the minimum, disjunction the maximum. The text is read
with Python's own expression grammar; anything it cannot express is inert (robustness 0).
"""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profiles import MARGIN, Network
from .rules import number


def _margin(op: ast.cmpop, a: Column, b: Column) -> Column:
    if isinstance(op, (ast.LtE, ast.Lt)):
        return b - a
    if isinstance(op, (ast.GtE, ast.Gt)):
        return a - b
    raise ValueError("unsupported comparison")


def _build(node: ast.AST, columns: set[str], used: set[str]) -> Column:
    match node:
        case ast.BoolOp(op=op, values=values):
            parts = [_build(v, columns, used) for v in values]
            return F.least(*parts) if isinstance(op, ast.And) else F.greatest(*parts)
        case ast.Compare(left=left, ops=ops, comparators=rest):
            sides = [_build(x, columns, used) for x in (left, *rest)]
            margins = [_margin(o, a, b) for o, a, b in zip(ops, sides, sides[1:], strict=False)]
            return margins[0] if len(margins) == 1 else F.least(*margins)
        case ast.UnaryOp(op=ast.Not() | ast.USub(), operand=x):
            return -_build(x, columns, used)
        case ast.Call(func=ast.Name(id="abs"), args=[x]):
            return F.abs(_build(x, columns, used))
        case ast.BinOp(left=a, op=ast.Sub(), right=b):
            return _build(a, columns, used) - _build(b, columns, used)
        case ast.BinOp(left=a, op=ast.Add(), right=b):
            return _build(a, columns, used) + _build(b, columns, used)
        case ast.BinOp(left=a, op=ast.Mult(), right=b):
            return _build(a, columns, used) * _build(b, columns, used)
        case ast.Constant(value=int() | float() as v):
            return F.lit(float(v))
        case ast.Name(id=name) if name in columns:
            used.add(name)
            return number(F.col(name))
    raise ValueError("unsupported formula")


def robustness(formula: str, columns: Iterable[str]) -> Column:
    """Robustness of a formula over the named columns; NULL where an input is missing."""
    used: set[str] = set()
    try:
        value = _build(ast.parse(formula.strip(), mode="eval").body, set(columns), used)
    except (SyntaxError, ValueError):
        return F.lit(0.0)
    for name in sorted(used):
        value = F.when(number(F.col(name)).isNotNull(), value)
    return value


def fires(formula: str, columns: Iterable[str]) -> Column:
    """1 where the formula is strictly violated; the boundary and missing values never fire."""
    return F.coalesce((robustness(formula, columns) < 0).cast("int"), F.lit(0))


def fire_count(specs: dict[str, str], columns: Iterable[str]) -> Column:
    columns = set(columns)
    total = F.lit(0)
    for name in sorted(specs):
        total = total + fires(specs[name], columns)
    return total


def min_robustness(specs: dict[str, str], columns: Iterable[str]) -> Column:
    """struct<rob, name> of the smallest robustness; ties go to the first name."""
    columns = set(columns)
    return F.least(*[F.struct(robustness(f, columns).alias("rob"), F.lit(n).alias("name"))
                     for n, f in sorted(specs.items())])


class Family(NamedTuple):
    """A kind of formula: its rule's name and its text, both filled from one unit's values."""

    name: str
    formula: str
    mode: str | None = None


_SLEW = "abs(d{unit}) <= {slew_max:.4f}"
_FLOW_BAND = "{flow} >= {f_on_min:.4f} and {flow} <= {f_on_max:.4f}"
_FLOW_WHEN_ON = "({status} <= 0.5) or (" + _FLOW_BAND + ")"
_FLOW_WHEN_OFF = "({status} > 0.5) or (abs({flow}) <= {f_off_max:.4f})"

# Name and text of every formula, by the section of the parameters that fills them.
FAMILIES = {
    "mb": [Family("MB_{unit}", "abs(MB_RESID_{unit}) <= {eps:.6f}")],
    "mb_window": [Family("MBW_{unit}", "abs(MB_ROLL_{unit}) <= {eps:.6f}")],
    "tank": [Family("PHYS_{unit}", "{unit} >= {low:.4f} and {unit} <= {top:.4f}"),
             Family("RANGE_{unit}", "{unit} >= {h_min:.4f} and {unit} <= {h_max:.4f}"),
             Family("SLEW_{unit}", _SLEW)],
    "pump": [Family("PUMP_BINARY_{unit}", "({status} >= -0.1) and ({status} <= 1.1)", "status_only"),
             Family("PUMP_DORMANT_{unit}", "{status} <= 0.5 and abs({flow}) <= {f_off_max:.4f}", "always_off"),
             Family("PUMP_ACTIVE_{unit}", "{status} > 0.5 and " + _FLOW_BAND, "always_on"),
             Family("PUMP_ON_{unit}", _FLOW_WHEN_ON, "varying"),
             Family("PUMP_OFF_{unit}", _FLOW_WHEN_OFF, "varying")],
    "valve": [Family("VALVE_ON_{unit}", _FLOW_WHEN_ON), Family("VALVE_OFF_{unit}", _FLOW_WHEN_OFF)],
    "control": [Family("CTRL_HI_{unit}", "({tank} <= {high:.4f}) or ({status} <= 0.5)"),
                Family("CTRL_LO_{unit}", "({tank} >= {low:.4f}) or ({status} > 0.5)")],
    "symmetry": [Family("SYMM_{unit}", "abs({col1} - {col2}) <= {threshold:.4f}")],
    "head": [Family("HEAD_PU{unit}", "({status} <= 0.5) or (HEAD_PU{unit} >= {h_min:.4f} and HEAD_PU{unit} <= {h_max:.4f})")],
    "pressure": [Family("PRESSURE_{unit}", "{unit} >= {p_min:.4f} and {unit} <= {p_max:.4f}")],
    "pslew": [Family("PSLEW_{unit}", _SLEW)],
}
MODES = ("status_only", "always_off", "always_on")


def units(profile: Network, params: dict[str, Any]) -> Iterator[tuple[str, dict[str, Any]]]:
    """The calibrated parameters as a flat table: (section, values of one unit)."""
    derived = dict(params)
    derived["mb_window"] = {f"{tank}_{w}": v for tank, by in params["mb_window"].items() for w, v in by.items()}
    derived["control"] = {f"{c.status}_{c.tank}": {"status": c.status, "tank": c.tank, "low": c.low - MARGIN, "high": c.high + MARGIN}
                          for c in profile.controls}
    for section in FAMILIES:
        for unit, fitted in derived[section].items():
            values = {"unit": unit, **fitted}
            if section == "tank":
                values["low"], values["top"] = profile.bounds(unit)
            if section in ("pump", "head"):
                values["status"], values["flow"] = profile.pump(unit).status, profile.pump(unit).flow
            if section == "pump" and values["mode"] not in MODES:
                values["mode"] = "varying"
            yield section, values


def synthesize(profile: Network, p: dict[str, Any]) -> dict[str, str]:
    """Formula text per rule name: every family of a section filled with each of its units."""
    return {f.name.format(**values): f.formula.format(**values)
            for section, values in units(profile, p) for f in FAMILIES[section]
            if f.mode in (None, values.get("mode"))}
