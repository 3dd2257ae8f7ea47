"""Interval rules (antecedent => consequent) as column expressions.

NaN contract: an ``in`` atom holds on a missing value, every other operator fails on it.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules kept as data have this type; `lo`/`hi` are used by `in`, `lo` alone by the rest.
RULES_TYPE = ("array<struct<id:string,"
              "antecedent:array<struct<col:string,op:string,lo:double,hi:double>>,"
              "consequent:array<struct<col:string,op:string,lo:double,hi:double>>>>")


def number(c: Column) -> Column:
    """Double with NaN turned into NULL, so that comparisons are unknown, not true."""
    v = c.cast("double")
    return F.when(~F.isnan(v), v)


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def atom(a: dict[str, Any], columns: Iterable[str]) -> Column:
    """One atom ``{col, op, val}``; a missing column or unknown operator never holds."""
    if a["col"] not in set(columns):
        return F.lit(False)
    v, op, val = number(F.col(a["col"])), a["op"], a["val"]
    if op == "in":
        lo, hi = val if isinstance(val, (list, tuple)) and len(val) == 2 else (None, None)
        ok = F.lit(True)
        if lo is not None:
            ok = ok & ~_known(v < F.lit(lo))
        if hi is not None:
            ok = ok & ~_known(v > F.lit(hi))
        return ok
    compare = {"==": v == F.lit(val), ">=": v >= F.lit(val), "<=": v <= F.lit(val),
               ">": v > F.lit(val), "<": v < F.lit(val)}
    return _known(compare[op]) if op in compare else F.lit(False)


def all_hold(atoms: list[dict[str, Any]], columns: Iterable[str]) -> Column:
    columns = set(columns)
    return reduce(lambda x, y: x & y, [atom(a, columns) for a in atoms], F.lit(True))


def violation_count(rules: list[dict[str, Any]], columns: Iterable[str]) -> Column:
    """How many rules have their antecedent but not their consequent on this row."""
    columns = set(columns)
    broken = [(all_hold(r.get("antecedent", []), columns)
               & ~all_hold(r.get("consequent", []), columns)).cast("int") for r in rules]
    return reduce(lambda x, y: x + y, broken, F.lit(0))


def values_map(columns: Iterable[str]) -> Column:
    """map<column, value> of a row, for rules that arrive as data."""
    pairs = [x for c in columns for x in (F.lit(c), number(F.col(c)))]
    return F.create_map(*pairs).cast("map<string,double>")


def violation_count_data(rules: Column, values: Column) -> Column:
    """Same count for a rules column of ``RULES_TYPE`` (NULL or empty rules give 0)."""
    def holds(a: Column) -> Column:
        v, lo, hi, op = (F.try_element_at(values, a["col"]), a["lo"], a["hi"], a["op"])
        inside = ~_known(v < lo) & ~_known(v > hi)
        rest = (F.when(op == "==", v == lo).when(op == ">=", v >= lo).when(op == "<=", v <= lo)
                .when(op == ">", v > lo).when(op == "<", v < lo))
        return F.array_contains(F.map_keys(values), a["col"]) & F.when(
            op == "in", inside).otherwise(_known(rest))

    broken = F.filter(rules, lambda r: F.forall(r["antecedent"], holds)
                      & ~F.forall(r["consequent"], holds))
    return F.coalesce(F.size(broken), F.lit(0))
