"""Transition guards as data: array<array<struct<var,op,val>>> (OR of ANDs).

``[[]]`` is TRUE, ``[]`` is unsatisfiable. Text is turned into that form by a small Arrow
UDF; everything after that is built-in higher-order functions.
"""

from __future__ import annotations

import re
from itertools import product
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship the guard reader with the task, so workers need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COND_TYPE = "struct<var:string,op:string,val:string>"
DNF_TYPE = f"array<array<{COND_TYPE}>>"

# Comparison operators in search order, and their negations.
OPERATORS = ("<=", ">=", "<>", "=", "<", ">")
NEGATED = {"=": "<>", "<>": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def parse_condition(text: Column) -> Column:
    """struct<var,op,val> of an atomic condition; NULL when it has no operator."""
    t = F.trim(text)
    t = F.when(t.startswith("(") & t.endswith(")"), t.substr(F.lit(2), F.length(t) - 2)).otherwise(t)
    op = F.coalesce(*[F.when(t.contains(o), o) for o in OPERATORS])
    at = F.position(op, t)
    val = F.trim(t.substr(at + F.length(op), F.length(t)))
    val = F.when(val.startswith("(") & val.endswith(")"),
                 F.trim(val.substr(F.lit(2), F.length(val) - 2))).otherwise(val)
    return F.when(op.isNotNull(), F.struct(
        F.trim(t.substr(F.lit(1), at - 1)).alias("var"), op.alias("op"), val.alias("val")))


def negated(op: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in NEGATED.items() for x in pair])
    return F.coalesce(F.try_element_at(table, op), F.lit("="))


# What a guard is made of; based numbers and time literals are one number.
_TOKEN = re.compile(
    r"\s*(?:(?P<number>\d+#\w+|(?:TIME_OF_DAY|TOD|DATE_AND_TIME|DT|DATE|D|TIME|T)#[\w.:+-]+|\d+\.?\d*(?:E[+-]?\d+)?)"
    r"|(?P<name>[A-Z_%][\w.%^]*(?:\[[^\]]*\])?)|(?P<string>'[^']*')|(?P<sign><=|>=|<>|\*\*|[-+*/&=<>(),]))", re.I)


class Unreadable(ValueError):
    """A guard whose structure is not that of a Boolean expression."""


def _tokens(text: str) -> list[tuple[str, int, int]]:
    """(word in upper case, start, stop) of every token of a guard."""
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise Unreadable(text)
        out.append((m.group(m.lastgroup).upper(), m.start(m.lastgroup), m.end()))
        at = m.end()
    return out


def _dnf(text: str, tokens: list[tuple[str, int, int]], neg: bool) -> list[list[tuple[str, str, str]]]:
    """Terms of a token run: it is split at its loosest connective outside brackets, a negation is
    carried down, and what is left is a comparison, a truth value or a Boolean variable."""
    depth, depths = 0, []
    for word, _, _ in tokens:
        depth -= word == ")"
        depths.append(depth)
        depth += word == "("
        if depth < 0:
            raise Unreadable(text)
    if depth or not tokens:
        raise Unreadable(text)
    top = [i for i, d in enumerate(depths) if d == 0]

    def split(words: tuple[str, ...]) -> list[list[tuple[str, int, int]]]:
        cuts = [-1, *(i for i in top if tokens[i][0] in words), len(tokens)]
        return [tokens[x + 1:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    for words, any_of in ((("OR",), True), (("XOR",), None), (("AND", "&"), False)):
        parts = split(words)
        if len(parts) == 1:
            continue
        if any_of is None:  # a XOR b: one of them without the other
            first, rest = parts[0], tokens[len(parts[0]) + 1:]
            ways = [(False, not neg), (True, neg)]
            return [x + y for p, q in ways for x in _dnf(text, first, p) for y in _dnf(text, rest, q)]
        each = [_dnf(text, p, neg) for p in parts]
        if any_of != neg:
            return [term for p in each for term in p]
        return [sum(terms, []) for terms in product(*each)]
    if tokens[0][0] == "NOT":
        return _dnf(text, tokens[1:], not neg)
    signs = [i for i in top if tokens[i][0] in NEGATED]
    if len(signs) == 1 and signs[0]:  # a side that is missing stays empty
        i = signs[0]
        left, right = (text[t[0][1]:t[-1][2]] if t else "" for t in (tokens[:i], tokens[i + 1:]))
        op = tokens[i][0]
        return [[(left, NEGATED[op] if neg else op, right)]]
    if not signs and tokens[0][0] == "(" and top == [0, len(tokens) - 1]:
        return _dnf(text, tokens[1:-1], neg)
    if len(tokens) == 1 and tokens[0][0] in ("TRUE", "FALSE"):
        return [[]] if (tokens[0][0] == "TRUE") != neg else []
    if not signs and (tokens[0][0][0].isalpha() or tokens[0][0][0] in "_%"):
        return [[(text[tokens[0][1]:tokens[-1][2]], "=", "FALSE" if neg else "TRUE")]]
    raise Unreadable(text)


def guard_terms(text: str | None) -> list[list[dict[str, str]]]:
    """Disjunctive form of a guard. A guard that cannot be read is one Boolean condition named by its
    whole text, so nothing is dropped and nothing is concluded from it."""
    if not text or not text.strip() or text == "No Check":
        return [[]]
    try:
        terms = _dnf(text, _tokens(text), False)
    except Unreadable:
        terms = [[(text.strip(), "=", "TRUE")]]
    kept = dict.fromkeys(tuple(dict.fromkeys(t)) for t in terms)
    return [[dict(zip(("var", "op", "val"), c, strict=True)) for c in t] for t in kept]


_COND = T.StructType([T.StructField(f, T.StringType()) for f in ("var", "op", "val")])


@F.pandas_udf(T.ArrayType(T.ArrayType(_COND)))
def guard_to_dnf(text: pd.Series) -> pd.Series:
    read = {t: guard_terms(t) for t in text.unique()}  # guards repeat
    return text.map(read.get)


def conjoin(a: Column, b: Column) -> Column:
    """AND of two DNFs, left-major; a NULL side is TRUE, one without terms is FALSE and so is the whole."""
    true = F.array(F.array().cast(f"array<{COND_TYPE}>"))
    a, b = (F.coalesce(x, true) for x in (a, b))
    return F.flatten(F.transform(a, lambda s: F.transform(b, lambda t: F.concat(s, t))))


def _clash(x: Column, y: Column) -> Column:
    """Two conditions on one variable that no value satisfies."""
    a, b = x["val"].try_cast("double"), y["val"].try_cast("double")
    xo, yo = x["op"], y["op"]
    low, high = xo.isin(">", ">="), yo.isin("<", "<=")
    crossed = low & high & ((a > b) | ((a == b) & ~((xo == ">=") & (yo == "<="))))
    below = (xo == "=") & yo.isin(">", ">=") & ((a < b) | ((a == b) & (yo == ">")))
    above = (xo == "=") & yo.isin("<", "<=") & ((a > b) | ((a == b) & (yo == "<")))
    pinned = (xo == "=") & (yo == "=") & (x["val"] != y["val"])
    banned = (xo == "=") & (yo == "<>") & (x["val"] == y["val"])
    return (x["var"] == y["var"]) & F.coalesce(
        pinned | banned | F.coalesce(crossed, F.lit(False)) | F.coalesce(below, F.lit(False))
        | F.coalesce(above, F.lit(False)), F.lit(False))


def term_unsat(term: Column) -> Column:
    return F.exists(term, lambda x: F.exists(term, lambda y: _clash(x, y)))


def unsat(dnf: Column) -> Column:
    """TRUE when every term contradicts itself; an empty DNF is unsatisfiable."""
    return F.forall(dnf, term_unsat)


def guard_text(dnf: Column) -> Column:
    """Canonical text: conditions sorted, repeated terms dropped, ``TRUE`` for an empty term."""
    terms = F.transform(dnf, lambda t: F.when(F.size(t) == 0, "TRUE").otherwise(F.array_join(
        F.transform(F.array_sort(t), lambda c: F.concat_ws(" ", c["var"], c["op"], c["val"])),
        " AND ")))
    return F.array_join(F.array_distinct(terms), " OR ")
