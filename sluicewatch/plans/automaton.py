"""From program sources to the global automaton of a topology."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guards import guard_to_dnf
from ..operators import graph, product, programs
from ..session import cut_lineage

FB = ["file", "program", "case_var"]


@dataclass
class Automaton:
    components: list[tuple[str, str]]  # (plc, case variable), in key order
    states: DataFrame  # node, locals
    edges: DataFrame  # frm, to, guard, components
    initial: str
    local_states: DataFrame
    local_moves: DataFrame


def encode(components: list[tuple[str, str]], locals_: str):
    """``plc.case:state`` of each component, joined by ``|``."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{p}.{c}:"), F.col(locals_)[i])
                              for i, (p, c) in enumerate(components)])


def extract(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Local states and moves of every CASE in the sources."""
    nodes = cut_lineage(programs.statements(sources))
    states, moves = programs.automata(nodes)
    return cut_lineage(states), cut_lineage(moves)


def dangling(states: DataFrame, moves: DataFrame) -> DataFrame:
    """(file, program, case_var, side, node) of ends of local moves that name no state of their CASE."""
    return graph.dangling(states, moves.select(*FB, "frm", "to"), FB)


def compose(states: DataFrame, moves: DataFrame, max_states: int | None = None) -> Automaton:
    """Product of all local automata, ordered by (program, case variable)."""
    fbs = states.select(*FB).distinct().orderBy("program", "case_var", "file")
    names = [tuple(r) for r in fbs.collect()]  # one entry per CASE block
    if not names:
        raise ValueError("no function blocks to compose")
    spark = states.sparkSession
    index = spark.createDataFrame([(*n, i) for i, n in enumerate(names)],
                                  "file string, program string, case_var string, comp int")
    components = [(p, c) for _, p, c in names]
    indexed = moves.join(F.broadcast(index), FB)  # one row per CASE block
    options = product.choices(
        states.join(F.broadcast(index), FB).select("comp", "node"),
        indexed.select("comp", "frm", "to", F.concat_ws("_", "frm", "to", F.col("if_node").cast("string"))
                       .alias("tid"), guard_to_dnf("condition").alias("dnf"), "if_node", "ord")
        .withColumn("ord", F.struct("if_node", "ord")), [])
    edges = moves.select(*FB, "frm", "to")
    first = graph.initial_state(states, edges, FB).join(F.broadcast(index), FB)
    start = [r["node"] for r in first.orderBy("comp").select("node").collect()]
    init = spark.createDataFrame([(start,)], "locals array<string>")
    seen, steps = product.product(init, options, [], len(components), max_states)
    named = seen.select(encode(components, "locals").alias("node"), "locals")
    out = steps.select(encode(components, "locals").alias("frm"), encode(components, "nxt").alias("to"),
                       "guard", F.map_from_arrays(
                           F.array(*[F.lit(f"{p}:{c}") for p, c in components]), "tids").alias("components"))
    origin = "|".join(f"{p}.{c}:{s}" for (p, c), s in zip(components, start, strict=True))
    return Automaton(components, named, out, origin, states, moves)


def analysis(a: Automaton) -> dict[str, DataFrame]:
    """Statistics, unreachable states, dead states and cycles of the global automaton."""
    states = a.states.select("node", F.when(F.col("node") == a.initial, 0).otherwise(1).alias("ord"))
    edges = a.edges.select("frm", "to")
    return {"statistics": graph.statistics(states, edges, []),
            "unreachable": graph.unreachable_states(states, edges.distinct(), []),
            "dead": graph.dead_states(states, edges, []),
            "cycles": graph.cycles(states, edges.distinct(), [])}


def plc_status(listed: DataFrame, extracted: DataFrame) -> DataFrame:
    """ok / skipped / error per PLC, from the FSMs listed for it and the blocks found in it.

    ``listed`` (plc, n_listed), ``extracted`` (plc, n_blocks).
    """
    j = listed.join(extracted, "plc", "full")
    found, want = F.coalesce("n_blocks", F.lit(0)), F.coalesce("n_listed", F.lit(0))
    return j.select("plc", found.alias("n_blocks"), want.alias("n_listed"), F.when(
        found > 0, "ok").when(want == 0, "skipped").otherwise("error").alias("status"))
