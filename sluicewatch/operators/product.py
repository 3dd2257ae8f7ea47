"""Synchronous product of local automata, reachable states only.

A step picks one choice per component: any of its moves, or staying. Steps in which nothing
moves and steps whose joint guard contradicts itself are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.guards import DNF_TYPE, conjoin, guard_text, unsat
from ..session import cut_lineage
from .graph import reachable

#: Ways over which the rows of one graph are spread at most, and rows for which there is one way more.
SALTS = 32
WAY = 4096
#: States listed in one row at most.
CHUNK = 1024


def choices(states: DataFrame, moves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, comp, frm, to, tid, dnf, ord): satisfiable moves plus staying put.

    ``states`` has (keys, comp, node); ``moves`` (keys, comp, frm, to, tid, dnf, ord).
    """
    real = moves.filter(~unsat(F.col("dnf"))).select(
        *keys, "comp", "frm", "to", F.col("tid").cast("string").alias("tid"), "dnf",
        F.struct(F.lit(0).alias("stays"), F.col("ord").alias("at")).alias("ord"))
    true = F.array(F.array()).cast(DNF_TYPE)
    stay = states.select(
        *keys, "comp", F.col("node").alias("frm"), F.col("node").alias("to"),
        F.lit(None).cast("string").alias("tid"), true.alias("dnf"),
        F.struct(F.lit(1).alias("stays"), F.lit(None).cast(moves.schema["ord"].dataType).alias("at")).alias("ord"))
    return real.unionByName(stay)


def step(frontier: DataFrame, options: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """All joint moves out of the frontier's ``locals`` (array of n local state ids).

    Component by component, so a contradiction prunes before the next join. (keys, locals,
    nxt, guard, tids, ords).
    """
    # A row fans out into every joint choice: spread the few rows over all tasks first.
    n_tasks = int(frontier.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = frontier.repartition(n_tasks, *keys, "locals").select(
        *keys, "locals", F.array().cast("array<string>").alias("nxt"),
        F.array(F.array()).cast(DNF_TYPE).alias("dnf"),
        F.array().cast("array<string>").alias("tids"), F.array().cast(ArrayType(options.schema["ord"].dataType)).alias("ords"))
    for i in range(n):
        o = options.filter(F.col("comp") == i).select(
            *keys, F.col("frm").alias("_frm"), F.col("to").alias("_to"), F.col("tid").alias("_tid"),
            F.col("dnf").alias("_dnf"), F.col("ord").alias("_ord"))
        f = f.withColumn("_frm", F.col("locals")[i]).join(o, [*keys, "_frm"]).select(
            *keys, "locals", F.concat("nxt", F.array("_to")).alias("nxt"),
            F.when(F.col("_tid").isNull(), F.col("dnf"))
            .otherwise(conjoin(F.col("dnf"), F.col("_dnf"))).alias("dnf"),
            F.concat("tids", F.array("_tid")).alias("tids"),
            F.concat("ords", F.array("_ord")).alias("ords"), F.col("_tid").isNotNull().alias("_m"))
        f = f.filter(~F.col("_m") | ~unsat(F.col("dnf"))).drop("_m")
    moved = F.exists("tids", lambda t: t.isNotNull())
    return f.filter(moved).select(*keys, "locals", "nxt", guard_text(F.col("dnf")).alias("guard"),
                                  "tids", "ords")


def ways_of(held: DataFrame, graph: Sequence[str]) -> DataFrame:
    """(graph, _ways): over how many ways a graph's rows are spread, by the number of its joint choices."""
    sizes = held.groupBy(*graph, "comp").agg(F.count(F.lit(1)).alias("c")).groupBy(*graph).agg(F.product("c").alias("c"))
    return sizes.select(*graph, F.least(F.lit(SALTS), F.ceil(F.col("c") / WAY)).cast("int").alias("_ways"))


def in_cells(rows: DataFrame, graph: Sequence[str], what: Sequence[str]) -> DataFrame:
    """``rows`` with ``_cell``, so that the rows of all components of a graph meet by (graph, _cell) and nowhere twice.

    A graph's ways are a grid with one side for each component. A row has its place on its own component's side, by the
    hash of ``what``, and is repeated along the others. What is joined by it is never dealt again while it grows.
    """
    counts = rows.groupBy(*graph, "comp").agg(F.count(F.lit(1)).alias("c")).groupBy(*graph).agg(
        F.array_sort(F.collect_list(F.struct("comp", F.col("c").cast("int").alias("c")))).alias("c"))  # one entry a component

    def side(acc, x):
        w = F.least(acc["left"], x["c"])
        grid = F.concat(acc["grid"], F.array(F.struct(x["comp"].alias("comp"), acc["all"].alias("stride"), w.alias("side"))))
        return F.struct(F.floor(acc["left"] / w).cast("int").alias("left"), (acc["all"] * w).alias("all"), grid.alias("grid"))

    none = F.array().cast("array<struct<comp:int,stride:int,side:int>>")
    start = F.struct(F.col("_ways").alias("left"), F.lit(1).alias("all"), none.alias("grid"))
    grids = counts.join(ways_of(rows, graph), graph).withColumn("a", F.aggregate("c", start, side)).select(
        *graph, F.col("a.all").alias("_all"), F.inline("a.grid"))
    at = F.filter(F.sequence(F.lit(0), F.col("_all") - 1),
                  lambda x: F.floor(x / F.col("stride")) % F.col("side") == F.pmod(F.xxhash64(*what), F.col("side")))
    return rows.join(grids, [*graph, "comp"]).withColumn("_cell", F.explode(at)).drop("_all", "stride", "side")


def marked(held: DataFrame, graph: Sequence[str]) -> DataFrame:
    """``held`` with ``twin``, another choice leads from the same state to the same one, so joint moves with both may
    have the same key; and ``rest``, staying in a state that no move leads back to."""
    same = F.count(F.lit(1)).over(Window.partitionBy(*graph, "comp", "frm", "to"))
    stays = F.col("tid").isNull() & F.col("frm").eqNullSafe(F.col("to"))
    return held.withColumn("twin", same > 1).withColumn("rest", stays & ~F.col("twin"))


def sides_of(held: DataFrame, graph: Sequence[str]) -> DataFrame:
    """What a component does in a joint move: (graph, comp, oid, at, to, stays, dnf, tid, ord, twin).

    A row for each choice, but one for all (up to CHUNK) states a component may rest in, listed in ``at``.
    """
    own = held.filter(~F.col("rest")).select(
        *graph, "comp", F.when(F.col("tid").isNotNull(), F.col("oid")).alias("oid"), F.array("frm").alias("at"), "to",
        F.lit(False).alias("stays"), "dnf", "tid", "ord", "twin")
    rest = held.filter("rest")
    chunks = rest.groupBy(*graph, "comp").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_chunks"))
    rest = rest.join(chunks, [*graph, "comp"]).groupBy(*graph, "comp", F.pmod(F.xxhash64("frm"), F.col("_chunks")).alias("_chunk")).agg(
        F.collect_list("frm").alias("at")).withColumn("stays", F.lit(True)).withColumn("twin", F.lit(False)).drop("_chunk")
    return own.unionByName(rest, allowMissingColumns=True)


def product(initial: DataFrame, options: DataFrame, keys: Sequence[str], n: int,
            max_states: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Reachable global states (keys, locals) and transitions (keys, locals, nxt, guard, tids).

    States first: every choice can be made alone while the others stay, so the reachable states are all
    combinations of the local states that each component reaches by itself, and no joint step is searched.
    Then the sets of choices that move together, component by component: two whose guards contradict each other never
    meet. What a joint guard says depends only on the choices that move, so it is made once for each set of them and
    checked as a whole. The components that stay do so in any of their states: a set is written once, with the lists of
    those states, and becomes one transition for each combination when it is read. A transition is known by (from, to,
    guard); of several joint moves with the same key the one first in choice order is kept. Raises when a graph
    exceeds ``max_states``, if given.
    """
    graph = [*keys, "_g"]  # also without keys there is something to join on
    options = cut_lineage(options.withColumns({"_g": F.lit(0), "oid": F.monotonically_increasing_id()}))
    starts = initial.select(*keys, F.lit(0).alias("_g"), F.posexplode("locals").alias("comp", "node")).distinct()
    steps = options.filter(F.col("frm") != F.col("to")).select(*graph, "comp", "frm", "to")
    local = cut_lineage(reachable(steps, starts, [*graph, "comp"]))
    if max_states is not None:
        sizes = local.groupBy(*graph, "comp").agg(F.count(F.lit(1)).alias("c")).groupBy(*graph).agg(F.product("c").alias("c"))
        if not sizes.filter(F.col("c") > max_states).isEmpty():
            raise ValueError(f"global FSM exceeds --max-states={max_states} (state explosion)")

    if n > 1:
        dealt = cut_lineage(in_cells(local, graph, ["node"]))
        states = dealt.filter("comp = 0").select(*graph, "_cell", F.array("node").alias("locals"))
        for i in range(1, n):
            side = dealt.filter(F.col("comp") == i).select(*graph, "_cell", "node")
            states = states.join(side, [*graph, "_cell"]).select(*graph, "_cell", F.concat("locals", F.array("node")).alias("locals"))
    else:
        states = local.filter("comp = 0").select(*graph, F.array("node").alias("locals"))
    states = cut_lineage(states.select(*keys, "locals"))

    held = options.join(local.withColumnRenamed("node", "frm"), [*graph, "comp", "frm"], "left_semi")
    held = cut_lineage(marked(held, graph))
    real = held.filter(F.col("tid").isNotNull()).select(*graph, "comp", "oid", "dnf")
    later = real.select(*graph, F.col("comp").alias("_comp"), F.col("oid").alias("_oid"), F.col("dnf").alias("_dnf"))
    against = real.join(later, graph).filter((F.col("comp") < F.col("_comp")) & unsat(conjoin(F.col("dnf"), F.col("_dnf"))))
    against = against.groupBy(*graph, F.col("_oid").alias("oid")).agg(F.collect_list("oid").alias("against"))  # other choices of a graph
    sides = cut_lineage(sides_of(held, graph).join(against, [*graph, "oid"], "left"))
    sides = cut_lineage(in_cells(sides, graph, ["at", "to"]))
    last = F.struct(F.lit(1).alias("stays"), F.lit(None).alias("at")).cast(options.schema["ord"].dataType)  # after all moves
    true = F.array(F.array()).cast(DNF_TYPE)

    def of(i: int) -> DataFrame:
        return sides.filter(F.col("comp") == i).select(
            *graph, "_cell", F.struct("at", "to", "stays").alias("_part"), F.col("oid").alias("_oid"), F.col("tid").alias("_tid"),
            F.when(F.col("oid").isNull(), last).otherwise(F.col("ord")).alias("_ord"), F.col("dnf").alias("_dnf"),
            F.col("twin").alias("_twin"), "against")

    sets = of(0).select(*graph, "_cell", F.array("_part").alias("parts"), F.array("_oid").alias("oids"), F.array("_tid").alias("tids"),
                        F.array("_ord").alias("ords"), F.when(F.col("_oid").isNull(), true).otherwise(F.col("_dnf")).alias("dnf"),
                        F.col("_twin").alias("twin"))
    for i in range(1, n):
        met = sets.join(of(i), [*graph, "_cell"]).filter(
            F.col("against").isNull() | ~F.coalesce(F.arrays_overlap("oids", "against"), F.lit(False)))
        sets = met.select(
            *graph, "_cell", *[F.concat(many, F.array(one)).alias(many) for many, one in (
                ("parts", "_part"), ("oids", "_oid"), ("tids", "_tid"), ("ords", "_ord"))],
            F.when(F.col("_oid").isNull(), F.col("dnf")).otherwise(conjoin(F.col("dnf"), F.col("_dnf"))).alias("dnf"),
            (F.col("twin") | F.col("_twin")).alias("twin"))
    # as rows, so that a joint guard is made once and not again for its text
    sets = sets.filter(F.exists("oids", lambda o: o.isNotNull())).withColumn(
        "dnf", F.explode(F.filter(F.array("dnf"), lambda d: ~unsat(d))))
    sets = cut_lineage(sets.select(*graph, "parts", guard_text(F.col("dnf")).alias("guard"), "tids",
                                   F.when(F.col("twin"), F.col("ords")).alias("ords"), "twin"), compression="zstd")  # guards are long and alike
    first = cut_lineage(sets.filter("twin").groupBy(*graph, "parts", "guard").agg(F.min_by("tids", "ords").alias("tids")))
    found = sets.filter(~F.col("twin")).drop("ords", "twin").unionByName(first)
    for i in range(n):
        found = found.withColumn(f"_at{i}", F.explode(F.col("parts")[i]["at"]))
    to = [F.when(F.col("parts")[i]["stays"], F.col(f"_at{i}")).otherwise(F.col("parts")[i]["to"]) for i in range(n)]
    return states, found.select(*keys, F.array(*[f"_at{i}" for i in range(n)]).alias("locals"), F.array(*to).alias("nxt"), "guard", "tids")
