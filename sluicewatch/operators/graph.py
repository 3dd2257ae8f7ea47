"""Automaton and dependency-graph operators over edge tables.

Every operator works on many graphs at once: ``keys`` name the graph (PLC, function block,
scenario), edges have ``frm`` and ``to``. Loops join one frontier per round on
(keys, node), so a large graph spreads over all tasks; rounds are cut by a written
table. States have ``node`` and ``ord`` (first-seen order).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

HOPS = 4  # propagation steps between two checkpoints


def no_incoming(states: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return states.join(edges.select(*keys, F.col("to").alias("node")), [*keys, "node"], "left_anti")


def dead_states(states: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return states.join(edges.select(*keys, F.col("frm").alias("node")), [*keys, "node"], "left_anti")


def dangling(states: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side, node) of edge ends that name no state."""
    ends = edges.select(*keys, F.inline(F.array(
        F.struct(F.lit("from_state").alias("side"), F.col("frm").alias("node")),
        F.struct(F.lit("to_state").alias("side"), F.col("to").alias("node"))))).distinct()
    return ends.join(states.select(*keys, "node"), [*keys, "node"], "left_anti")


def _attach(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on the graph keys; without keys both sides are one row."""
    return a.join(b, list(keys), "left") if keys else a.crossJoin(F.broadcast(b))


def _fallback(states: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per graph the first of ``names`` it has, else its first-seen state."""
    rank = F.lit(len(names))
    for i, n in reversed(list(enumerate(names))):
        rank = F.when(F.col("node") == n, i).otherwise(rank)
    return states.groupBy(*keys).agg(F.min_by("node", F.struct(rank, "ord")).alias("node"))


def initial_state(states: DataFrame, edges: DataFrame, keys: Sequence[str],
                  names: Sequence[str] = ("100",)) -> DataFrame:
    """First state without incoming edges, else a named one, else the first seen."""
    free = no_incoming(states, edges, keys).groupBy(*keys).agg(
        F.min_by("node", "ord").alias("free"))
    both = _attach(_fallback(states, keys, names), free, keys)
    return both.select(*keys, F.coalesce("free", "node").alias("node"))


def start_states(states: DataFrame, edges: DataFrame, keys: Sequence[str],
                 names: Sequence[str] = ("100",)) -> DataFrame:
    """All states without incoming edges; where there is none, the fallback state."""
    free = no_incoming(states, edges, keys).select(*keys, "node")
    if not keys:
        return free if not free.isEmpty() else _fallback(states, keys, names)
    rest = _fallback(states, keys, names).join(free.select(*keys), list(keys), "left_anti")
    return free.unionByName(rest)


def chains(edges: DataFrame, keys: Sequence[str], keep: DataFrame | None = None) -> DataFrame:
    """(keys, node, head, tail, hops) of the nodes with one way in and one way out that lead from one other
    node, ``head``, to another, ``tail``, along such nodes only; ``hops`` from the head.

    Both ends are found by pointer jumping: every turn doubles the distance, so a chain of any length takes the
    logarithm of it. Nodes in ``keep`` count as ends. A ring of such nodes alone has no ends: its
    nodes have the largest of them as ``tail`` and a NULL ``head``.
    """
    on = [*keys, "node"]
    e = cut_lineage(edges.select(*keys, "frm", "to").distinct())
    ends = e.select(*keys, F.inline(F.array(
        F.struct(F.col("frm").alias("node"), F.col("to").alias("out"), F.lit(None).cast(e.schema["frm"].dataType).alias("into")),
        F.struct(F.col("to").alias("node"), F.lit(None).cast(e.schema["frm"].dataType).alias("out"), F.col("frm").alias("into")))))
    inner = ends.groupBy(*on).agg(F.count("out").alias("outs"), F.count("into").alias("ins"), F.min("out").alias("tail"),
                                  F.min("into").alias("head")).filter("outs = 1 AND ins = 1 AND head != node")
    if keep is not None:
        inner = inner.join(keep.select(*on), on, "left_anti")
    left = cut_lineage(inner.select(*on, "head", "tail", F.lit(1).cast("long").alias("hops"), F.col("node").alias("top")))
    inside = left.select(*on)
    before = None
    while True:
        back = left.select(*keys, F.col("node").alias("head"), F.col("head").alias("_head"), F.col("hops").alias("_hops"), F.col("top").alias("_top"))
        ahead = left.select(*keys, F.col("node").alias("tail"), F.col("tail").alias("_tail"))
        left = cut_lineage(left.join(back, [*keys, "head"], "left").join(ahead, [*keys, "tail"], "left").select(
            *on, F.coalesce("_head", "head").alias("head"), F.coalesce("_tail", "tail").alias("tail"),
            (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.greatest("top", "_top").alias("top")))
        # an end may be inside still only in a ring, whose nodes all see its largest one in the end
        open_ = left.join(inside.withColumnRenamed("node", "head"), [*keys, "head"], "left_semi")
        now = tuple(open_.agg(F.count(F.lit(1)), F.sum(F.xxhash64("top") % 1_000_003)).first())
        if not now[0]:
            return left.drop("top")
        if now == before:
            ring = inside.withColumnRenamed("node", "head").withColumn("ring", F.lit(True))
            return left.join(ring, [*keys, "head"], "left").select(
                *on, F.when(F.col("ring").isNull(), F.col("head")).alias("head"),
                F.when(F.col("ring").isNull(), F.col("tail")).otherwise(F.col("top")).alias("tail"), "hops")
        before = now


def _core(edges: DataFrame, inner: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges between nodes outside chains: each chain is one edge, and rings are gone."""
    e = edges.select(*keys, "frm", "to").distinct()
    ways = inner.filter("head IS NOT NULL").select(*keys, F.col("head").alias("frm"), F.col("tail").alias("to"))
    plain = e.join(inner.select(*keys, F.col("node").alias("frm")), [*keys, "frm"], "left_anti").join(
        inner.select(*keys, F.col("node").alias("to")), [*keys, "to"], "left_anti")
    return plain.unionByName(ways.select(*plain.columns)).distinct()


def reachable(edges: DataFrame, seeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All (keys, node) reached from the seeds, seeds included.

    Chains count as one hop, so the turns are those of the graph's branching, not of its length.
    """
    on = [*keys, "node"]
    frontier = cut_lineage(seeds.select(*on).distinct())
    inner = cut_lineage(chains(edges, keys, frontier))
    hops = cut_lineage(_core(edges, inner, keys))
    seen, rounds = frontier, 0
    while True:
        found = frontier.withColumnRenamed("node", "frm").join(hops, [*keys, "frm"]).select(
            *keys, F.col("to").alias("node")).distinct()
        frontier = cut_lineage(found.join(seen, on, "left_anti"))
        if frontier.isEmpty():
            break
        seen, rounds = seen.unionByName(frontier), rounds + 1
        if rounds % 8 == 0:  # keep the union short
            seen = cut_lineage(seen)
    passed = inner.join(seen.withColumnRenamed("node", "head"), [*keys, "head"], "left_semi").select(*on)
    return seen.unionByName(passed)


def unreachable_states(states: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    seen = reachable(edges, start_states(states, edges, keys), keys)
    return states.join(seen, [*keys, "node"], "left_anti")


def backward_slice(edges: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Everything that influences the targets: reachability over reversed edges."""
    back = edges.select(*keys, F.col("to").alias("frm"), F.col("frm").alias("to"))
    return reachable(back, targets, keys)


def _spread(marks: DataFrame, edges: DataFrame, keys: Sequence[str], mark: str) -> DataFrame:
    """Fixed point of: each node takes the largest mark of itself and its predecessors."""
    on = [*keys, "node"]
    while True:
        for _ in range(HOPS):
            sent = edges.join(marks.withColumnRenamed("node", "frm"), [*keys, "frm"]).select(
                *keys, F.col("to").alias("node"), mark, F.lit(None).cast("boolean").alias("own"))
            marks = (marks.select(*on, mark, F.lit(True).alias("own")).unionByName(sent)
                     .groupBy(*on).agg(F.max(mark).alias(mark),
                                       F.max(F.when(F.col("own"), F.col(mark))).alias("before")))
        marks = cut_lineage(marks)
        still = marks.filter(~F.col(mark).eqNullSafe(F.col("before"))).isEmpty()
        marks = marks.select(*on, mark)
        if still:  # the last hop moved nothing
            return marks


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strongly connected components as (keys, node, scc), named by their largest node.

    A chain's nodes belong to the component of its two ends if that is one, else they stand alone; a
    ring of such nodes is one. So only the nodes between chains are searched.
    """
    on = [*keys, "node"]
    e = cut_lineage(edges.select(*keys, "frm", "to").filter(F.col("frm") != F.col("to")).distinct())
    inner = cut_lineage(chains(e, keys))
    core = nodes.select(*on).distinct().join(inner.select(*on), on, "left_anti")
    found = cut_lineage(_core_components(core, _core(e, inner, keys), keys))
    ends = [found.select(*keys, F.col("node").alias(c), F.col("scc").alias(f"of_{c}")) for c in ("head", "tail")]
    joined = inner.join(ends[0], [*keys, "head"], "left").join(ends[1], [*keys, "tail"], "left")
    named = joined.select(*on, F.when(F.col("head").isNull(), F.col("tail")).when(
        F.col("of_head") == F.col("of_tail"), F.col("of_head")).otherwise(F.col("node")).alias("scc"))
    both = cut_lineage(found.unionByName(named.select(*found.columns)))
    largest = both.groupBy(*keys, "scc").agg(F.max("node").alias("largest"))
    return both.join(largest, [*keys, "scc"]).select(*on, F.col("largest").alias("scc"))


def _core_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, scc) by coloring.

    Nodes without a way in or out stand alone. For the others each round finds the largest
    node that reaches them and the largest one they reach. Where both agree the node belongs
    to that node's component and is taken out; edges whose ends differ in either cannot lie
    inside a component and are dropped.
    """
    on = [*keys, "node"]
    left_edges = cut_lineage(edges.select(*keys, "frm", "to").filter(
        F.col("frm") != F.col("to")).distinct())
    left = cut_lineage(nodes.select(*on).distinct())
    done: DataFrame | None = None
    both_ways = F.explode(F.array(F.lit(0), F.lit(1)))
    while not left.isEmpty():
        core = cut_lineage(
            left_edges.select(*keys, F.col("frm").alias("node")).distinct()
            .join(left_edges.select(*keys, F.col("to").alias("node")), on, "left_semi"))
        alone = left.join(core, on, "left_anti").withColumn("scc", F.col("node"))
        done = alone if done is None else done.unionByName(alone)
        left = core
        if left.isEmpty():
            break
        left_edges = left_edges.join(
            core.withColumnRenamed("node", "frm"), [*keys, "frm"], "left_semi").join(
            core.withColumnRenamed("node", "to"), [*keys, "to"], "left_semi")
        ways = F.inline(F.array(
            F.struct(F.lit(0).alias("dir"), "frm", "to"),
            F.struct(F.lit(1).alias("dir"), F.col("to").alias("frm"), F.col("frm").alias("to"))))
        marks = _spread(left.select(*on, both_ways.alias("dir"), F.col("node").alias("top")),
                        left_edges.select(*keys, ways), [*keys, "dir"], "top")
        tops = cut_lineage(marks.groupBy(*on).agg(
            F.max(F.when(F.col("dir") == 0, F.col("top"))).alias("before"),
            F.max(F.when(F.col("dir") == 1, F.col("top"))).alias("after")))
        found = tops.filter(F.col("before") == F.col("after")).select(*on, F.col("before").alias("scc"))
        done = done.unionByName(found)
        open_ = tops.filter(F.col("before") != F.col("after"))
        left = open_.select(*on)
        same = [*keys, "before", "after"]
        left_edges = cut_lineage(
            left_edges.join(open_.withColumnRenamed("node", "frm"), [*keys, "frm"])
            .join(open_.withColumnRenamed("node", "to"), [*same, "to"]).select(*keys, "frm", "to"))
    return done if done is not None else nodes.select(*on).withColumn("scc", F.col("node"))


def cycles(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, scc, node) of components with more than one node or a self-loop."""
    scc = components(nodes, edges, keys)
    size = scc.groupBy(*keys, "scc").agg(F.count(F.lit(1)).alias("size"))
    loops = edges.filter(F.col("frm") == F.col("to")).select(
        *keys, F.col("frm").alias("node")).distinct().withColumn("loop", F.lit(True))
    marked = scc.join(size, [*keys, "scc"]).join(loops, [*keys, "node"], "left")
    return marked.filter((F.col("size") > 1) | F.col("loop")).select(*keys, "scc", "node", "size")


def statistics(states: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States, transitions, mean and largest out-degree, dead states per graph."""
    n = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_states"))
    out = edges.groupBy(*keys, "frm").agg(F.count(F.lit(1)).alias("deg"))
    m = out.groupBy(*keys).agg(F.sum("deg").alias("total_transitions"),
                               F.max("deg").alias("max_transitions_from_state"))
    dead = dead_states(states, edges, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("dead"))
    j = _attach(_attach(n, m, keys), dead, keys)
    zero = F.lit(0)
    return j.select(
        *keys, "total_states", F.coalesce("total_transitions", zero).alias("total_transitions"),
        (F.coalesce("total_transitions", zero) / F.col("total_states"))
        .alias("avg_transitions_per_state"),
        F.coalesce("max_transitions_from_state", zero).alias("max_transitions_from_state"),
        F.coalesce("dead", zero).alias("dead_states"))


def transitive_reduction(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop a -> n where some a -> b and b -> n exist, so only the innermost parent stays.

    The middle state is looked up on the side of the edge with fewer neighbours, so a hub
    never has its neighbours paired with each other.
    """
    e = edges.select(*keys, "frm", "to").distinct()
    outs = e.groupBy(*keys, "frm").agg(F.count(F.lit(1)).alias("n_out"))
    ins = e.groupBy(*keys, "to").agg(F.count(F.lit(1)).alias("n_in"))
    sized = e.join(outs, [*keys, "frm"]).join(ins, [*keys, "to"])
    by_out = sized.filter(F.col("n_out") <= F.col("n_in")).select(*keys, "frm", "to")
    by_in = sized.filter(F.col("n_out") > F.col("n_in")).select(*keys, "frm", "to")
    starts = e.select(*keys, "frm", F.col("to").alias("mid"))
    ends = e.select(*keys, F.col("frm").alias("mid"), "to")
    shadowed = by_out.join(starts, [*keys, "frm"]).filter(F.col("mid") != F.col("to")).join(
        ends, [*keys, "mid", "to"], "left_semi").select(*keys, "frm", "to").unionByName(
        by_in.join(ends, [*keys, "to"]).filter(F.col("mid") != F.col("frm")).join(
            starts, [*keys, "frm", "mid"], "left_semi").select(*keys, "frm", "to"))
    return e.join(shadowed, [*keys, "frm", "to"], "left_anti")


def simple_paths(edges: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, path, steps) for every path without a repeated state.

    Their number may grow exponentially with the graph; edges need (frm, to, ord).
    """
    hops = cut_lineage(edges.select(*keys, "frm", "to", "ord"))
    level = cut_lineage(starts.select(
        *keys, "node", F.array("node").alias("path"), F.array().cast("array<bigint>").alias("steps")))
    found = level
    while True:
        grown = (level.withColumnRenamed("node", "frm").join(hops, [*keys, "frm"])
                 .filter(~F.array_contains("path", F.col("to")))
                 .select(*keys, F.col("to").alias("node"),
                         F.concat("path", F.array("to")).alias("path"),
                         F.concat("steps", F.array(F.col("ord").cast("bigint"))).alias("steps")))
        level = cut_lineage(grown)
        if level.isEmpty():
            return found
        found = cut_lineage(found.unionByName(level))
