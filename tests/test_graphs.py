"""Graph operators against plain Python, on random graphs and on long ones."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sluicewatch.functions import guards
from sluicewatch.operators import graph, signatures

EDGES = "g string, frm string, to string"


def random_graph(rnd, n, m):
    names = [f"n{i}" for i in range(n)]
    return {(rnd.choice(names), rnd.choice(names)) for _ in range(m)}


def closure(edges, seeds):
    seen, new = set(seeds), set(seeds)
    while new:
        new = {b for a, b in edges if a in new} - seen
        seen |= new
    return seen


def test_reachable_and_components_match_brute_force(spark):
    rnd = random.Random(5)
    shapes = {}
    for g in range(40):
        edges = random_graph(rnd, rnd.randint(2, 9), rnd.randint(1, 12))
        chain = [f"c{i}" for i in range(rnd.randint(2, 12))]
        edges |= set(itertools.pairwise([rnd.choice(["n0", "x"]), *chain, rnd.choice(["n1", "x", "y"])]))
        if g % 3 == 0:  # a ring on its own
            ring = [f"r{i}" for i in range(rnd.randint(2, 7))]
            edges |= set(zip(ring, ring[1:] + ring[:1], strict=True))
        shapes[str(g)] = edges
    table = spark.createDataFrame([(g, a, b) for g, es in shapes.items() for a, b in es], EDGES)
    seeds = {g: {"n0", rnd.choice(["c1", "r0", "absent"])} for g in shapes}
    given = spark.createDataFrame([(g, s) for g, ss in seeds.items() for s in ss], "g string, node string")
    got = {}
    for r in graph.reachable(table, given, ["g"]).collect():
        assert r.node not in got.setdefault(r.g, set())
        got[r.g].add(r.node)
    assert got == {g: closure(es, seeds[g]) for g, es in shapes.items()}
    nodes = {g: {x for e in es for x in e} | {"lone"} for g, es in shapes.items()}
    all_nodes = spark.createDataFrame([(g, x) for g, xs in nodes.items() for x in xs], "g string, node string")
    want = {}
    for g, es in shapes.items():
        reach = {x: closure(es, {x}) for x in nodes[g]}
        want |= {(g, x): max(y for y in reach[x] if x in reach[y]) for x in nodes[g]}
    rows = graph.components(all_nodes, table, ["g"]).collect()
    assert {(r.g, r.node): r.scc for r in rows} == want and len(rows) == len(want)


def test_long_chains_and_rings_take_few_turns(spark, monkeypatch):
    turns = []
    real = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: turns.append(1) or real(df))
    n = 10_000
    chain = spark.range(n).select(F.lit("a").alias("g"), F.col("id").alias("frm"), (F.col("id") + 1).alias("to"))
    seed = spark.createDataFrame([("a", 0)], "g string, node long")
    found = graph.reachable(chain, seed, ["g"])
    assert found.count() == n + 1 and len(turns) <= 24  # tables written, 15 of them by jumps
    assert graph.backward_slice(chain, spark.createDataFrame([("a", 5000)], "g string, node long"), ["g"]).count() == 5001
    ring = chain.unionByName(spark.createDataFrame([("a", n, 0)], "g string, frm long, to long"))
    turns.clear()
    scc = graph.components(ring.select("g", F.col("frm").alias("node")), ring, ["g"])
    assert scc.select("scc").distinct().collect()[0][0] == n and scc.count() == n + 1 and len(turns) <= 36
    parts = graph.components(ring.select("g", F.col("frm").alias("node")), chain, ["g"])
    assert parts.filter("scc = node").count() == n + 1


def least_terms(edges, starts):
    """{node: least terms} of the simple paths' terms."""
    terms = {}

    def walk(node, path, asked):
        terms.setdefault(node, set()).add(asked)
        for a, b, dnf in edges:
            if a == node and b not in path:
                for t in dnf:
                    walk(b, [*path, b], asked | frozenset(t))

    for s in starts:
        walk(s, [s], frozenset())
    return {n: {t for t in ts if not any(u < t for u in ts)} for n, ts in terms.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_state_signatures_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    conds = [f"v{i} = 1" for i in range(5)]
    rows, want = [], {}
    for g in range(25):
        edges = {}
        for a, b in random_graph(rnd, rnd.randint(2, 6), rnd.randint(1, 10)):
            edges[a, b] = [frozenset(rnd.sample(conds, rnd.randint(0, 2))) for _ in range(rnd.randint(1, 2))]
        tail = [f"c{i}" for i in range(rnd.randint(0, 5))]
        for a, b in itertools.pairwise(["n0", *tail, "n1"] if tail else []):
            edges[a, b] = [frozenset(rnd.sample(conds, 1))]
        rows += [(str(g), a, b, " OR ".join("(" + " AND ".join(sorted(t)) + ")" if t else "TRUE" for t in dnf)) for (a, b), dnf in edges.items()]
        want |= {(str(g), n): t for n, t in least_terms([(a, b, d) for (a, b), d in edges.items() if a != b], ["n0"]).items()}
    table = spark.createDataFrame(rows, EDGES + ", guard string").withColumn("dnf", guards.guard_to_dnf("guard"))
    starts = table.select("g").distinct().withColumn("node", F.lit("n0"))
    got = {}
    for r in signatures.state_signatures(table, starts, ["g"]).collect():
        got.setdefault((r.g, r.node), []).append(frozenset(r.term))
    assert {k: set(v) for k, v in got.items()} == want and all(len(v) == len(set(v)) for v in got.values())


def test_signatures_of_large_cyclic_graphs(spark):
    """A ring of 1,000 states with shortcuts back, and a guard that is never true."""
    n = 1000
    edges = [("a", str(i), str((i + 1) % n), f"x{i % 7} > 0") for i in range(n)] + [("a", str(i), str(i - 50), "y = 1") for i in range(100, n, 100)]
    edges += [("a", "0", "500", "z = 1 OR z = 2"), ("a", "0", "700", "FALSE")]
    table = spark.createDataFrame(edges, EDGES + ", guard string").withColumn("dnf", guards.guard_to_dnf("guard"))
    found = signatures.state_signatures(table, spark.createDataFrame([("a", "0")], "g string, node string"), ["g"])
    got = {}
    for r in found.collect():
        got.setdefault(r.node, set()).add(tuple(r.term))
    every = tuple(f"x{i} > 0" for i in range(7))
    assert len(got) == n and got["0"] == {()} and got["3"] == {every[:3]} and got["499"] == {every, ("x0 > 0", *every[1:], "y = 1", "z = 1")} - {
        ("x0 > 0", *every[1:], "y = 1", "z = 1")}
    assert got["500"] == {("z = 1",), ("z = 2",), every}
    assert got["501"] == {("x3 > 0", "z = 1"), ("x3 > 0", "z = 2"), every}


def test_path_signatures_list_every_path(spark):
    rows = [("a", "s", "m", 1, "p = 1 OR q = 1"), ("a", "m", "t", 2, "p = 1"), ("a", "s", "t", 3, "q = 1 AND p = 1"), ("a", "t", "s", 4, "r = 1")]
    table = spark.createDataFrame(rows, EDGES + ", ord long, guard string").withColumn("dnf", guards.guard_to_dnf("guard"))
    starts = spark.createDataFrame([("a", "s")], "g string, node string")
    out = signatures.path_signatures(table, starts, ["g"]).select("node", "paths", signatures.conditions_text(F.col("terms")).alias("s"))
    assert {r.node: (r.paths, r.s) for r in out.collect()} == {
        "s": (1, "[initial]"), "m": (1, "(p = 1) OR (q = 1)"), "t": (2, "(p = 1 AND q = 1) OR (p = 1)")}
