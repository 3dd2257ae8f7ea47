"""The product of local automata: against plain Python, and at the size of a whole network."""

import itertools
import os
import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sluicewatch.functions import guards
from sluicewatch.operators import product
from sluicewatch.session import cut_lineage, ensure_checkpoint_dir

MOVES = "g string, comp int, frm string, to string, tid string, guard string, ord long"


def options(spark, states, moves):
    s = spark.createDataFrame(states, "g string, comp int, node string")
    m = spark.createDataFrame(moves, MOVES).withColumn("dnf", guards.guard_to_dnf("guard"))
    return product.choices(s, m, ["g"])


def test_network_of_ten_actuators(spark):
    """Two states each; a pump opens below a level of its tank and closes above another."""
    tanks = {"T1": [(4.0, 6.3), (1.0, 4.5)], "T3": [(3.0, 5.3), (1.0, 3.5)], "T4": [(2.0, 3.5), (3.0, 5.0)], "T7": [(2.5, 4.8), (1.0, 3.0)],
             "T5": [(1.5, 4.0)], "T2": [(0.5, 5.5)]}
    actuators = [(t, lo, hi) for t, limits in tanks.items() for lo, hi in limits]
    states = [("c", i, x) for i in range(10) for x in "01"]
    moves = [(("c", i, "0", "1", f"o{i}", f"{t} < {lo}", 2 * i)) for i, (t, lo, hi) in enumerate(actuators)]
    moves += [(("c", i, "1", "0", f"c{i}", f"{t} > {hi}", 2 * i + 1)) for i, (t, lo, hi) in enumerate(actuators)]
    first = spark.createDataFrame([("c", ["0"] * 10)], "g string, locals array<string>")
    o = options(spark, states, moves)
    seen, steps = product.product(first, o, ["g"], 10)
    assert seen.count() == 1024 and seen.distinct().count() == 1024
    assert steps.count() == 613_632
    one = steps.filter((F.array_join("locals", "") == "0000000000") & (F.array_join("nxt", "") == "1100000000")).collect()
    assert [(r.guard, r.tids) for r in one] == [("T1 < 1.0 AND T1 < 4.0", ["o0", "o1", *[None] * 8])]
    assert steps.filter((F.array_join("locals", "") == "0100000000") & (F.array_join("nxt", "") == "1000000000")).count() == 0
    with pytest.raises(ValueError, match="max-states"):
        product.product(first, o, ["g"], 10, 1000)


def clash(conds):
    for (v, o, x), (w, p, y) in itertools.product(conds, conds):
        if v == w and (o, p) == (">", "<") and x >= y:
            return True
    return False


def test_product_matches_brute_force(spark):
    rnd = random.Random(8)
    states, moves, starts, want_states, want = [], [], [], {}, {}
    for g in map(str, range(8)):
        own, n = {}, 3
        for c in range(n):
            size = rnd.randint(1, 3)
            names = [f"{c}{i}" for i in range(size)]
            states += [(g, c, x) for x in names]
            own[c] = [(x, x, None, [frozenset()], (1, 0)) for x in names]
            for k in range(rnd.randint(0, 4)):
                a, b = rnd.choice(names), rnd.choice(names)
                dnf = [frozenset((v, rnd.choice("<>"), rnd.randint(1, 3)) for v in rnd.sample("xy", rnd.randint(1, 2))) for _ in range(rnd.randint(1, 2))]
                text = " OR ".join("(" + " AND ".join(f"{v} {o} {x}" for v, o, x in sorted(t)) + ")" for t in dnf)
                moves.append((g, c, a, b, f"m{c}{k}", text, k))
                if any(not clash(t) for t in dnf):
                    own[c].append((a, b, f"m{c}{k}", dnf, (0, k)))
        start = tuple(f"{c}0" for c in range(n))
        starts.append((g, list(start)))
        seen, new = {start}, [start]
        while new:
            at = new.pop()
            for choice in itertools.product(*[[o for o in own[c] if o[0] == at[c]] for c in range(n)]):
                terms = [[c for part in t for c in part] for t in itertools.product(*[o[3] for o in choice])]
                if all(o[2] is None for o in choice) or all(clash(t) for t in terms):
                    continue
                nxt = tuple(o[1] for o in choice)
                text = " OR ".join(dict.fromkeys(" AND ".join(f"{v} {o} {x}" for v, o, x in sorted(t)) for t in terms))
                key, best = (g, at, nxt, text), (tuple(o[4] for o in choice), tuple(o[2] for o in choice))
                want[key] = min(want.get(key, best), best)
                if nxt not in seen:
                    seen.add(nxt)
                    new.append(nxt)
        want_states[g] = seen
    first = spark.createDataFrame(starts, "g string, locals array<string>")
    seen, steps = product.product(first, options(spark, states, moves), ["g"], 3)
    assert sorted((r.g, tuple(r.locals)) for r in seen.collect()) == sorted((g, s) for g, ss in want_states.items() for s in ss)
    got = {(r.g, tuple(r.locals), tuple(r.nxt), r.guard): tuple(r.tids) for r in steps.collect()}
    assert got == {k: v[1] for k, v in want.items()} and steps.count() == len(got)


def test_false_is_not_true(spark):
    rows = spark.createDataFrame([("FALSE AND x > 1", "y > 1"), (None, "y > 1"), ("FALSE", "FALSE")], "a string, b string")
    rows = rows.select(*[F.when(F.col(c).isNotNull(), guards.guard_to_dnf(c)).alias(c) for c in ("a", "b")])
    joint = rows.select(guards.conjoin(F.col("a"), F.col("b")).alias("d")).select(guards.guard_text(F.col("d")), guards.unsat(F.col("d")))
    assert [tuple(r) for r in joint.collect()] == [("", True), ("y > 1", False), ("", True)]


def rows_written(spark, tables):
    """Rows of the largest table under the checkpoint folder besides ``tables``, and all tables there."""
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    now = {f"{top}/{t}" for t in os.listdir(top)}
    return max((sum(pq.read_metadata(f).num_rows for f in Path(t).rglob("*.parquet")) for t in now - tables), default=0), now


def test_sets_are_written_and_not_their_transitions(spark):
    """Six components of two states: 4 ** 6 - 2 ** 6 joint moves, of 3 ** 6 - 1 sets of choices that move."""
    states = [("c", i, x) for i in range(6) for x in "01"]
    moves = [("c", i, a, b, f"{a}{i}", f"x{i} > {a}", int(a)) for i in range(6) for a, b in ("01", "10")]
    first = spark.createDataFrame([("c", ["0"] * 6)], "g string, locals array<string>")
    ensure_checkpoint_dir(spark)
    before = rows_written(spark, set())[1]
    seen, steps = product.product(first, options(spark, states, moves), ["g"], 6)
    assert (seen.count(), steps.count(), steps.select("locals", "nxt").distinct().count()) == (64, 4 ** 6 - 2 ** 6, 4 ** 6 - 2 ** 6)
    assert rows_written(spark, before)[0] == 3 ** 6 - 1


def test_shuffles_go_when_a_table_is_written(spark):
    top = Path(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()[0])
    before = set(top.rglob("shuffle_*"))
    written = cut_lineage(spark.range(10_000).repartition(4, "id"))
    assert not {f for f in set(top.rglob("shuffle_*")) - before if f.suffix == ".data"} and written.count() == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_rows_of_a_graph_meet_in_one_cell(spark):
    """Each combination of one row of every component has exactly one cell, and a large graph has many."""
    sizes = {"small": (3, 4, 5), "large": (2, 150, 150)}
    rows = spark.createDataFrame([(g, c, f"n{k}") for g, s in sizes.items() for c, m in enumerate(s) for k in range(m)], "g string, comp int, node string")
    dealt = cut_lineage(product.in_cells(rows, ["g"], ["node"]))
    met = dealt.filter("comp = 0").select("g", "_cell", F.col("node").alias("n0"))
    for i in (1, 2):
        met = met.join(dealt.filter(F.col("comp") == i).select("g", "_cell", F.col("node").alias(f"n{i}")), ["g", "_cell"])
    got = {r.g: (r.n, r.m, r.cells) for r in met.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("n0", "n1", "n2").alias("m"), F.countDistinct("_cell").alias("cells")).collect()}
    assert got["small"] == (60, 60, 1) and got["large"][:2] == (45_000, 45_000) and got["large"][2] > 4


def test_only_large_graphs_are_spread(spark):
    """Each way repeats a graph's choices in every join, so a graph of few joint choices has one."""
    held = spark.createDataFrame([("small", c) for c in range(3) for _ in range(16)] + [("large", c) for c in range(5) for _ in range(16)], "g string, comp int")
    assert {r.g: r._ways for r in product.ways_of(held, ["g"]).collect()} == {"small": 1, "large": product.SALTS}


def test_packed_tables_count_as_large(spark):
    """A written table of repeated names is small as a file; the planner must not take it for small in memory."""
    names = spark.range(200_000).select(F.concat(F.lit("scenario/"), F.col("id") % 100, F.lit("/a name that is repeated")).alias("n"))
    written = cut_lineage(names)
    files = sum(os.path.getsize(f.removeprefix("file://")) for f in written.inputFiles())
    assert int(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > 10 * files
