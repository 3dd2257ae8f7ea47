"""Queries on the automata the trace shows: one graph per scenario."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guards
from ..operators import graph, product, signatures
from ..operators.detectors import previous_state
from ..operators.segments import halo_windows, ranged_sums
from ..session import cut_lineage
from .registry import query
from .trace import SQL, trace


G = ["scenario"]
# A graph is one scenario's half of the trace. Mode = event type and flow band. A move belongs to the
# automaton when it was seen SEEN times or more, so some states have no way in or out.
SEEN = 2
GRAPH = "scenario || '/' || split AS scenario"
STATES = f"""WITH RECURSIVE {SQL},
md AS (SELECT {GRAPH}, rn, l_t1, s_pu1, s_pu2, f_pu1, event_type || ':' || CAST(floor(f_pu1 / 50) AS BIGINT) AS node FROM tr),
pv AS (SELECT *, lag(node) OVER w AS pnode FROM md WINDOW w AS (PARTITION BY scenario ORDER BY rn)),
st AS (SELECT scenario, node, min(rn) AS ord, count(*) AS seen FROM md GROUP BY scenario, node),
mvs AS (SELECT scenario, pnode AS frm, node AS "to", count(*) AS n, min(rn) AS ord FROM pv WHERE pnode <> node GROUP BY ALL),
ed AS (SELECT * FROM mvs WHERE n >= {SEEN})"""
FREE = """fr AS (SELECT scenario, node, ord FROM st WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.scenario = st.scenario AND ed."to" = st.node))"""
SEEDS = f"""{FREE}, sd AS (SELECT scenario, node FROM fr UNION ALL SELECT scenario, arg_min(node, ord) FROM st
  WHERE scenario NOT IN (SELECT scenario FROM fr) GROUP BY scenario)"""
PAIRS = """rc AS (SELECT scenario, frm AS a, "to" AS b FROM ed UNION SELECT rc.scenario, a, ed."to" FROM rc JOIN ed ON ed.scenario = rc.scenario AND ed.frm = rc.b)"""


def whole_trace(spark, d, *columns):
    """All rows, each half of a scenario as a graph of its own; windows run over its ``rn``."""
    return trace(spark, d, None, *columns).withColumn("scenario", F.concat_ws("/", "scenario", "split")).drop("split")


def modes(spark, d):
    t = whole_trace(spark, d, "l_t1", "f_pu1", "event_type")
    return t.withColumn("node", F.concat_ws(":", "event_type", F.floor(F.col("f_pu1") / 50).cast("string")))


def all_moves(spark, d):
    """(states, moves) of all graphs: how often each was seen, and when first."""
    m = cut_lineage(modes(spark, d))
    states = m.groupBy("scenario", "node").agg(F.min("rn").alias("ord"), F.count(F.lit(1)).alias("seen"))
    linked = previous_state(m, G, "node", "frm").filter(F.col("frm") != F.col("node"))
    edges = linked.groupBy("scenario", "frm", F.col("node").alias("to")).agg(
        F.count(F.lit(1)).alias("n"), F.min("rn").alias("ord"))
    return cut_lineage(states), cut_lineage(edges)


def graphs(spark, d):
    states, moves = all_moves(spark, d)
    return states.drop("seen"), moves.filter(F.col("n") >= SEEN)


@query("initial_state", f"""{STATES}, {FREE} SELECT s.scenario, coalesce(any_value(f.node), arg_min(s.node, s.ord)) AS node
FROM st s LEFT JOIN (SELECT scenario, arg_min(node, ord) AS node FROM fr GROUP BY scenario) f USING (scenario) GROUP BY s.scenario""")
def initial_state(spark, d):
    return graph.initial_state(*graphs(spark, d), G)


@query("dead_states", f"""{STATES} SELECT scenario, node FROM st WHERE NOT EXISTS
(SELECT 1 FROM ed WHERE ed.scenario = st.scenario AND ed.frm = st.node)""")
def dead_states(spark, d):
    return graph.dead_states(*graphs(spark, d), G).select("scenario", "node")


@query("dangling_refs", f"""{STATES}, k AS (SELECT scenario, node FROM st WHERE seen >= {SEEN}),
x AS (SELECT scenario, 'from_state' AS side, frm AS node FROM mvs UNION SELECT scenario, 'to_state', "to" FROM mvs)
SELECT scenario, side, node FROM x WHERE (scenario, node) NOT IN (SELECT (scenario, node) FROM k)""")
def dangling_refs(spark, d):
    states, moves = all_moves(spark, d)
    # states seen once are not declared, only referenced
    return graph.dangling(states.filter(F.col("seen") >= SEEN), moves, G).select("scenario", "side", "node")


@query("fsm_stats", f"""{STATES}, dg AS (SELECT scenario, frm, count(*) AS deg FROM ed GROUP BY scenario, frm),
m AS (SELECT scenario, sum(deg)::BIGINT AS t, max(deg) AS mx FROM dg GROUP BY scenario),
dd AS (SELECT scenario, count(*) AS dead FROM st WHERE (scenario, node) NOT IN (SELECT (scenario, frm) FROM ed) GROUP BY scenario)
SELECT n.scenario, n.c AS total_states, coalesce(t, 0) AS total_transitions, round(coalesce(t, 0) / n.c, 6) AS avg_transitions_per_state,
  coalesce(mx, 0) AS max_transitions_from_state, coalesce(dead, 0) AS dead_states
FROM (SELECT scenario, count(*) AS c FROM st GROUP BY scenario) n LEFT JOIN m USING (scenario) LEFT JOIN dd USING (scenario)""")
def fsm_stats(spark, d):
    s = graph.statistics(*graphs(spark, d), G)
    return s.withColumn("avg_transitions_per_state", F.round("avg_transitions_per_state", 6))


@query("unreachable_states", f"""{STATES}, {SEEDS},
re AS (SELECT scenario, node FROM sd UNION SELECT re.scenario, ed."to" FROM re JOIN ed ON ed.scenario = re.scenario AND ed.frm = re.node)
SELECT scenario, node FROM st WHERE (scenario, node) NOT IN (SELECT (scenario, node) FROM re)""")
def unreachable_states(spark, d):
    states, edges = graphs(spark, d)
    return graph.unreachable_states(states, edges, G).select("scenario", "node")


@query("scc_cycles", f"""{STATES}, {PAIRS},
mu AS (SELECT x.scenario, x.a AS node, max(x.b) AS top, count(*) AS size FROM rc x JOIN rc y
  ON x.scenario = y.scenario AND x.a = y.b AND x.b = y.a GROUP BY x.scenario, x.a)
SELECT scenario, top AS scc, node, size FROM mu WHERE size > 1""")
def scc_cycles(spark, d):
    states, edges = graphs(spark, d)
    return graph.cycles(states, edges, G).select("scenario", "scc", "node", "size")


@query("transitive_reduction", f"""{STATES} SELECT e.scenario, e.frm, e."to" FROM ed e WHERE NOT EXISTS
(SELECT 1 FROM ed a JOIN ed b ON a.scenario = b.scenario AND a."to" = b.frm WHERE a.scenario = e.scenario AND a.frm = e.frm AND b."to" = e."to"
  AND a."to" <> e."to")""")
def transitive_reduction(spark, d):
    return graph.transitive_reduction(graphs(spark, d)[1], G)


@query("backward_slice", f"""{STATES}, tg AS (SELECT scenario, node FROM st WHERE node LIKE 'error:%'),
re AS (SELECT scenario, node FROM tg UNION SELECT re.scenario, ed.frm FROM re JOIN ed ON ed.scenario = re.scenario AND ed."to" = re.node)
SELECT scenario, count(*) AS n, sum(CAST(node LIKE 'signup:%' AS INT))::BIGINT AS n_signup FROM re GROUP BY scenario""")
def backward_slice(spark, d):
    states, edges = graphs(spark, d)
    s = graph.backward_slice(edges, states.filter(F.col("node").startswith("error:")), G)
    return s.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"),
                                     F.sum(F.col("node").startswith("signup:").cast("int")).alias("n_signup"))


# Composite-state graph (four states); the guard is the level range seen.
PATHS = f"""{STATES},
cs AS (SELECT {GRAPH}, rn, l_t1, state AS node, lag(state) OVER (PARTITION BY scenario, split ORDER BY rn) AS p FROM tr),
c0 AS (SELECT scenario, arg_min(node, rn) AS node FROM cs GROUP BY scenario),
ce0 AS (SELECT scenario, p AS frm, node AS "to", min(rn) AS ord, max(l_t1) AS hi FROM cs WHERE p <> node GROUP BY ALL),
ce AS (SELECT scenario, frm, "to", unnest(CASE WHEN ord % 2 = 0 THEN ['l_t1 <= ' || CAST(hi AS VARCHAR)]
  ELSE ['l_t1 <= ' || CAST(hi AS VARCHAR), 'rn >= ' || ord] END) AS hi FROM ce0),
sp AS (SELECT scenario, node, [node] AS path, []::VARCHAR[] AS his FROM c0
  UNION ALL SELECT sp.scenario, ce."to", list_append(path, ce."to"), list_append(his, ce.hi) FROM sp
  JOIN ce ON ce.scenario = sp.scenario AND ce.frm = sp.node WHERE NOT list_contains(path, ce."to"))"""


# The guard of every second move has two terms: the level is low enough, or the row late enough.
SIGNED = f"""{PATHS}, sg AS (SELECT DISTINCT scenario, node, path, list_sort(list_distinct(his)) AS t FROM sp)"""


def signed_moves(spark, d):
    t = whole_trace(spark, d, "l_t1", "s_pu1", "s_pu2")
    t = cut_lineage(t.withColumn("node", F.concat(F.lit("P.A:"), F.col("s_pu1").cast("string"), F.lit("|P.B:"),
                                                  F.col("s_pu2").cast("string"))))
    starts = t.filter("rn = 0").select("scenario", "node")
    moves = previous_state(t, G, "node", "frm").filter(F.col("frm") != F.col("node"))
    edges = moves.groupBy("scenario", "frm", F.col("node").alias("to")).agg(
        F.min("rn").alias("ord"), F.max("l_t1").cast("string").alias("hi"), F.min("rn").cast("string").alias("first"))
    low, late = F.concat(F.lit("l_t1 <= "), "hi"), F.concat(F.lit("rn >= "), "first")
    guard = F.when(F.col("ord") % 2 == 0, low).otherwise(F.concat(low, F.lit(" OR "), late))
    return cut_lineage(edges.select("scenario", "frm", "to", "ord", guards.guard_to_dnf(guard).alias("dnf"))), starts


@query("path_signatures", f"""{SIGNED}, s2 AS (SELECT scenario, node, path, CASE WHEN len(t) = 0 THEN '[initial]' ELSE array_to_string(t, ' AND ') END AS s FROM sg)
SELECT scenario, node, count(DISTINCT path) AS paths, CASE WHEN count(DISTINCT s) = 1 THEN min(s)
  ELSE string_agg(DISTINCT '(' || s || ')', ' OR ' ORDER BY '(' || s || ')') END AS signature FROM s2 GROUP BY scenario, node""")
def path_signatures(spark, d):
    s = signatures.path_signatures(*signed_moves(spark, d), G)
    return s.select("scenario", "node", "paths", signatures.conditions_text(F.col("terms")).alias("signature"))


@query("state_signatures", f"""{SIGNED}, dt AS (SELECT DISTINCT scenario, node, t FROM sg),
lt AS (SELECT * FROM dt a WHERE NOT EXISTS (SELECT 1 FROM dt b WHERE a.scenario = b.scenario AND a.node = b.node AND len(b.t) < len(a.t) AND list_has_all(a.t, b.t)))
SELECT scenario, node, CASE WHEN len(t) = 0 THEN '[initial]' ELSE array_to_string(t, ' AND ') END AS term FROM lt""")
def state_signatures(spark, d):
    s = signatures.state_signatures(*signed_moves(spark, d), G)
    return s.select("scenario", "node", signatures.conditions_text(F.array("term")).alias("term"))


@query("transition_sort", f"""{STATES} SELECT scenario, frm, "to", n,
row_number() OVER (PARTITION BY scenario ORDER BY frm, "to", n) - 1 AS pos FROM ed""")
def transition_sort(spark, d):
    e = graphs(spark, d)[1].select("scenario", "frm", "to", "n")
    numbered = ranged_sums(e, G, ["frm", "to", "n"], {"pos": F.lit(1).cast("long")})
    return numbered.withColumn("pos", F.col("pos") - 1)


@query("transition_dedupe", f"""{STATES} SELECT scenario, pnode AS frm, node AS "to", 'l_t1 < ' || (CAST(floor(l_t1 / 30) AS BIGINT) + 1) * 30 AS guard,
  min(rn) AS first_rn FROM pv WHERE pnode <> node GROUP BY ALL""")
def transition_dedupe(spark, d):
    """Moves told apart by their guard, the level band on arrival."""
    m = previous_state(modes(spark, d), G, "node", "frm").filter(F.col("frm") != F.col("node"))
    guard = F.concat(F.lit("l_t1 < "), ((F.floor(F.col("l_t1") / 30) + 1) * 30).cast("string"))
    return m.groupBy("scenario", "frm", F.col("node").alias("to"), guard.alias("guard")).agg(F.min("rn").alias("first_rn"))


# Local automata: components A (s_pu1), B (s_pu2), C (flow band); guard = level range on arrival.
LOCALS = f"""{STATES},
lc AS (SELECT scenario, rn, l_t1, 0 AS comp, CAST(s_pu1 AS VARCHAR) AS node FROM md
  UNION ALL SELECT scenario, rn, l_t1, 1, CAST(s_pu2 AS VARCHAR) FROM md
  UNION ALL SELECT scenario, rn, l_t1, 2, CAST(CAST(floor(f_pu1 / 25) AS BIGINT) AS VARCHAR) FROM md),
lp AS (SELECT *, lag(node) OVER (PARTITION BY scenario, comp ORDER BY rn) AS p FROM lc),
mo AS (SELECT scenario, comp, p AS frm, node AS "to", min(l_t1) AS lo, max(l_t1) AS hi FROM lp WHERE p <> node GROUP BY ALL),
op AS (SELECT scenario, comp, frm, "to", lo, hi, true AS mv FROM mo UNION ALL
  SELECT DISTINCT scenario, comp, node, node, -1e9, 1e9, false FROM lc),
jm AS (SELECT a.scenario, a.frm AS fa, b.frm AS fb, c.frm AS fc, a."to" AS ta, b."to" AS tb, c."to" AS tc,
    CASE WHEN a.mv THEN a.lo END AS la, CASE WHEN a.mv THEN a.hi END AS ha, CASE WHEN b.mv THEN b.lo END AS lb, CASE WHEN b.mv THEN b.hi END AS hb,
    CASE WHEN c.mv THEN c.lo END AS lcc, CASE WHEN c.mv THEN c.hi END AS hc
  FROM op a JOIN op b ON a.scenario = b.scenario AND a.comp = 0 AND b.comp = 1 JOIN op c ON c.scenario = a.scenario AND c.comp = 2
  WHERE (a.mv OR b.mv OR c.mv) AND greatest(a.lo, b.lo, c.lo) <= least(a.hi, b.hi, c.hi)),
i0 AS (SELECT scenario, max(node) FILTER (WHERE comp = 0) AS a, max(node) FILTER (WHERE comp = 1) AS b, max(node) FILTER (WHERE comp = 2) AS c
  FROM lc WHERE rn = 0 GROUP BY scenario),
gs AS (SELECT scenario, a, b, c FROM i0 UNION SELECT gs.scenario, ta, tb, tc FROM gs JOIN jm ON jm.scenario = gs.scenario AND fa = a AND fb = b AND fc = c)"""


def local_automata(spark, d):
    t = whole_trace(spark, d, "l_t1", "s_pu1", "s_pu2", "f_pu1")
    parts = F.array(*[F.struct(F.lit(i).alias("comp"), c.cast("string").alias("node")) for i, c in enumerate((
        F.col("s_pu1"), F.col("s_pu2"), F.floor(F.col("f_pu1") / 25)))])
    t = cut_lineage(t.select("scenario", "rn", "l_t1", parts.alias("parts")))
    linked = halo_windows(t, G, lambda w: [{"prev": F.lag("parts").over(w)}], before=1)
    states = t.select("scenario", F.inline("parts")).distinct()
    both = linked.select("scenario", "l_t1", F.inline(F.arrays_zip("parts", "prev")))
    seen = both.select("scenario", "l_t1", F.col("parts.comp").alias("comp"), F.col("prev.node").alias("frm"),
                       F.col("parts.node").alias("to")).filter(F.col("frm") != F.col("to"))
    moves = seen.groupBy("scenario", "comp", "frm", "to").agg(
        F.min("l_t1").cast("string").alias("lo"), F.max("l_t1").cast("string").alias("hi"))
    guard = F.concat(F.lit("l_t1 >= "), "lo", F.lit(" AND l_t1 <= "), "hi")
    moves = moves.select("scenario", "comp", "frm", "to", guard.alias("guard"),
                         F.concat_ws("->", "frm", "to").alias("tid"), F.xxhash64("frm", "to").alias("ord"))
    first = t.filter("rn = 0").select("scenario", F.transform("parts", lambda p: p["node"]).alias("locals"))
    return states, moves, first


def product_options(spark, d):
    states, moves, first = local_automata(spark, d)
    return product.choices(states, moves.withColumn("dnf", guards.guard_to_dnf("guard")), G), first


@query("fsm_product_step", f"""{LOCALS} SELECT scenario, fa || '|' || fb || '|' || fc AS frm, ta || '|' || tb || '|' || tc AS "to"
FROM jm JOIN i0 USING (scenario) WHERE fa = a AND fb = b AND fc = c""")
def fsm_product_step(spark, d):
    options, first = product_options(spark, d)
    s = product.step(first, options, G, 3)
    return s.select("scenario", F.array_join("locals", "|").alias("frm"), F.array_join("nxt", "|").alias("to"))


@query("fsm_product", f"""{LOCALS}, tr2 AS (SELECT scenario, count(*) AS n FROM gs JOIN jm USING (scenario) WHERE fa = a AND fb = b AND fc = c GROUP BY scenario)
SELECT g.scenario, g.n AS states, coalesce(t.n, 0) AS transitions FROM (SELECT scenario, count(*) AS n FROM gs GROUP BY scenario) g LEFT JOIN tr2 t USING (scenario)""")
def fsm_product(spark, d):
    options, first = product_options(spark, d)
    states, moves = product.product(first, options, G, 3)
    n = states.groupBy("scenario").agg(F.count(F.lit(1)).alias("states"))
    m = moves.groupBy("scenario").agg(F.count(F.lit(1)).alias("transitions"))
    return n.join(m, "scenario", "left").select("scenario", "states", F.coalesce("transitions", F.lit(0)).alias("transitions"))


GTEXT = "'l_t1 >= ' || CAST(lo AS VARCHAR) || ' AND l_t1 <= ' || CAST(hi AS VARCHAR)"
CANON = "'l_t1 <= ' || CAST({h} AS VARCHAR) || ' AND l_t1 >= ' || CAST({l} AS VARCHAR)"


@query("guard_to_dnf", f"""{LOCALS} SELECT scenario, comp, frm, "to", 2 AS n_terms,
  'l_t1 > ' || CAST(hi AS VARCHAR) || ' AND state = ' || frm || ' OR l_t1 < ' || CAST(lo AS VARCHAR) || ' AND state = ' || frm AS dnf FROM mo""")
def guard_to_dnf(spark, d):
    m = local_automata(spark, d)[1]
    text = F.concat(F.lit("NOT ("), F.split("guard", " AND ")[1], F.lit(" AND "), F.split("guard", " AND ")[0],
                    F.lit(") AND state = "), "frm")
    g = m.withColumn("d", guards.guard_to_dnf(text))
    return g.select("scenario", "comp", "frm", "to", F.size("d").alias("n_terms"), guards.guard_text(F.col("d")).alias("dnf"))


@query("guard_canonical", f"""{LOCALS} SELECT scenario, comp, frm, "to", {CANON.format(h='hi', l='lo')} AS guard FROM mo""")
def guard_canonical(spark, d):
    m = local_automata(spark, d)[1].withColumn("d", guards.guard_to_dnf("guard"))
    return m.select("scenario", "comp", "frm", "to", guards.guard_text(F.col("d")).alias("guard"))


def joint_guards(spark, d):
    """Guards of moves of components A and B that leave the same local value."""
    m = local_automata(spark, d)[1].select("scenario", "comp", "frm", "to", guards.guard_to_dnf("guard").alias("dnf"))
    a, b = (m.filter(F.col("comp") == i).drop("comp") for i in (0, 1))
    b = b.withColumnRenamed("dnf", "dnf_b").withColumnRenamed("to", "to_b")
    return a.join(b, ["scenario", "frm"]).withColumn("joint", guards.conjoin(F.col("dnf"), F.col("dnf_b")))


JOINT = f"""{LOCALS}, jg AS (SELECT a.scenario, a.frm, a.lo AS la, a.hi AS ha, b.lo AS lb, b.hi AS hb FROM mo a JOIN mo b
  ON a.scenario = b.scenario AND a.comp = 0 AND b.comp = 1 AND a.frm = b.frm)"""


@query("dnf_conjoin", f"""{JOINT} SELECT scenario, frm, array_to_string(list_sort(['l_t1 >= ' || CAST(la AS VARCHAR), 'l_t1 <= ' || CAST(ha AS VARCHAR),
  'l_t1 >= ' || CAST(lb AS VARCHAR), 'l_t1 <= ' || CAST(hb AS VARCHAR)]), ' AND ') AS guard FROM jg""")
def dnf_conjoin(spark, d):
    return joint_guards(spark, d).select("scenario", "frm", guards.guard_text(F.col("joint")).alias("guard"))


@query("guard_unsat", f"""{JOINT} SELECT scenario, frm, greatest(la, lb) > least(ha, hb) AS unsat FROM jg""")
def guard_unsat(spark, d):
    return joint_guards(spark, d).select("scenario", "frm", guards.unsat(F.col("joint")).alias("unsat"))


@query("negate_condition", """SELECT event_id, CASE WHEN value > 100 THEN '<=' WHEN value > 50 THEN '>' WHEN value > 25 THEN '='
  WHEN value > 12 THEN '<>' WHEN value > 6 THEN '<' WHEN value > 3 THEN '>=' ELSE '=' END AS op FROM events""")
def negate_condition(spark, d):
    from .trace import table

    v = F.col("value")
    op = (F.when(v > 100, ">").when(v > 50, "<=").when(v > 25, "<>").when(v > 12, "=").when(v > 6, ">=")
          .when(v > 3, "<").otherwise("??"))
    return table(spark, d, "events").select("event_id", guards.negated(op).alias("op"))
