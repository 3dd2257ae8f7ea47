"""Rules of several bins against plain Python."""

import itertools
import random
from collections import Counter

import numpy as np

from sluicewatch.operators import detectors, mining

FEATURES = ["a", "b", "c", "d"]


def brute(rows, most_a, most_c, min_support, min_confidence, min_rows):
    out = {}
    for state in {r[0] for r in rows}:
        own = [dict(zip(FEATURES, r[1:], strict=True)) for r in rows if r[0] == state]
        if len(own) < min_rows:
            continue
        cuts = {}
        for f in FEATURES:
            v = [r[f] for r in own if r[f] is not None and r[f] == r[f]]
            cuts[f] = np.percentile(v, [25, 50, 75]) if v else []
        items = [frozenset((f, int(sum(r[f] > cuts[f]))) for f in FEATURES if r[f] is not None and r[f] == r[f]) for r in own]
        n = Counter(frozenset(s) for i in items for k in range(1, 5) for s in itertools.combinations(sorted(i), k))
        for s, both in n.items():
            for k in range(1, len(s)):
                for left in map(frozenset, itertools.combinations(sorted(s), k)):
                    right = s - left
                    if len(left) <= most_a and len(right) <= most_c and both / len(own) >= min_support and both / n[left] >= min_confidence:
                        out[state, tuple(sorted(left)), tuple(sorted(right))] = (both, round(both / n[left] * len(own) / n[right], 9))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "state string, a double, b double, c double, d double")


def test_rules_of_several_bins_match_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for state, size in (("s", 400), ("t", 120), ("few", 20)):
        for _ in range(size):
            a, b = rnd.random(), rnd.randrange(4)
            c = a + b if rnd.random() < 0.9 else rnd.random() * 5
            rows.append((state, a, float(b), c if rnd.random() < 0.95 else None, float("nan") if rnd.random() < 0.1 else float(a > 0.5)))
    for most_a, most_c in ((3, 1), (2, 2), (1, 1)):
        rules = mining.mine_rules(table(spark, rows), FEATURES, most_a, most_c, 0.03, 0.7, 50).collect()
        got = {(r.state, tuple((x.f, x.b) for x in r.antecedent), tuple((x.f, x.b) for x in r.consequent)): (r.n_both, round(r.lift, 9)) for r in rules}
        want = brute(rows, most_a, most_c, 0.03, 0.7, 50)
        assert got == want and len(rules) == len(got) and max(len(k[1]) for k in got) == most_a
    one = next(r for r in rules if r.state == "s")
    x = one.antecedent[0]
    v = [r[1 + FEATURES.index(x.f)] for r in rows if r[0] == "s"]
    inside = [y for y in v if y is not None and x.lo <= y <= x.hi]
    assert x.lo in v and x.hi in v and len(inside) == one.n_antecedent
    assert len({r.id for r in rules if r.state == "s"}) == sum(r.state == "s" for r in rules)


def test_rule_sets_flag_rows_that_break_them(spark):
    rows = [("s", float(i % 4), float(i % 4), float(i % 3), 1.0) for i in range(200)]
    df = table(spark, rows)
    phi = mining.rule_sets(mining.mine_rules(df, FEATURES, 2, 1, 0.1, 0.9, 50), mining.state_support(df))
    one = phi.first()
    assert any(len(r.antecedent) == 2 for r in one.rules) and one.observations == 200
    test = table(spark, [("s", 0.0, 0.0, 1.0, 1.0), ("s", 0.0, 3.0, 1.0, 1.0), ("new", 0.0, 0.0, 0.0, 0.0)])
    flags = detectors.phi_flags(test, phi, FEATURES, 1).orderBy("state", "b").collect()
    assert [r.y_pred_invariants for r in flags] == [1, 0, 1]


def test_rules_of_nothing(spark):
    assert mining.mine_rules(table(spark, []), FEATURES).count() == 0
    assert mining.mine_rules(table(spark, [("s", None, None, None, None)] * 60), FEATURES).count() == 0
