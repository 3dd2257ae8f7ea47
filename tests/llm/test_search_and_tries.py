import random

import numpy as np
import pytest

import brute
from sluicewatch.llm import conversation_trie, lexical_search, similarity_sketch
from sluicewatch.llm.jaccard import document_sets


@pytest.fixture(params=[0, 24])
def shards(spark, request):
    """Both with as few tasks as there is work for, and with many."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    if request.param:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def nodes(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, p string, depth int")
    made = conversation_trie.prefix_trie(*conversation_trie.with_borrowed_starts(conversation_trie.turn_digests(table)))
    assert made.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, made.collect()), key=repr)


def test_trie_matches_brute_force(spark, shards, monkeypatch):
    monkeypatch.setattr(conversation_trie, "STRETCH", 3)
    rnd = random.Random(shards)
    rows = []
    for c in [*range(60), 75, 200, 10**12, -7, -20]:
        kind = rnd.randrange(4)
        for turn in range(rnd.randrange(9)):
            text = f"turn {turn % 2} of {kind}" if rnd.random() < 0.8 else f"own {rnd.randrange(3)}"
            rows.append((c, turn if turn else None, rnd.choice(["user", None, ""]) if turn else "user", text))
    for c in range(300, 340):  # copies of a long one, and such as stop earlier
        rows += [(c, turn, "a", f"word {turn}") for turn in range(30 if c % 3 else 12 + c % 5)]
    rows += [(400, i, "u", "w " * (i % 7)) for i in range(200)] + [(None, 1, "u", "no id"), (7, 99, None, None), (420, 0, "", "é " * 20_000)]
    rnd.shuffle(rows)
    assert nodes(spark, rows) == brute.conversation_trie(rows)


def test_trie_of_few_and_none(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "u", "x")]) == []
    # 3 takes its two turns from the absent 0, so it has none left; ties of one turn number and repeated rows stay
    for rows in ([(3, 1, "u", "x")], [(4, None, None, None)], [(25, 1, "u", "x"), (25, 2, "u", "x")]):
        assert nodes(spark, rows) == brute.conversation_trie(rows)
    twice = nodes(spark, [(20, 1, "u", "same"), (20, 1, "u", "same")])
    assert [r[1] for r in sorted(twice, key=lambda r: r[1])] == [0, 1, 2]


def test_parentheses_find_closing_places():
    rnd = random.Random(1)
    for size in (1, 5, 700, 5000):
        depth, paths = [], 0
        for _ in range(size):
            paths = rnd.randint(1, min(paths + 1, 900)) if depth and rnd.random() < 0.7 else paths + 1 if depth else 0
            depth.append(max(paths, 0 if not depth else 1))
        depth = np.array(depth)
        depth[0] = 0
        for i in range(1, size):
            depth[i] = min(depth[i], depth[i - 1] + 1)
        tree = conversation_trie.Parentheses(depth)
        stack, closing = [], {}
        for place, bit in enumerate(tree.bits.tolist()):
            if bit:
                stack.append(place)
            else:
                closing[stack.pop()] = place
        assert not stack and tree.close(tree.open).tolist() == [closing[p] for p in tree.open.tolist()]


def test_near_duplicates_match_brute_force(spark, shards, monkeypatch):
    monkeypatch.setattr(similarity_sketch, "CHUNK", 5)
    monkeypatch.setattr(similarity_sketch, "CELL", 7)
    monkeypatch.setattr(similarity_sketch, "CROSS", 0)
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for size in (60, 25, 4, 2, 1, 6):
        base = [rnd.choice(words) for _ in range(rnd.randint(50, 90))]
        for _ in range(size):
            text = list(base)
            for _ in range(rnd.randint(0, 4)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((0, " ".join(text)))
    rows += [(0, t) for t in ["", "a b", "A  b", None, "a b c", "a b c d", "x", "\t \n", "x " * 5000]] + rows[:9]
    rnd.shuffle(rows)
    rows = [(i * 3, t.upper() if t and i % 3 == 0 else t) for i, (_, t) in enumerate(rows)]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, bands string").repartition(5)
    out = similarity_sketch.near_duplicates(table).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.jaccard(rows, 4, 80)
    assert all(r.first == (r.doc_id == r.component_id) for r in out) and len(out) == len(rows)


def test_near_duplicates_repeated_ids_and_empty_table(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (7, None), (7, "q r s t"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.first) for r in similarity_sketch.near_duplicates(table).collect())
    assert got == [("5", 2, "5", False), ("5", 2, "5", True), ("7", 0, "7", True), ("7", 1, "7", True),
                   ("None", 0, "None", True), ("None", 2, "5", False)]
    assert similarity_sketch.near_duplicates(table.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    for size in (1, 2, 7, 60, 4000):
        for _ in range(20):
            both = np.unique(rng.integers(0, 2**63, 2 * size).astype(np.uint64))
            own = max(1, size // 10)
            a, b = np.sort(both[own:]), np.sort(both[:-own]) if len(both) > own else both
            a = a if len(a) else both
            found, of = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
            s = similarity_sketch.sketches(found, of, 3)
            assert (s[:2] != similarity_sketch.EMPTY).all() and (s[2] == similarity_sketch.EMPTY).all()
            same, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            assert abs((s[0] == s[1]).mean() - same / union) < 0.35
            maps = similarity_sketch.Maps(similarity_sketch.parities(found, of, 3))
            assert maps.apart(np.array([0, 0]), np.array([1, 0])).tolist()[1] == 0
            assert maps.apart(np.array([0]), np.array([1]))[0] <= union - same
    found, of = document_sets(np.frombuffer(b"a b c d e", np.uint8), np.array([9]))
    assert (similarity_sketch.sketches(found, of, 1) == similarity_sketch.sketches(found[::-1], of, 1)).all()


@pytest.mark.parametrize(("block", "postings", "step"), [(10**6, 10**6, 4096), (7, 40, 3), (1, 1, 1)])
def test_search_matches_brute_force(spark, shards, monkeypatch, block, postings, step):
    monkeypatch.setattr(lexical_search, "POSTINGS", postings)
    monkeypatch.setattr(lexical_search, "STEP", step)
    rnd = random.Random(block)
    common, rare = [f"c{i}" for i in range(8)], [f"r{i}é" for i in range(60)]
    docs = [(i, " ".join(rnd.choice(common) if rnd.random() < 0.7 else rnd.choice(rare) for _ in range(rnd.randint(0, 40)))) for i in range(150)]
    docs += [(200, None), (201, "?!"), (202, "C1-C2 " * 3000), (203, docs[3][1]), (204, docs[3][1])]
    items = [(i, " ".join(rnd.sample(common, 3) + rnd.sample(rare, 4))) for i in range(6)] + [(7, None), (8, "none of these"), (9, "C1, c1; R5É r5é")]
    rnd.shuffle(docs)
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, score int")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, rank string")
    got = {}
    for r in sorted(lexical_search.search(table, bench, block_terms=block).collect(), key=lambda r: (r.item_id, r["rank"])):
        got.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(got[r.item_id])
    assert got == {i: v for i, v in brute.ranked(docs, items).items() if v}


def test_search_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (1, "a"), (None, "C")], "item_id long, text string")
    got = sorted((str(r.item_id), r["rank"], str(r.doc_id)) for r in lexical_search.search(docs, items).collect())
    assert got == [("1", 1, "1"), ("1", 1, "1"), ("1", 2, "1"), ("1", 2, "1"), ("1", 3, "None"), ("1", 3, "None"), ("None", 1, "2")]
    assert lexical_search.search(docs.limit(0), items).count() == 0 and lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
