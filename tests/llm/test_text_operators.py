import functools
import hashlib
import random

import numpy as np
import pytest

import brute
from pyspark.sql import functions as F

from sluicewatch.llm import jaccard, licences, substrings, tiling
from sluicewatch.llm import common
from sluicewatch.llm.common import components, running_sums
from sluicewatch.llm.words import pieces

SHAPE = "doc_id long, text string, score string, key int"


def docs(spark, rows):
    """Rows (doc_id, text) with two more columns whose names operators use as well."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SHAPE).repartition(3)


@pytest.mark.parametrize(("length", "hot"), [(10, 10**9), (20, 1)])
def test_substrings_match_brute_force(spark, length, hot):
    rnd = random.Random(length)
    base = ["".join(rnd.choice("abc d") for _ in range(rnd.randint(0, 80))) for _ in range(20)]
    rows = [(i, "".join(rnd.choice(base)[:rnd.randint(0, 80)] for _ in range(rnd.randint(0, 5)))) for i in range(90)]
    rows += [(90, None), (91, ""), (92, "ab" * 60), (93, "é" * 40), (94, "x" * 3000), (95, rows[7][1]), (96, rows[7][1])]
    out = substrings.deduplicate(docs(spark, rows), length, 3, hot).collect()
    got = {r.doc_id: (r.n_bytes, sum(s.length for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out}
    assert got == brute.substrings(rows, length)


def test_substrings_repeated_and_missing_ids(spark):
    rows = [(1, "abcdefghijklmnop"), (1, "abcdefghijklmnop"), (None, "abcdefghijklmnop"), (2, "zz")]
    got = sorted((str(r.doc_id), len(r.kept)) for r in substrings.deduplicate(docs(spark, rows), 10, 2).collect())
    assert got == [("1", 0), ("1", 16), ("2", 2), ("None", 0)]
    assert substrings.deduplicate(docs(spark, []), 10, 2).count() == 0


def test_substrings_stretches_alike_in_half_their_fingerprint(spark):
    """Of many stretches around one passage, two that differ but whose fingerprints share 32 bits."""
    rng = np.random.default_rng(4)
    n, around, passage = 300_000, 10, np.frombuffer(b"passage", np.uint8)
    data = np.concatenate([rng.integers(97, 123, (n, around), np.uint8), np.tile(passage, (n, 1)),
                           rng.integers(97, 123, (n, around), np.uint8)], axis=1)
    size = data.shape[1]
    s = substrings.Stretches(data.ravel(), np.arange(1, n + 1) * size, 10)
    order = np.lexsort((s.whole, s.seed))
    seed, whole = s.seed[order], s.whole[order]
    alike = np.flatnonzero((seed[1:] == seed[:-1]) & (whole[1:] >> np.uint64(32) == whole[:-1] >> np.uint64(32)) & (whole[1:] != whole[:-1]))
    pairs = [(s.doc[order[i]], s.doc[order[i + 1]]) for i in alike.tolist()]
    assert pairs
    rows = [(k, data[d].tobytes().decode()) for k, d in enumerate(x for pair in pairs[:5] for x in pair)]
    out = substrings.deduplicate(docs(spark, rows), 10, 2).collect()
    got = {r.doc_id: (r.n_bytes, sum(x.length for x in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out}
    assert got == brute.substrings(rows, 10)


@pytest.mark.parametrize(("small", "hot"), [(64, 10**6), (4, 20)])
def test_jaccard_matches_brute_force(spark, monkeypatch, small, hot):
    monkeypatch.setattr(jaccard, "ROW", 20)
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for size in (40, 30, 3, 2, 1, 5):
        base = [rnd.choice(words) for _ in range(rnd.randint(40, 80))]
        for _ in range(size):
            text = list(base)
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", "a b", "A  b", None, "a b c", "a b c d", "x", "\t \n", "x " * 5000])]
    rows = [(i, t.upper() if t and i % 3 == 0 else t) for i, t in rows]
    out = jaccard.similar_groups(docs(spark, rows), small=small, hot=hot).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.jaccard(rows, 4, 85)


def test_jaccard_repeated_ids_and_empty_table(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (7, None), (7, "q r s t")]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs(spark, rows)).collect())
    assert got == [("5", 2, 5), ("5", 2, 5), ("7", 0, 7), ("7", 1, 7), ("None", 2, 5)]
    kept = jaccard.one_of_each(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "score", "key"]
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == [(5, "a b c d e"), (7, "q r s t")]
    assert jaccard.similar_groups(docs(spark, [])).count() == 0


def test_jaccard_unsorted_copies_in_several_pieces_and_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(jaccard, "pieces", functools.partial(pieces, most=300))
    rnd = random.Random(11)
    texts = []
    for _ in range(8):
        base = [f"w{rnd.randrange(500)}" for _ in range(60)]
        texts += [" ".join(base)] * 6 + [" ".join([*base, "tail"])] * 2 + [" ".join(["head", *base])]
    ids = rnd.sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    rnd.shuffle(rows)
    wanted = brute.jaccard(rows, 4, 85)
    for parts in (1, 3):
        path = f"{tmp_path}/{parts}"
        for i in range(parts):
            docs(spark, rows[i::parts]).coalesce(1).write.mode("append").parquet(path)
        table = spark.read.parquet(path)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(table).collect()}
        assert got == wanted
        assert sorted(r.doc_id for r in jaccard.one_of_each(table).collect()) == sorted({c for _, c in wanted.values()})
    near = "a b c d e f g h i j k l m n o p q r s t"
    few = spark.createDataFrame([(100, near), (50, "z " * 200), (5, near), (7, near + " u")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(few).collect()}
    assert got == {100: 5, 50: 50, 5: 5, 7: 5}


def test_suffix_filter_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(2))
        apart = len(np.setxor1d(a, b))
        assert jaccard.suffix_allows(a, b, 1000) <= apart
        assert jaccard.suffix_allows(a, b, apart) <= apart


def test_licence_base_and_labels(spark):
    rows = [(1, "x Under the MIT License. under the mit-license"), (2, "Apache License, Version 2.0"), (3, None), (4, ""),
            (5, "CC BY-NC cc by\nnc"), (6, "é license"), (7, "This work is licensed under the GNU General Public License, version 3."),
            (8, "the license of mit under " * 400), (1, "x Under the MIT License. under the mit-license"), (None, "cc by nc"),
            (9, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files")]
    out = licences.scan(docs(spark, rows))
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out.collect())
    assert got == sorted((str(i), *brute.licence_base(t, licences.BASE)) for i, t in rows)
    labels = {r.doc_id: (r.labels, r.score) for r in out.collect()}
    assert labels[7] == ("gpl-3", 1.0) and labels[9][0] == "mit" and labels[3] == ("", 0.0) and labels[8] == ("", 0.0)
    assert "Python" not in out._jdf.queryExecution().toString() and licences.scan(docs(spark, [])).count() == 0


def test_licence_file_of_all_templates(spark):
    texts = [text for _, text, _ in licences.TEMPLATES]
    some = [text for label, text, _ in licences.TEMPLATES if label in ("bsd", "isc", "gpl-3")] + [texts[1]]
    rows = [(1, ". ".join(texts)), (2, " filler words\n".join(reversed(texts))), (3, " and also ".join(some)), (4, "nothing of the kind")]
    got = {r.doc_id: (r.labels, r.score) for r in licences.scan(docs(spark, rows)).collect()}
    every = ",".join(sorted({label for label, _, _ in licences.TEMPLATES}))
    assert got == {1: (every, 1.0), 2: (every, 1.0), 3: ("bsd,gpl-3,isc,mit", 1.0), 4: ("", 0.0)}


def test_tiles_match_brute_force():
    rnd = random.Random(5)
    for _ in range(60):
        text = [rnd.randrange(6) for _ in range(rnd.randint(0, 60))]
        item = [rnd.randrange(6) for _ in range(rnd.randint(3, 25))]
        cut = sum(k for _, _, k in tiling.tiles(np.array(item, np.uint64), np.array(text, np.uint64), np.zeros(len(text), bool), 3))
        assert cut == brute.greedy_tiles(item, text, 3)


def test_leaks_match_brute_force(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 30)))) for i in range(12)]
    rows = []
    for i in range(60):
        text = [rnd.choice(words) for _ in range(rnd.randint(0, 40))]
        if i % 2:
            own = rnd.choice(items)[1].split()
            cut = rnd.randint(0, len(own))
            text += own[cut:] + [rnd.choice(words)] + own[:cut]
        rows.append((i, " ".join(text)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.covered for r in tiling.leaks(docs(spark, rows), bench, 4).collect()}
    want = {(d, i): brute.greedy_tiles(item.split(), text.split(), 4) for d, text in rows for i, item in items}
    assert got == {k: c for k, c in want.items() if c and c >= 0.6 * len(items[k[1]][1].split())} and len(got) > 20


def test_leaks_whole_reordered_and_partial(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    swapped = "Zeta eta, theta iota KAPPA! and then alpha beta gamma delta epsilon."
    rows = [(1, f"intro words {item} outro"), (2, swapped), (3, "alpha beta gamma delta epsilon and more"), (4, None), (5, ""),
            (1, f"intro words {item} outro"), (None, item), (6, "word " * 5000 + item.upper())]
    bench = spark.createDataFrame([(10, item), (11, "too short"), (12, None), (None, item)], "item_id long, text string")
    found = tiling.leaks(docs(spark, rows), bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.n_tiles, r.coverage) for r in found) == [
        ("1", 10, 1, 1.0), ("1", 10, 1, 1.0), ("2", 10, 2, 1.0), ("6", 10, 1, 1.0), ("None", 10, 1, 1.0)]
    assert {(r.first_word, r.last_word) for r in found if r.doc_id == 1} == {(2, 11)}
    assert tiling.leaks(docs(spark, rows), bench.filter("text IS NULL")).count() == 0
    assert tiling.without_leaks(docs(spark, rows), bench.limit(0)).count() == len(rows)
    kept = tiling.without_leaks(docs(spark, rows).withColumn("row", F.lit(1)), bench)
    assert kept.columns == ["doc_id", "text", "score", "key", "row"]
    monkeypatch.setattr(tiling, "FILTER_BITS", 6)  # a filter that lets nearly all seeds pass
    assert sorted(map(str, tiling.leaks(docs(spark, rows), bench).collect())) == sorted(map(str, found))
    assert sorted(r.doc_id for r in tiling.without_leaks(docs(spark, rows), bench).collect()) == [3, 4, 5]
    assert tiling.leaks(docs(spark, []), bench).count() == 0 and tiling.leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_only_texts_of_pairs_are_moved(spark, monkeypatch):
    rows = spark.range(3_000).select(F.col("id").alias("key"), F.lit("x").alias("text"))
    keys = spark.createDataFrame([(k,) for k in (5, 7, 7, 2_999, 4_000)], "key long")
    for bits in (26, 8):
        monkeypatch.setattr(common, "KEY_BITS", bits)
        found = {r.key for r in common.holding(rows, keys).collect()}
        assert found >= {5, 7, 2_999} and len(found) < (10 if bits == 26 else 200)
        assert sorted(r.key for r in common.without(rows, keys).collect()) == sorted(set(range(3_000)) - {5, 7, 2_999})
    assert common.holding(rows, keys.limit(0)).count() == 0 and common.without(rows, keys.limit(0)).count() == 3_000
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = tiling.leaks(docs(spark, [(1, item), (2, "some other text")]), bench)
    assert "marked(" in found._jdf.queryExecution().toString() and [r.doc_id for r in found.collect()] == [1]
    texts = spark.createDataFrame([(1, item), (2, item + " more"), (3, "some other text")], "key long, text string")
    checked = jaccard.linked(spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), texts, 4, 85)
    assert "marked(" in checked._jdf.queryExecution().toString() and [tuple(r) for r in checked.collect()] == [(1, 2)]


def test_components_and_running_sums(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(3, 3), (100, 5), (5, 100)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: i // 10 * 10 for i in range(40)} | {100: 0}
    rows = [("a", i, i % 4) for i in range(50)] + [(None, 1, 2), (None, 2, 3)]
    out = running_sums(spark.createDataFrame(rows, "g string, o long, v long"), ["g"], ["o"], ["v"]).collect()
    assert all(r.before_v == sum(v for g, o, v in rows if g == r.g and o < r.o) for r in out) and len(out) == 52
