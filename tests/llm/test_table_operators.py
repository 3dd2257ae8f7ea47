import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from sluicewatch.llm import kdtree, mixing, quality, token_files, toxicity, warc
from sluicewatch.llm.common import read, shared_path
from sluicewatch.llm.words import pieces

SF = "/root/testdata/sf0.001"


def test_warc_round_trip_and_skipping(spark, tmp_path):
    long = "é" * 600
    rows = [(1, "u1", long), (2, "u2", long), (3, None, "short"), (4, "u4", None), (5, "u5", "short"), (None, "u6", long),
            (2, "u2", long), (7, "u7", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "payload") for r in rows], "page_id long, url string, html string, payload string")
    folder = str(tmp_path / "w")
    warc.write_pages(pages, folder)
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_pages(spark, folder).collect())
    assert got == sorted([("1", 1200, "revisit", 2), ("2", 1200, "response", None), ("3", 5, "response", None),
                          ("4", 0, "response", None), ("5", 5, "response", None), ("None", 1200, "revisit", 2),
                          ("2", 1200, "response", None), ("7", 300_000, "response", None)])
    one = spark.read.format("sluice_warc").load(folder).filter("target_uri = 'u7'")
    assert one.first().payload == b"x" * 300_000 and one.count() == 1
    assert spark.read.format("sluice_warc").load(folder).filter("warc_type = 'warcinfo'").count() >= 1
    empty = str(tmp_path / "e")
    warc.write_pages(pages.limit(0), empty)
    assert warc.read_pages(spark, empty).count() == 0


def test_warc_reads_plain_and_foreign_records(spark, tmp_path):
    import gzip

    raw = [warc.record({"WARC-Type": k, "WARC-Record-ID": f"<r{i}>"}, b"body %d" % i) for i, k in enumerate(["a", "b", "a"])]
    (tmp_path / "p.warc").write_bytes(b"".join(raw))
    (tmp_path / "g.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    (tmp_path / "s.warc.gz").write_bytes(b"".join(map(warc.member, raw)))
    warc.register(spark)
    got = spark.read.format("sluice_warc").load(str(tmp_path)).filter("warc_type = 'a'").collect()
    assert sorted(bytes(r.payload) for r in got) == [b"body 0"] * 3 + [b"body 2"] * 3


def test_mixing_budgets(spark):
    rnd = random.Random(2)
    rows = [(i, f"s{i % 4}" if i % 9 else None, "w " * rnd.randint(0, 30), 1) for i in range(200)]
    rows += [(3, "s3", "dup dup", 1), (3, "s3", "dup dup", 1), (None, "tiny", "one", 1), (900, "zero", " ", 1), (901, "zero", None, 1)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string, taken int")
    out = mixing.mix(table).collect()
    assert len(out) == len(rows)
    total, targets = sum(r["size"] for r in out), {}
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        targets[s] = own[0].target
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 and own[0].source_size == sum(r["size"] for r in own)
        assert all(0 <= r.taken <= 3 * r["size"] for r in own) and own[0].target <= 3 * own[0].source_size
    assert abs(sum(targets.values()) - total) < 1e-6 and sorted(map(str, out)) == sorted(map(str, mixing.mix(table).collect()))
    mixed = mixing.expand(table)
    assert mixed.columns == table.columns
    words = mixed.select(F.sum(mixing.words_in(F.col("text")))).first()[0]
    assert words == sum(r.taken for r in out)
    assert mixing.mix(table.limit(0)).count() == 0 and mixing.expand(table.limit(0)).count() == 0


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=5).round(2)], "x") for i in range(0, 1500, 5)]
    rows += [(1, rows[0][1], "x"), (2, rows[0][1], "x"), (2, rows[0][1], "x"), (3, None, "x"), (4, [1.0, None, 0.0, 0.0, 0.0], "x"),
             (6, [float("nan")] * 5, "x"), (None, [1.0] * 5, "x"), (7, [], "x"), (8, [2.0, 1.0], "x"), (9, [float("inf")] * 5, "x")]
    points = kdtree.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"))
    known = {r.vec_id: [int(x) for x in r.point] + [0] * (5 - len(r.point)) for r in points.collect()}
    assert set(known) == {i for i, _, _ in rows if i is not None and i not in (3, 4, 6, 7, 9)}
    want = brute.top(known, {q: v for q, v in known.items() if q % 100 == 0}, 4)
    for rows_, block in ((100, 7), (10**6, 100)):
        got = {}
        for r in kdtree.search(points, points.filter("vec_id % 100 = 0"), 4, rows_, block).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert got == want
    assert kdtree.search(points, points.limit(0)).count() == 0


ODD = ["", "  ", None, "a.b,c.. x's it's <|endoftext|>x", "Ünï, cödé. é, ́ a K, İ. ΣΑΣ. x\x1cy, ﬁ. 1,2 3. ’s, foo,. a‍b", "\t\n x ", "A.",
       "x" * 5000, "don't, stop. i'll,", "İ, ß. ŉ,"]


def test_token_files_round_trip(spark):
    texts = [*ODD, *[r.text for r in read(spark, SF, "documents").orderBy("doc_id").limit(60).collect()]]
    rows = [(i * 3 - 9, t) for i, t in enumerate(texts)] + [(None, "last"), (0, "again"), (0, "again")]
    folder = shared_path(spark, "t")
    token_files.write_tokens(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int"), folder)
    whole = token_files.encoder(token_files.default_path()).tokenizer
    want = sorted(((i is not None, i or 0), [*whole.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows)
    stored = token_files.read_tokens(spark, folder).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids) for r in stored) == want
    start, got = 0, sorted(token_files.digests(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None if not k[0] else k[1] for k, _ in want]
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for _, x in want)
    token_files.write_tokens(read(spark, SF, "documents").limit(0), empty := shared_path(spark, "t"))
    assert token_files.digests(spark, empty).count() == 0


def test_encoder_takes_every_character(monkeypatch):
    """Ids equal those of whole texts for all of Latin-1, marks, special strings, and with little remembered."""
    rnd = random.Random(3)
    pool = [chr(i) for i in range(256)] + [*"\u0301\u030c\u0307\u0130\u03a3\u1e9e\u2028\u200b\u6f22\ufb01JIabZ3. ,\n", "<|endoftext|>", "<|EndOfText|>", "'LL"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for _ in range(4000)] + [None, "", "J\u030c j\u030c"]
    texts += [chr(c) + x for c in range(256) for x in (".a", ",b", "A.")]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for name, most in (("word_bpe_49k.json", 5000), ("byte_bpe_50k.json", 10**6)):
        own = token_files.Encoder(token_files.default_path().replace("word_bpe_49k.json", name), remembered=200)
        assert own.chunked == (name == "word_bpe_49k.json")
        for part, data, ends in pieces(batch, most=most):
            ids, lengths = own.encode(data, ends)
            cuts = np.concatenate([[0], np.cumsum(lengths)])
            for i, text in enumerate(texts[part]):
                assert ids[cuts[i]:cuts[i + 1]].tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_files_skip_stripes(spark, tmp_path):
    """A filter on doc_id reaches the files, and only rows of groups that may hold the id are read."""
    folder = str(tmp_path / "t")
    rows = spark.range(0, 60_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 97).alias("text"))
    token_files.write_tokens(rows.coalesce(1), folder)
    for wanted, n in ((30_000, 1), (30_001, 0)):
        one = token_files.tokens_of(spark, folder, [wanted])
        assert one.count() == n
        plan = one._jdf.queryExecution().executedPlan()
        assert "PushedFilters: [" in plan.toString() and "doc_id" in plan.toString().split("PushedFilters: [")[1].split("]")[0]
    assert token_files.tokens_of(spark, folder, [0, 2, 4, 5, None]).count() == 3


@pytest.mark.parametrize("module", ["quality", "toxicity"])
def test_classifiers_learn_and_take_any_text(spark, module):
    rnd = random.Random(1)
    good = lambda: " ".join(rnd.choice(["the", "river", "house", "green", "walked", "slowly"]) for _ in range(40))
    bad = (lambda: good() + " idiot stupid") if module == "toxicity" else (lambda: "SPAM!! " * 40)
    label = {"quality": lambda b: int(not b), "toxicity": int}[module]
    texts = [(i, bad() if i % 2 else good()) for i in range(160)]
    table = spark.createDataFrame([(*t, "x") for t in [*texts, (None, None), (500, ""), (501, "\n"), (502, "z" * 100_000), (0, good())]],
                                  "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, label(i % 2)) for i, _ in texts] + [(None, 1), (7, None), (9999, 1)],
                                   f"doc_id long, {'quality' if module == 'quality' else 'toxic'} int")
    if module == "quality":
        run = lambda t, y: quality.quality_scores(t, y, ["doc_id"])
        held = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 4 == 2]
    else:
        run = lambda t, y: toxicity.toxicity(t, y, toxicity.fold(F.col("doc_id"), 3) == 1)
        held = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 3 == 1]
    got = {r.doc_id: r.score for r in run(table, labels).collect()}
    assert len(got) == 164 and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.5) == bool(label(i % 2)) for i in held if i]
    assert sum(right) >= 0.95 * len(right)
    assert run(table.limit(0), labels).count() == 0 and run(table, labels.limit(0)).count() == 165


def test_unseen_misspellings_share_n_grams():
    clean = [["calm", f"w{i}", "river", "house"] for i in range(40)]
    toxic = [["calm", f"w{i}", "stupid", "house"] for i in range(40)]
    each, _, _ = toxicity.train(clean + toxic, [[1] * 4] * 80, np.array([0] * 40 + [1] * 40))
    assert each[toxicity.grams("stuppid")].mean() > 5 * abs(each[toxicity.grams("calmer")].mean())


def test_pipeline_against_brute_force(spark):
    documents = read(spark, SF, "documents")
    kept = corpus_pipeline.keep_good(spark, documents, SF)
    scores = quality.quality_scores(documents, read(spark, SF, "labels"), ["doc_id"]).filter("score >= 0.7")
    first = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == documents.columns and set(first) == {r.doc_id for r in scores.collect()}
    second = {r.doc_id: r for r in corpus_pipeline.keep_one_of_similar(spark, kept, SF).collect()}
    linked = brute.jaccard([(i, r.text) for i, r in first.items()], 5, 80)
    assert set(second) == {i for i, (_, c) in linked.items() if i == c} and all(second[i] == first[i] for i in second)
    second_table = spark.createDataFrame(pd.DataFrame([r.asDict() for r in second.values()]), documents.schema)
    third = corpus_pipeline.drop_benchmark(spark, second_table, SF)
    words = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()
    items = [words(r.text) for r in read(spark, SF, "benchmark").collect()]
    leaky = {i for i, r in second.items() if any(f" {' '.join(x)} " in f" {' '.join(words(r.text))} " for x in items if len(x) >= 5)}
    assert {r.doc_id for r in third.collect()} == set(second) - leaky
    mixed = corpus_pipeline.mix_sources(spark, third, SF)
    assert mixed.columns == documents.columns
    size = F.sum(mixing.words_in(F.col("text")))
    assert abs(mixed.select(size).first()[0] - third.select(size).first()[0]) <= 20
    out = corpus_pipeline.write_tokens(spark, mixed, SF).collect()
    assert len(out) == mixed.count() and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)
    assert {r.doc_id for r in out} == {r.doc_id for r in mixed.collect()}


def test_quality_keeps_what_no_label_rejects(spark):
    rows = [(i, f"Some words, number {i}.") for i in range(20)] + [(20, None), (21, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(r.doc_id for r in quality.good(table, labels).collect()) == list(range(22))
    bad = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, quality int")
    assert sorted(r.doc_id for r in quality.good(table, bad).collect()) == [20, 21]


def test_encoder_starts_small():
    """Workers live on beside the JVM of their executor, so what one sets aside before any text counts."""
    own = token_files.Encoder(token_files.default_path())
    assert sum(x.nbytes for x in vars(own).values() if hasattr(x, "nbytes")) < 16 << 20
