"""The pipeline as a whole on small odd tables."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from sluicewatch.llm import token_files

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    def write(docs, benchmark=(), labels=()):
        path = str(tmp_path / f"t{len(docs)}")
        spark.createDataFrame(list(docs), SHAPE).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        return path

    return write


def test_run_on_odd_tables(spark, folder):
    """NULLs everywhere, empty texts, copies and repeated rows; no labels, a benchmark of one item."""
    item = "one two three four five six seven eight"
    texts = ["a b c d e f g", "a b c d e f g", None, "", "q r s t u v", f"so {item} it was", "word " * 3000, "é ü"]
    rows = [(i, t, None, None if i % 3 == 0 else f"s{i % 2}", 1) for i, t in enumerate(texts)] + [(4, texts[4], "en", "s0", 1), (None, "x y z", None, None, None)]
    out = corpus_pipeline.run(spark, folder(rows, [(1, item), (2, None), (None, "x y z q r s")])).collect()
    ids = {r.doc_id for r in out}
    assert 1 not in ids and 5 not in ids and ids and ids <= {0, 2, 3, 4, 6, 7, None}  # the mix may leave out some
    whole = token_files.encoder(token_files.default_path()).tokenizer
    want = {i: zlib.crc32(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t, *_ in rows}
    cut = [r for r in out if r.ids_crc32 != want[r.doc_id]]
    assert len(cut) <= 3  # a source's last document is cut at its budget
    assert sorted(r.start for r in out) == np.concatenate([[0], np.cumsum(
        [r.n_tokens for r in sorted(out, key=lambda r: r.start)])])[:-1].tolist()


def test_run_on_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).count() == 0
