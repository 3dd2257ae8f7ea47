"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's terms are the shapes of its characters (runs of letter case, digits, blanks and
signs) and how soon its words come again. Terms are weighted by tf-idf with document frequencies
of the whole table and projected on the leading singular vectors of the labelled sample. Labelled
vectors are broadcast; each document's cosines with all of them are computed exactly in blocks,
and its nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import read
from .toxicity import fold, labelled
from .words import NOT_ALNUM, WHITE, pieces, words

#: Terms: hashed shape n-grams, then the classes of the gap between a word and its last use.
SHAPES = 1 << 11
GAPS = 12
TERMS = SHAPES + GAPS + 1
LONGEST_SHAPE = 4
WIDTH = 48
NEIGHBOURS = 15
#: At most so many labelled rows of each class become neighbours; with WIDTH this bounds the broadcast.
SAMPLE_PER_CLASS = 2_000
BLOCK = 512
THRESHOLD = 0.7


def _classes() -> np.ndarray:
    """0 for blanks, 1 line end, 2 lower case and bytes above ASCII, 3 upper case, 4 digit, then one a sign."""
    out = np.full(256, 2, np.uint64)
    signs = [b for b in range(128) if NOT_ALNUM[b] and not WHITE[b]]
    out[signs] = 5 + np.arange(len(signs), dtype=np.uint64)
    out[WHITE] = 0
    out[10] = 1
    out[65:91] = 3
    out[48:58] = 4
    return out


CLASSES = _classes()


def term_counts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(documents x TERMS) counts. n-grams of shapes do not cross documents."""
    n, docs = len(data), len(ends)
    doc = np.repeat(np.arange(docs), np.diff(ends, prepend=0))
    shape = CLASSES[data]
    out = np.zeros((docs, TERMS), np.float32)
    code = np.zeros(n, np.uint64)
    for k in range(1, LONGEST_SHAPE + 1):
        code = code[:n - k + 1] * np.uint64(131) + shape[k - 1:] if k > 1 else shape + np.uint64(1)
        if not len(code):
            break
        whole = doc[:len(code)] == doc[k - 1:]
        bucket = ((code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(53)
        out[:, :SHAPES] += np.bincount(doc[:len(code)][whole] * SHAPES + bucket[whole].astype(np.int64),
                                       minlength=docs * SHAPES).reshape(docs, SHAPES)
    hashes, of_doc, _, _ = words(data, ends)
    if len(hashes):
        place = np.lexsort((np.arange(len(hashes)), hashes, of_doc))
        h, d = hashes[place], of_doc[place]
        gap = np.diff(place, prepend=0)
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (d[1:] == d[:-1])])
        kind = np.where(again, np.minimum(np.log2(np.maximum(gap, 1)), GAPS - 1).astype(np.int64), GAPS)
        out[:, SHAPES:] = np.bincount(d * (GAPS + 1) + kind, minlength=docs * (GAPS + 1)).reshape(docs, GAPS + 1)
    return out


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows each term stands, and the number of rows, over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, data, ends in pieces(batch):
                for a, b, own, own_ends in _blocks(data, ends):
                    total += (term_counts(own, own_ends) > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(np.append(total, rows))],
                                         names=["term", "n"])

    summed = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(TERMS + 1, np.int64)
    for term, n in summed.collect():  # one row a term
        out[term] = n
    return out[:TERMS], int(out[TERMS])


def _blocks(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a in range(0, len(ends), BLOCK):
        b = min(a + BLOCK, len(ends))
        start = ends[a - 1] if a else 0
        yield a, b, data[start:ends[b - 1]], ends[a:b] - start


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(sample: DataFrame, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(projection, vectors, labels) from the bounded labelled sample, in one task, rows by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows = [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            labels += batch.column("label").to_pylist()
            for _, data, ends in pieces(batch):
                rows += [weigh(term_counts(own, own_ends), idf) for _, _, own, own_ends in _blocks(data, ends)]
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        x = (np.concatenate(rows) if rows else np.zeros((0, TERMS), np.float32))[order].astype(np.float64)
        values, vectors = np.linalg.eigh(x.T @ x) if len(x) else (None, np.zeros((TERMS, WIDTH)))
        basis = np.ascontiguousarray(vectors[:, ::-1][:, :WIDTH])
        own = x @ basis
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
        yield pa.RecordBatch.from_arrays(
            [pa.array([basis.astype(np.float32).tobytes()]), pa.array([own.astype(np.float32).tobytes()]),
             pa.array([np.array(labels, np.int8)[order].tobytes()])], names=["basis", "vectors", "labels"])

    row = sample.repartition(1).mapInArrow(run, "basis binary, vectors binary, labels binary").first()
    if row is None:  # nothing to learn from
        return np.zeros((TERMS, WIDTH), np.float32), np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int8)
    return (np.frombuffer(row[0], np.float32).reshape(TERMS, WIDTH), np.frombuffer(row[1], np.float32).reshape(-1, WIDTH),
            np.frombuffer(row[2], np.int8))


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, k: int = NEIGHBOURS, unknown: float = 0.5) -> np.ndarray:
    """Share of label 1 among the k nearest, weighted by cosine; ``unknown`` with no neighbour above 0."""
    if not len(known):
        return np.full(len(vectors), unknown)
    k = min(k, len(known))
    near = vectors @ known.T
    best = np.argpartition(near, len(known) - k, axis=1)[:, -k:]
    weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** 4
    total = weight.sum(1)
    return np.where(total > 0, (weight * labels[best]).sum(1) / np.maximum(total, 1e-12), unknown)


def score(docs: DataFrame, model: tuple[np.ndarray, ...], idf: np.ndarray, columns: list[str], name: str = "score",
          unknown: float = 0.5) -> DataFrame:
    """``columns`` of every row of ``docs`` and its score as ``name``. A text without terms (empty or NULL)
    has no direction and scores ``unknown``, as any text does without labelled neighbours."""
    sent = docs.sparkSession.sparkContext.broadcast((*model, idf))
    keep = [docs.schema[c] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, known, labels, idf = sent.value
        for batch in batches:
            out = np.full(batch.num_rows, unknown)
            for rows, data, ends in pieces(batch):
                for a, b, own, own_ends in _blocks(data, ends):
                    x = weigh(term_counts(own, own_ends), idf) @ basis
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    out[rows.start + a:rows.start + b] = vote(x, known, labels, unknown=unknown)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(np.clip(out, 0, 1))],
                                             names=[*columns, name])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, StructType([*keep, StructField(name, DoubleType())]))


def inverse(frequencies: np.ndarray, rows: int) -> np.ndarray:
    return np.log((rows + 1) / (frequencies + 1)).astype(np.float32) + np.float32(0.1)


def quality_scores(docs: DataFrame, labels: DataFrame, columns: list[str], name: str = "score",
                   unknown: float = 0.5) -> DataFrame:
    """``columns`` and score of every row of ``docs``, learnt from the labelled rows that are not held out."""
    idf = inverse(*document_frequencies(docs))
    model = fit(labelled(docs, labels, "quality", fold(F.col("doc_id"), 4) == 2, SAMPLE_PER_CLASS), idf)
    return score(docs, model, idf, columns, name, unknown)


def good(docs: DataFrame, labels: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with their columns. Rows without labelled
    neighbours to reject them stay: texts without terms, and all rows where no label may be learnt from."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return quality_scores(docs, labels, docs.columns, name, 1.0).filter(F.col(name) >= least).select(*docs.columns)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return quality_scores(docs, read(spark, sf_dir, "labels"), ["doc_id"]).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
