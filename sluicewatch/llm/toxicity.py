"""Toxicity by subword-bag embeddings.

A word is the bag of its character n-grams, each with an embedding; a document is the average
of its distinct words, very common ones weighing less; a linear softmax on that average gives the label. Embeddings and softmax are
trained together in numpy, so misspellings that were never seen are scored by the n-grams they
share with known words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .words import mix, powers

BUCKETS = 1 << 16
WIDTH = 8
SHORTEST, LONGEST = 3, 6
#: At most so many labelled rows of each class are trained on.
SAMPLE_PER_CLASS = 3_000
EPOCHS = 120
RATE, MOMENTUM, DECAY = 1.0, 0.9, 1e-5
#: Words are trained on if they stand in this share of the sample's documents, two at least.
COMMON = 0.004
#: A word of this share of all words counts half in an average, rarer ones more.
HALF = 1e-3
REMEMBERED = 400_000
#: So many words that say nothing stand in every average, or a word would decide a short text alone.
PADDING = 20
#: Averages are small where few words matter.
SCALE = 100
THRESHOLD = 0.7


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def bare(chunk: str) -> str:
    """A blank-separated chunk without the signs around it; one of signs only stays as it is."""
    a, b = 0, len(chunk)
    while a < b and not chunk[a].isalnum():
        a += 1
    while b > a and not chunk[b - 1].isalnum():
        b -= 1
    return chunk[a:b] or chunk


def grams_of(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every character n-gram of the words, ends marked, and of each word itself. One
    that stands twice in a word counts twice."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(m) for m in marked], np.int64)
    stop = np.cumsum(size)
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:len(codes)], out=sums[1:])
    of = np.repeat(np.arange(len(words)), size)
    found, word = [(sums[stop] - sums[stop - size]) * down[stop - size] + np.uint64(1)], [np.arange(len(words))]
    for n in range(SHORTEST, LONGEST + 1):
        at = np.flatnonzero(of[:len(of) - n + 1] == of[n - 1:]) if len(of) >= n else np.zeros(0, np.int64)
        found.append((sums[at + n] - sums[at]) * down[at] + np.uint64(n))
        word.append(of[at])
    return (mix(np.concatenate(found)) % np.uint64(buckets)).astype(np.int64), np.concatenate(word)


def grams(word: str) -> list[int]:
    return grams_of([word])[0].tolist()


def known_labels(labels: DataFrame, label: str, held_out: Column) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from; an id with several labels takes the largest."""
    return (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out)
            .groupBy("doc_id").agg(F.max(label).alias("label")))


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, per_class: int) -> DataFrame:
    """(doc_id, text, label): at most ``per_class`` rows of each class in the order of a hash of the id.

    Rows with a NULL id or label are left out. The ids are bounded by the parameter, so they are
    broadcast and the documents are not shuffled.
    """
    known = known_labels(labels, label, held_out)
    picked = None
    for value in (0, 1):
        some = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def bags(sample: DataFrame) -> DataFrame:
    """Each document as its distinct words and in how many forms, with which signs around, each stands."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [Counter(map(bare, set((t or "").lower().split()))) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"],
                                "words": [list(c) for c in counts], "counts": [list(c.values()) for c in counts]})

    return sample.mapInPandas(count, "doc_id long, label int, words array<string>, counts array<int>")


class _Sums:
    """Sums rows of a table by group: (groups x width) from (members x width), members in group order."""

    def __init__(self, members: np.ndarray, groups: np.ndarray, weights: np.ndarray, n: int):
        order = np.argsort(groups, kind="stable")
        self.members, self.weights = members[order], weights[order, None].astype(np.float32)
        self.at = np.flatnonzero(np.diff(groups[order], prepend=-1))
        self.to, self.n = groups[order][self.at], n

    def __call__(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, table.shape[1]), np.float32)
        if len(self.at):
            out[self.to] = np.add.reduceat(table[self.members] * self.weights, self.at, axis=0)
        return out


def train(words: list[list[str]], counts: list[list[int]], labels: np.ndarray, epochs: int = EPOCHS,
          seed: int = 7) -> tuple[np.ndarray, float, dict[str, float]]:
    """(score of each bucket, bias, weight of each common word), by gradient descent with momentum.

    Embeddings and softmax move together on the log loss, classes weighing alike; plain steps, so
    that what many documents share is learnt before what one document has. With two classes the
    trained pair comes down to one number a bucket. With rows of less than two classes all are 0.
    """
    rng = np.random.default_rng(seed)
    share = np.bincount(labels, minlength=2)[:2]
    if len(labels) == 0 or share.min() == 0:
        return np.zeros(BUCKETS), 0.0, {}
    seen, used = Counter(), Counter()
    for ws, cs in zip(words, counts, strict=True):
        seen.update(ws)
        used.update(dict(zip(ws, cs, strict=True)))
    total = sum(used.values())
    weights = {w: HALF / (HALF + n / total) for w, n in used.items()}
    least = max(2, round(COMMON * len(labels)))
    index = {w: i for i, w in enumerate(w for w, n in seen.items() if n >= least)}
    pairs = [(d, index[w], c / (PADDING + sum(cs)) * weights[w]) for d, (ws, cs) in enumerate(zip(words, counts, strict=True))
             for w, c in zip(ws, cs, strict=True) if w in index]
    if not pairs:
        return np.zeros(BUCKETS), 0.0, {}
    doc, word, part = (np.array(x) for x in zip(*pairs, strict=True))
    gram, of_word = grams_of(list(index))
    mean = 1 / np.bincount(of_word, minlength=len(index))[of_word]
    to_words, to_grams = _Sums(gram, of_word, mean, len(index)), _Sums(of_word, gram, mean, BUCKETS)
    to_docs, from_docs = _Sums(word, doc, part, len(words)), _Sums(doc, word, part, len(index))
    table = rng.normal(0, 0.03, (BUCKETS, WIDTH)).astype(np.float32)
    soft = np.zeros((WIDTH + 1, 2), np.float32)
    soft[:WIDTH, 1] = rng.normal(0, 0.5, WIDTH)
    soft[:WIDTH, 0] = -soft[:WIDTH, 1]
    want = np.eye(2, dtype=np.float32)[labels]
    weight = (len(labels) / (2 * share))[labels][:, None].astype(np.float32) / len(labels)
    speed = [np.zeros_like(table), np.zeros_like(soft)]
    for _ in range(epochs):
        vectors = to_docs(to_words(table)) * SCALE
        logits = vectors @ soft[:WIDTH] + soft[WIDTH]
        odds = np.exp(logits - logits.max(1, keepdims=True))
        wrong = (odds / odds.sum(1, keepdims=True) - want) * weight
        grad_soft = np.concatenate([vectors.T @ wrong, wrong.sum(0, keepdims=True)])
        grad_table = to_grams(from_docs(wrong @ soft[:WIDTH].T * SCALE)) + DECAY * table
        for p, g, v, rate in ((table, grad_table, speed[0], RATE), (soft, grad_soft, speed[1], RATE / 10)):
            v *= MOMENTUM
            v += g
            p -= rate * v
    trained = np.zeros(BUCKETS, bool)
    trained[gram] = True
    table[~trained] = 0
    each = (table @ (soft[:WIDTH, 1] - soft[:WIDTH, 0])).astype(np.float64) * SCALE
    return each, float(soft[WIDTH, 1] - soft[WIDTH, 0]), {w: weights[w] for w in index}


def fit(sample: DataFrame, shares: tuple[int, int]) -> tuple[np.ndarray, float, dict[str, float]]:
    """Trains in one task on the bounded sample and hands back the model, bounded like it.

    ``shares`` are the rows of each class that there are to learn from: the bias is moved from
    equal classes to these.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "label": [], "words": [], "counts": []}), *batches])
        rows = rows.sort_values("doc_id", kind="stable")
        each, bias, weights = train(list(rows["words"]), list(rows["counts"]), rows["label"].to_numpy().astype(np.int64))
        yield pd.DataFrame({"each": [each.tobytes()], "bias": [bias], "words": [list(weights)],
                            "weights": [list(weights.values())]})

    row = bags(sample).repartition(1).mapInPandas(
        run, "each binary, bias double, words array<string>, weights array<double>").first()
    if row is None:  # nothing to learn from
        return np.zeros(BUCKETS), 0.0, {}
    odds = float(np.log((shares[1] + 0.5) / (shares[0] + 0.5)))
    return np.frombuffer(row[0], np.float64), row[1] + odds, dict(zip(row[2], row[3], strict=True))


def score(docs: DataFrame, model: tuple[np.ndarray, float, dict[str, float]]) -> DataFrame:
    """(doc_id, score) for every row: the probability of label 1 for its whole text.

    A text without words (empty, NULL, blanks) has the average 0 and so the bias alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, bias, weights = sent.value
        known: dict[str, float] = {}
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 500):
                texts = [set((t or "").lower().split()) for t in batch.column("text").slice(at, 500).to_pylist()]
                if len(known) > REMEMBERED:
                    known.clear()
                new = list(set().union(*texts).difference(known))
                for a in range(0, len(new), 50_000):
                    bares = [bare(c) for c in new[a:a + 50_000]]
                    bucket, word = grams_of(bares)
                    mean = np.bincount(word, each[bucket], len(bares)) / np.bincount(word, minlength=len(bares))
                    known.update(zip(new[a:a + 50_000], (mean * [weights.get(w, 1.0) for w in bares]).tolist(), strict=True))
                out += [bias + sum(map(known.__getitem__, t)) / (PADDING + len(t)) for t in texts]
            odds = 1 / (1 + np.exp(-np.clip(np.array(out, float), -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(odds)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, score) of every row of ``docs``, learnt from the labelled rows that are not held out."""
    counts = {r[0]: r[1] for r in known_labels(labels, "toxic", held_out).groupBy("label").count().collect()}
    model = fit(labelled(docs, labels, "toxic", held_out, per_class), (counts.get(0, 0), counts.get(1, 0)))
    return score(docs, model)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 3) == 1
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
