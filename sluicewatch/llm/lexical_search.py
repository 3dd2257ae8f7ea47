"""Ranked lexical search over whole texts: hybrid of term-at-a-time and document-at-a-time.

One pass over the documents keeps, for each one, its length and how often it holds the terms that are
asked for. Statistics over all documents weigh the terms. Then each task inverts the documents it
has, shard by shard, and answers every item on a shard: the item's short lists are summed into one
list of accumulators, which from there on is an iterator like the long lists, with the largest sum as
its bound. Document by document, the iterators whose bounds together can't reach the k-th score so far
propose nothing and are only looked up, by skipping, for candidates that may still make it. The k-th
score goes on to the task's next shard. Only the best of each task and item are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read, running_sums
from .words import NOT_ALNUM, pieces, words

K = 10
#: Distinct terms, summed over items, that are broadcast at a time (and one item).
BLOCK_TERMS = 500_000
#: Postings that a task inverts at a time.
POSTINGS = 2_000_000
#: An item's shortest lists are summed while they hold at most this share of the shard's documents.
SHORT = 0.25
#: Documents of a shard that a step of the document-at-a-time pass covers.
STEP = 4_096
FILTER_BITS = 22
LAST = np.iinfo(np.int64).max


def item_terms(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, terms): a number of its own for each row and the hashes of its distinct terms."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumns(
        {"one": F.lit(1), "none": F.col("item_id").isNull(), "text_hash": F.xxhash64("text")})
    numbered = running_sums(rows, [], ["none", "item_id", "text_hash"], ["one"], ["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, ends in pieces(batch):
                terms, of, _, _ = words(data, ends, NOT_ALNUM)
                own = [np.unique(terms[a:b]).view(np.int64) for a, b in
                       zip(np.searchsorted(of, np.arange(len(ends))), np.searchsorted(of, np.arange(1, len(ends) + 1)), strict=True)]
                rows = batch.slice(part.start, len(ends))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("item"), rows.column("item_id"), pa.array(own, pa.list_(pa.int64()))], names=["item", "item_id", "terms"])

    return cut_lineage(numbered.select(F.col("before_one").cast("long").alias("item"), "item_id", "text").mapInArrow(
        run, "item long, item_id long, terms array<long>"))


class Vocabulary:
    """The terms of one block of items, by hash; ``find`` numbers them among a text's words."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[terms >> np.uint64(64 - FILTER_BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``hashes``, number of the term) of every word that is a term of the block."""
        likely = np.flatnonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])
        at = np.searchsorted(self.terms, hashes[likely])
        at[at == len(self.terms)] = 0
        same = self.terms[at] == hashes[likely] if len(self.terms) else np.zeros(0, bool)
        return likely[same], at[same]


def occurrences(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, counts) of each document with at least one term of any kind: all its terms
    with repeats, the numbers of those in the vocabulary, and how often each occurs."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        size = max(1, len(own.terms))
        for batch in batches:
            for part, data, ends in pieces(batch):
                hashes, of, _, _ = words(data, ends, NOT_ALNUM)
                n = np.bincount(of, minlength=len(ends))
                place, term = own.find(hashes)
                pair, count = np.unique(of[place] * size + term, return_counts=True)
                cuts = np.searchsorted(pair, np.arange(len(ends) + 1) * size).astype(np.int32)
                rows = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.start, len(ends)), pa.array(n),
                     pa.ListArray.from_arrays(cuts, pa.array((pair % size).astype(np.int32))),
                     pa.ListArray.from_arrays(cuts, pa.array(count.astype(np.int32)))], names=["doc_id", "n", "terms", "counts"])
                yield rows.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n long, terms array<int>, counts array<int>")


def term_weight(all_docs: int, with_term: int) -> int:
    return math.floor(1000 * math.log((2 * all_docs + 2) / (2 * with_term + 1)))


class Shard:
    """Inverted lists of some documents: numbers of documents in ascending id order, and what a term adds."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, of: np.ndarray, term: np.ndarray, count: np.ndarray,
                 weights: np.ndarray, all_docs: int, all_terms: int):
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        self.ids = ids[order]
        doc = rank[of]
        by = np.lexsort((doc, term))
        doc, term, count = doc[by], term[by], count[by].astype(np.int64)
        m = 10 + (90 * n[order] * all_docs) // all_terms
        adds = weights[term] * ((1_000_000_000 * count) // (1000 * count + 8 * m[doc]))
        self.terms, start = np.unique(term, return_index=True)
        self.start = np.append(start, len(term))
        self.doc, self.adds = doc, adds
        self.bound = np.maximum.reduceat(adds, start) if len(start) else adds

    def lists(self, terms: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(bound, documents, what each gets) of those of the terms that the shard holds, shortest first."""
        at = np.searchsorted(self.terms, terms)
        at = at[at < len(self.terms)] if len(self.terms) else at[:0]
        at = np.unique(at)
        at = at[np.isin(self.terms[at], terms)]
        at = at[self.bound[at] > 0]
        at = at[np.argsort(self.start[at + 1] - self.start[at], kind="stable")]
        return [(int(self.bound[i]), self.doc[self.start[i]:self.start[i + 1]], self.adds[self.start[i]:self.start[i + 1]])
                for i in at.tolist()]

    def accumulated(self, short: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
        """Short lists summed term at a time: one list, bounded by its largest sum."""
        doc = np.concatenate([d for _, d, _ in short])
        adds = np.concatenate([a for _, _, a in short])
        order = np.argsort(doc, kind="stable")
        doc = doc[order]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        sums = np.add.reduceat(adds[order], first)
        return int(sums.max()), doc[first], sums

    def best(self, terms: np.ndarray, k: int, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores), of ``held`` and of this shard, by falling score and rising id."""
        lists = self.lists(terms)
        if not lists:
            return held
        sizes = np.cumsum([len(d) for _, d, _ in lists])
        n_short = max(1, int(np.searchsorted(sizes, SHORT * len(self.ids), side="right")))
        runs = sorted([self.accumulated(lists[:n_short]), *lists[n_short:]], key=lambda x: x[0])
        together = np.cumsum([b for b, _, _ in runs])
        ids, scores = held
        for lo in range(0, len(self.ids), STEP):
            kth = int(scores[k - 1]) if len(scores) >= k else 1
            # runs below ``essential`` cannot lift a document to the k-th score by themselves
            essential = int(np.searchsorted(together, kth, side="left"))
            if essential == len(runs):
                break
            parts = []
            for _, doc, adds in runs:
                a, b = np.searchsorted(doc, [lo, lo + STEP])
                parts.append((doc[a:b], adds[a:b]))
            total = np.zeros(STEP, np.int64)
            seen = np.zeros(STEP, bool)
            for doc, adds in parts[essential:]:
                total[doc - lo] += adds
                seen[doc - lo] = True
            own = np.flatnonzero(seen)
            for i in range(essential - 1, -1, -1):
                own = own[total[own] + together[i] >= kth]
                if not len(own):
                    break
                doc, adds = parts[i]
                if not len(doc):
                    continue
                at = np.minimum(np.searchsorted(doc, own + lo), len(doc) - 1)
                hit = doc[at] == own + lo
                total[own[hit]] += adds[at[hit]]
            own = own[total[own] >= kth]
            if len(own):
                ids, scores = np.concatenate([ids, self.ids[own + lo]]), np.concatenate([scores, total[own]])
                top = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[top], scores[top]
        return ids, scores


def best_of_tasks(rows: DataFrame, items: list[tuple[int, np.ndarray]], weights: np.ndarray, all_docs: int, all_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): for every item the k best of each task's documents."""
    sent = rows.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weigh = sent.value
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        held = {item: none for item, _ in asked}
        waiting, size = [], 0

        def search() -> None:
            ids, n, lengths, term, count = (np.concatenate(x) for x in zip(*waiting, strict=True))
            shard = Shard(ids, n, np.repeat(np.arange(len(ids)), lengths), term, count, weigh, all_docs, all_terms)
            for item, terms in asked:
                held[item] = shard.best(terms, k, held[item])

        for batch in batches:
            at = 0
            lists, counts = batch.column("terms"), batch.column("counts")
            ends = lists.offsets.to_numpy()
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + POSTINGS - size, side="right")) - 1)
                to = min(to, batch.num_rows)
                ids = batch.column("doc_id").slice(at, to - at).fill_null(LAST).to_numpy()
                waiting.append((ids, batch.column("n").slice(at, to - at).to_numpy(), np.diff(ends[at:to + 1]),
                                lists.values.to_numpy()[ends[at]:ends[to]], counts.values.to_numpy()[ends[at]:ends[to]]))
                size += int(ends[to] - ends[at])
                at = to
                if size >= POSTINGS or at < batch.num_rows:
                    search()
                    waiting, size = [], 0
        if waiting:
            search()
        item = np.repeat([i for i, _ in asked], [len(held[i][0]) for i, _ in asked]).astype(np.int64)
        ids, scores = (np.concatenate([held[i][j] for i, _ in asked]) for j in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(ids, mask=ids == LAST), pa.array(scores)], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, benchmark: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0.

    Terms are runs of letters, digits and all that is not ASCII, ASCII case aside; an item's terms count
    once. NULL and empty texts have none: such items find nothing, such documents are not found and not
    counted. Rows that share a doc_id are documents of their own, rows that share an item_id items of
    their own; a NULL id is the largest. Texts of any length are read whole, other columns are not
    looked at, an empty table gives no rows. Items go in blocks of ``block_terms`` terms and
    one item, and for each block the documents are read once and its counts twice, so either may grow.
    """
    items = item_terms(benchmark).filter("size(terms) > 0").withColumn("size", F.size("terms").cast("long"))
    spread = cut_lineage(running_sums(items, [], ["item"], ["size"], ["item_id", "terms"]).withColumn(
        "block", F.floor(F.col("before_size") / block_terms)))
    out = None
    for (block,) in spread.select("block").distinct().orderBy("block").collect():
        asked = spread.filter(F.col("block") == block).select("item", "terms").orderBy("item").collect()
        terms = np.unique(np.concatenate([np.array(r.terms, np.int64).view(np.uint64) for r in asked]))
        rows = cut_lineage(occurrences(docs, Vocabulary(terms)))
        all_docs, all_terms = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not all_docs:
            continue
        df = np.zeros(len(terms), np.int64)
        for term, count in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = count
        weights = np.array([term_weight(all_docs, d) for d in df.tolist()], np.int64)
        numbers = [(r.item, np.searchsorted(terms, np.sort(np.array(r.terms, np.int64).view(np.uint64)))) for r in asked]
        found = best_of_tasks(rows, numbers, weights, all_docs, all_terms, k)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        part = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spread.select("item_id", F.lit(0).alias("rank"), F.col("item").alias("doc_id"), F.col("item").alias("score")).limit(0)
    return out.join(spread.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), q AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t
  FROM benchmark
), whole AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
e AS (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM e WHERE t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (
  SELECT q.item_id, tf.doc_id,
         sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN df USING (t), whole
  GROUP BY ALL
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op13_lexical_search": op13_lexical_search}
ORACLES = {"op13_lexical_search": SQL}
